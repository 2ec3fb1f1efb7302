"""Holds over the purge queue."""

from tidemark.operators import governance


def test_a_hold_on_all_holds_at_any_number_of_holds(spark):
    queue = spark.createDataFrame([("a", 1, "operator", 1), ("src7", 2, "operator", 2)], "source_id string, stable_id bigint, reason string, seq bigint")
    keep = spark.createDataFrame([("a", 9)], "source_id string, stable_id bigint")
    many = spark.range(10_500).selectExpr("concat('src', id) AS scope")
    all_ = spark.createDataFrame([("all",)], "scope string")
    for holds, want in ((many.unionByName(all_), {1, 2}), (all_, {1, 2}), (many, {2}), (many.limit(0), set())):
        assert {r.stable_id for r in governance.purge_queue(queue, holds, keep).collect() if r.held} == want
