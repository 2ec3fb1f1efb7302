"""Sessions, sides, row keys and joins of heavy keys."""

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidemark.functions import scratch
from tidemark.llm import runtime

ARROW, COLUMNS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def test_the_callers_session_stays(spark):
    before = {k: spark.conf.get(k, None) for k in (ARROW, COLUMNS)}
    small = runtime.small_batches(documents(spark, [(1, "a")]))
    assert {k: spark.conf.get(k, None) for k in (ARROW, COLUMNS)} == before
    assert small.sparkSession.conf.get(ARROW) == str(runtime.TEXT_ROWS) and small.collect()[0].text == "a"
    assert spark.sparkContext.parallelize([(1,)]).toDF("a long").sparkSession is spark
    with runtime.session_conf(spark, ARROW, "77"):
        assert runtime.small_batches(small.sparkSession.range(1)).sparkSession.conf.get(COLUMNS) == str(runtime.COLUMN_ROWS)
        assert runtime.small_batches(documents(spark, [])).sparkSession.conf.get(ARROW) == "77"


def test_sides_are_broadcast_by_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    narrow, wide = spark.range(100), spark.range(100).withColumn("t", F.repeat(F.lit("x"), 10_000))
    assert hinted(runtime.side(narrow, 100_000)) and not hinted(runtime.side(wide, 100_000)) and not hinted(runtime.side(narrow, 100))


def test_heavy_keys_join_in_parts(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HEAVY_ROWS", 5)
    monkeypatch.setattr(runtime, "HEAVY_SHARE", 1000)
    many = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 7 ELSE id END AS k", "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"))
    parts = runtime.heavy(one, ["k"], 100)
    assert [(r["k"], r["__parts"]) for r in parts.collect()] == [(7, 12)]
    got = runtime.salted_join(many, one, ["k"], parts)
    assert got.columns == ["k", "id", "n"] and sorted(map(tuple, got.collect())) == sorted((7, i, 60) if i < 60 else (i, i, 1) for i in range(100))
    assert runtime.heavy(one, ["k"], 5) is None


def test_keys_follow_ids_and_contents(spark):
    plain, single = runtime.keyed(documents(spark, [(3, "a"), (1, "b")]), "key")
    assert single and {r.doc_id: r.key for r in plain.collect()} == {3: 3, 1: 1}
    odd, single = runtime.keyed(documents(spark, [(3, "a"), (3, "b"), (3, "a"), (None, "c"), (None, "d"), (1, "z"), (None, None)]), "key")
    keys = {(r.doc_id, r.text): r.key for r in odd.collect()}
    assert not single and len(set(keys.values())) == 6 and odd.count() == 7
    assert keys[1, "z"] < min(keys[3, "a"], keys[3, "b"]) and max(keys[3, "a"], keys[3, "b"]) < min(keys[None, "c"], keys[None, "d"], keys[None, None])


def test_clusters_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
