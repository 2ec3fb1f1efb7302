"""Steps of a cycle do their work once a row, and none where there is nothing to do."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import RESERVED, slug
from tidemark.operators import graph, parts, quality
from tidemark.sources.versions import VersionedStore


def counted(spark):
    """A function that gives back its column, and the number of rows that went through it."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.StringType())
    def passed(s: pd.Series) -> pd.Series:
        seen.add(len(s))
        return s

    return passed, seen


def test_a_wanted_path_is_made_once(spark):
    passed, seen = counted(spark)
    wanted = spark.range(60).select(F.lit("s").alias("source_id"), F.col("id").cast("string").alias("stable_id"), passed(F.concat(F.lit("m/"), (F.col("id") % 40).cast("string"), F.lit(".md"))).alias("path"))
    owned = spark.createDataFrame([("s", "3", "M/3.md"), ("s", "99", "m/7.md")], "source_id string, stable_id string, path string")
    got = {r.stable_id: r.path for r in parts.allocated_paths(wanted, owned).collect()}
    assert seen.value == 60
    assert got["3"] == "M/3.md" and got["45"] == "m/5.md" and got["5"].startswith("m/5-") and got["43"].startswith("m/3-") and got["7"].startswith("m/7-") and len(set(got.values())) == 60
    mine = spark.createDataFrame([("s", "5", "m/5.md")], "source_id string, stable_id string, path string")
    assert [r.path for r in parts.allocated_paths(mine, mine).collect()] == ["m/5.md"]


def test_a_tree_is_not_read_without_roots(spark):
    passed, seen = counted(spark)
    tree = spark.range(60).select(F.lit("s").alias("source_id"), passed(F.col("id").cast("string")).alias("stable_id"), F.lit("0").alias("parent_id"))
    found = graph.descendants(tree, spark.createDataFrame([], "source_id string, stable_id string"))
    assert found.columns == ["source_id", "stable_id"] and found.count() == 0 and seen.value == 0


def test_a_join_with_a_table_that_is_not_there_reads_nothing(spark, tmp_path):
    passed, seen = counted(spark)
    rows = spark.range(60).select(F.lit("s").alias("source_id"), passed(F.col("id").cast("string")).alias("stable_id"))
    assert VersionedStore(spark, f"file://{tmp_path}").read("items").join(rows, ["source_id", "stable_id"]).count() == 0 and seen.value == 0


def test_plain_segments_are_what_the_slug_leaves(spark):
    ends = ["", "a", ".", "-", "_", " ", "A", "é", "\n", ".txt", "1", "0", "\t", "#"]
    segments = sorted({a + b + c for a in ("", "x", ".", *RESERVED) for b in ends for c in ends} - {""})
    pages = spark.createDataFrame([(f"mirror/{s}",) for s in segments], "path string")
    odd = {r.path for r in quality.path_findings(pages).where("rule = 'path-segment'").collect()}
    assert odd == {f"mirror/{s}" for s in segments if slug(s) != s}
