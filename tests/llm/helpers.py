"""Small document tables for the operator tests."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, rows, clashing=()):
    """rows: (doc_id, text) or (doc_id, text, lang); clashing: names of extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    out = spark.createDataFrame(full, DOCUMENTS)
    for name in clashing:
        out = out.withColumn(name, F.lit("x"))
    return out
