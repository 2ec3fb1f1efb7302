"""Shared plumbing of the training-data operators: table reads, joins of checked sizes, row keys, batch sizes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scratch import in_own_session, materialize, shared_dir

__all__ = ["fresh", "heavy", "id_bucket", "keyed", "materialize", "salted_join", "session_conf", "shared_dir", "side", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it; names are the same in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast table takes besides its values.
ROW_BYTES = 40


def row_bytes(df: DataFrame) -> Column:
    """An estimate of the bytes that a row takes in memory."""
    total = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            size = 8 * F.size(F.col(f.name)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = 2 * F.octet_length(F.to_json(F.struct(F.col(f.name))))
        else:
            size = F.lit(16)
        total = total + F.coalesce(size, F.lit(0))
    return total.cast("long")


def side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table as one side of a join: broadcast while its bytes in memory are measured at or under the bound, else shuffled."""
    if df.count() * ROW_BYTES > limit:  # the count comes from the files' footers
        return df
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit else df


#: A key with more rows than this, and than one in HEAVY_SHARE of all, is joined in parts; so there are at most HEAVY_SHARE such keys.
HEAVY_ROWS, HEAVY_SHARE = 100_000, 20_000


def heavy(counted: DataFrame, keys: list[str], rows: int, n: str = "n") -> DataFrame | None:
    """Of ``counted`` (keys and their number of rows ``n``, out of ``rows``): the heavy keys and __parts, the tasks they are to be dealt to."""
    bound = max(HEAVY_ROWS, rows // HEAVY_SHARE)
    if rows <= bound:
        return None
    out = counted.where(F.col(n) > bound).select(*keys, F.ceil(F.col(n) / bound).cast("int").alias("__parts"))
    out = materialize(out, "heavy")
    return out if out.limit(1).count() else None


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], parts: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (few rows a key): rows of a heavy key are dealt to its parts and its other side is copied to each."""
    if parts is None:
        return many.join(one, keys, how)
    parts = F.broadcast(parts)  # at most HEAVY_SHARE narrow rows
    own = [c for c in many.columns if c not in keys]
    dealt = many.join(parts, keys, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*own), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copied = one.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """docs with a number ``key`` that tells its rows apart and orders them, and whether each number is one row.

    Where ids are unique and not null it is the id.  Else rows are numbered in the order of id (null last) and content
    (the MD5 of the text); rows that agree in both are one text and share their number.  DataFrame operations only.
    """
    doc = F.col("doc_id").cast("long")
    odd = docs.select(doc.alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("n > 1 or d is null").limit(1).count()
    if not odd:
        return docs.withColumn(key, doc), True
    content = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    names = docs.select(doc.alias("d"), content.alias("c")).distinct().orderBy(F.col("d").asc_nulls_last(), "c")
    names = materialize(names.select("d", "c", F.monotonically_increasing_id().alias(key)), "order")
    numbered = docs.join(side(names), doc.eqNullSafe(names["d"]) & (content == names["c"]), "left").select(*[docs[c] for c in docs.columns], key)
    return materialize(numbered, "keyed"), False


#: Rows here are whole texts, so batches of the engine's default number of rows would hold many megabytes each.
TEXT_ROWS, MIXED_ROWS, COLUMN_ROWS = 1000, 4000, 512


def small_batches(df: DataFrame, rows: int = TEXT_ROWS, tidy: bool = False) -> DataFrame:
    """df in a session of its own whose Arrow and column batches have fewer rows than the engine's defaults.

    The caller's session stays as it is, and sizes that a user has chosen hold.  MIXED_ROWS is for plans that also stream
    many narrow rows.  tidy removes the shuffle files of a job when it ends, for plans of several written steps.
    """
    sizes = {("spark.sql.execution.arrow.maxRecordsPerBatch", 10000): rows, ("spark.sql.parquet.columnarReaderBatchSize", 4096): COLUMN_ROWS}
    free = {key: str(n) for (key, usual), n in sizes.items() if df.sparkSession.conf.get(key, str(usual)) in (str(usual), str(TEXT_ROWS), str(MIXED_ROWS))}
    return in_own_session(df, free | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} if tidy else free)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; NULL for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


@contextmanager
def session_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Set a session option for the jobs that run inside."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
