"""Streams against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators import aggregates
from tidemark.operators.classify import classify_observed
from tidemark.operators.state import upsert
from tidemark.plans import standin
from tidemark.sources.sinks import SnapshotStore
from tidemark.streaming import streams

SCHEMA = "channel bigint, id bigint, root_id bigint, created bigint, modified bigint, seq bigint, deleted boolean, body string"


def day(m, d):
    return int(dt.datetime(2024, m, d, tzinfo=dt.UTC).timestamp() * 1e6)


BATCHES = [
    [(1, 1, None, day(1, 5), day(1, 5), 1, False, "a"), (1, 2, 1, day(1, 6), day(1, 6), 2, False, "b"), (2, 9, None, day(2, 1), day(2, 1), 3, False, "z")],
    [(1, 3, None, day(2, 3), day(2, 3), 4, False, "c"), (1, 2, 1, day(1, 6), day(2, 4), 5, True, ""), (1, 8, 77, day(2, 4), day(2, 4), 6, False, "lost root")],
    [(1, 4, 1, day(3, 1), day(3, 1), 7, False, "late reply to January")],
]


def feed(spark, tmp_path):
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    return streams.read_batches(spark, f"{tmp_path}/in/*", SCHEMA)


def test_month_stream_gives_each_changed_month(spark, tmp_path):
    out = []
    q = (
        streams.month_stream(feed(spark, tmp_path))
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, i: out.extend((i, *r) for r in df.collect()))
        .option("checkpointLocation", f"{tmp_path}/ck")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(180)
    latest = {(c, m): (n, new) for _, c, m, n, _, new in sorted(out)}
    assert latest == {(1, "2024-01"): (3, day(3, 1)), (1, "2024-02"): (1, day(2, 3)), (2, "2024-02"): (1, day(2, 1))}
    rows = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    rows = rows.withColumns({c: F.timestamp_micros(c) for c in ("created", "modified")})
    batch = aggregates.month_rollup(rows).select("channel", F.date_format("month", "yyyy-MM"), "n", micros("newest")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in batch} == latest
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")  # the caller's session stays


def test_month_upserts_keep_the_newest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT", 2)
    streams.month_upserts(feed(spark, tmp_path), f"{tmp_path}/store", f"{tmp_path}/ck2").awaitTermination(180)
    store = SnapshotStore(spark, f"{tmp_path}/store")
    rows = streams.messages_now(store).collect()
    assert store.tables()["messages"] == [1] and store.tables()["changes"] == [0, 1, 2]
    assert sorted((r.id, r.modified) for r in rows) == [(1, day(1, 5)), (2, day(2, 4)), (3, day(2, 3)), (4, day(3, 1)), (8, day(2, 4)), (9, day(2, 1))]


def test_cycle_stream_equals_batch(spark, sf_dir, tmp_path):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    observed, stored = standin.observed(d), standin.stored(d)
    store = SnapshotStore(spark, f"{tmp_path}/store")
    store.write("items", 0, stored)
    store.publish(0)
    half = F.pmod(F.xxhash64("stable_id"), F.lit(2))
    for k in (0, 1):
        observed.where(half == k).coalesce(1).write.parquet(f"{tmp_path}/feed/b{k}")
    schema = observed.schema.simpleString().removeprefix("struct<").removesuffix(">")
    q = streams.cycle_stream(spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed/*"), f"{tmp_path}/store", f"{tmp_path}/ck", standin.WRITTEN_AT)
    q.awaitTermination(240)
    assert q.exception() is None and schema
    want = upsert(stored, observed, classify_observed(observed, stored, standin.WRITTEN_AT), 0).drop("last_seen_run", "first_seen_run")
    got = store.read("items", store.published()).drop("last_seen_run", "first_seen_run").select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_windowed_counts_and_once(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/ev")
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("wc").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("wc").agg(F.sum("n")).first()[0] == e.count()
