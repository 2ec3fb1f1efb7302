"""Streaming forms: micro-batches over feeds, with state that late records can still change."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.scratch import in_own_session
from tidemark.operators.classify import KEYS, classify_observed
from tidemark.operators.state import upsert
from tidemark.sources.sinks import SnapshotStore


class MonthCounts(StatefulProcessor):
    """State of a channel: what is known of each message, and the count and times of each thread and month.

    A batch costs its own rows: a new message adds to its thread's month, a newer record of a known one can only move the
    newest time on.  Threads whose root has not come wait, and join their month when it does.  Nothing expires: a late reply
    opens the month of its thread's root again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "id bigint", "root bigint, modified bigint, seq bigint")
        self.threads = handle.getMapState("threads", "root bigint", "month string, n bigint, oldest bigint, newest bigint")
        self.months = handle.getMapState("months", "month string", "n bigint, oldest bigint, newest bigint")

    def add(self, month: str, n: int, oldest: int, newest: int) -> None:
        if self.months.containsKey((month,)):
            m = self.months.getValue((month,))
            n, oldest, newest = n + m[0], min(oldest, m[1]), max(newest, m[2])
        self.months.updateValue((month,), (n, oldest, newest))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        changed = set()
        for batch in rows:
            for r in batch.itertuples():
                known = self.messages.getValue((r.id,)) if self.messages.containsKey((r.id,)) else None
                if known is not None and (known[1], known[2]) >= (r.modified, r.seq):
                    continue
                root = int(r.id) if pd.isna(r.root_id) else int(r.root_id)
                self.messages.updateValue((r.id,), (root, int(r.modified), int(r.seq)))
                month, n, oldest, newest = self.threads.getValue((root,)) if self.threads.containsKey((root,)) else (None, 0, int(r.created), int(r.modified))
                new = int(known is None)
                n, oldest, newest = n + new, min(oldest, int(r.created)), max(newest, int(r.modified))
                if month is None and root == r.id:
                    month = pd.Timestamp(r.created, unit="us").strftime("%Y-%m")
                    self.add(month, n, oldest, newest)
                elif month is not None:
                    self.add(month, new, int(r.created), int(r.modified))
                self.threads.updateValue((root,), (month, n, oldest, newest))
                changed.add(month)
        out = [(key[0], m, *self.months.getValue((m,))) for m in sorted(changed - {None})]
        yield pd.DataFrame(out, columns=["channel", "month", "n", "oldest", "newest"])

    def close(self) -> None:
        pass


def month_stream(messages: DataFrame) -> DataFrame:
    """Months (channel, month, n, oldest, newest in microseconds) as messages change them; update mode.

    Map state needs the RocksDB store, so the stream has a session of its own.
    """
    own = in_own_session(messages, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    return own.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=MonthCounts(), outputStructType="channel bigint, month string, n bigint, oldest bigint, newest bigint", outputMode="Update", timeMode="None"
    )


#: Batches between two compactions of the message table.
COMPACT = 16


def newest_records(rows: DataFrame) -> DataFrame:
    """The newest record of each message."""
    newest = W.partitionBy("channel", "id").orderBy(F.desc("modified"), F.desc("seq"))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def messages_now(store: SnapshotStore, run: int | None = None) -> DataFrame | None:
    """The newest record of each message up to a published run: the last whole table and the changes after it."""
    run = store.published() if run is None else run
    if run is None:
        return None
    tables = store.tables()
    base = max((r for r in tables.get("messages", []) if r <= run), default=None)
    later = [store.read("changes", r) for r in tables.get("changes", []) if r <= run and (base is None or r > base)]  # under COMPACT
    parts = ([] if base is None else [store.read("messages", base)]) + later
    return newest_records(reduce(lambda a, b: a.unionByName(b), parts)) if parts else None


def month_upserts(messages: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """The same as a table by run: each batch writes the newest of its own records, and every COMPACT batches a whole table."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        snapshots = SnapshotStore(batch.sparkSession, store)
        snapshots.write("changes", batch_id, newest_records(batch))
        if batch_id % COMPACT == COMPACT - 1:
            snapshots.write("messages", batch_id, messages_now(snapshots, batch_id))
        snapshots.publish(batch_id)

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cycle_stream(observed: DataFrame, store: str, checkpoint: str, written_at_ns: int) -> StreamingQuery:
    """The incremental cycle by micro-batch: classify against the published items, write the next, then publish.

    A batch that runs again after a crash reads the run before it and writes the same folder, so it counts once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        snapshots = SnapshotStore(batch.sparkSession, store)
        stored = snapshots.read("items", snapshots.published(batch_id))
        verdicts = classify_observed(batch, stored, written_at_ns)
        snapshots.write("verdicts", batch_id + 1, verdicts)
        snapshots.write("items", batch_id + 1, upsert(stored, batch, snapshots.read("verdicts", batch_id + 1), batch_id + 1))
        snapshots.publish(batch_id + 1)

    return observed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type, for streams whose late records may be let go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(
        F.col("w.start").alias("start"), "event_type", "n", "v"
    )


def once(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Records once each though a resumed read overlaps the one before."""
    return records.withWatermark("modified", late).dropDuplicatesWithinWatermark(["id", "modified"])


def read_batches(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


__all__ = ["KEYS", "cycle_stream", "messages_now", "month_stream", "month_upserts", "once", "read_batches", "windowed_counts"]
