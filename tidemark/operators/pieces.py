"""Long work in pieces that survive a run: a table of partial results, claimed, finished and put together over several runs.

A job (a recording, a large file) has a key, the hash of its bytes and options, and as many pieces as its plan says.  A run
claims open pieces up to its time box, works on them and stores their results; the next run goes on.  When the key changes the
job begins anew, and what older keys left goes.  A claim of a run that died counts for nothing once that run is no longer open, so
each piece is done once and none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import prefix_sums
from tidemark.sources.versions import VersionedStore

OPEN, CLAIMED, DONE = "open", "claimed", "done"


def planned(jobs: DataFrame) -> DataFrame:
    """A row for each piece of jobs (job, key, pieces)."""
    each = jobs.where("pieces > 0").select("job", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces").cast("bigint") - 1)).alias("piece"))
    return each.select("job", "piece", "key")


def merged(stored: DataFrame, jobs: DataFrame, open_runs: list[int]) -> DataFrame:
    """The pieces of jobs as they stand: results of the same key stay, other keys are cut over, dead claims are open again; jobs that are no more go."""
    old = stored.select("job", "piece", F.col("key").alias("__key"), "state", "run_id", "result")
    rows = planned(jobs).join(old, ["job", "piece"], "left")
    same = F.col("__key").eqNullSafe(F.col("key"))
    held = (F.col("state") == CLAIMED) & (F.col("run_id").isin(*open_runs) if open_runs else F.lit(False))
    state = F.when(same & ((F.col("state") == DONE) | held), F.col("state")).otherwise(OPEN)
    rows = rows.withColumn("state", state)
    live = F.col("state") != OPEN
    return rows.select("job", "piece", "key", "state", F.when(live, F.col("run_id")).alias("run_id"), F.when(F.col("state") == DONE, F.col("result")).alias("result"))


def claim(pieces: DataFrame, run_id: int, seconds: DataFrame, box_s: int) -> DataFrame:
    """pieces with open ones claimed by a run, in order, while its box has time; begun jobs come first.  seconds: job, seconds (of one piece)."""
    begun = pieces.groupBy("job").agg(F.count_if(F.col("state") == DONE).alias("__done"))
    queue = pieces.where(F.col("state") == OPEN).join(seconds, "job").join(begun, "job").withColumn("__order", F.struct(-F.col("__done"), "job", "piece"))
    mine = prefix_sums(queue, "__order", "seconds").where(F.col("before") < box_s).select("job", "piece", F.lit(True).alias("__mine"))
    rows = pieces.join(mine, ["job", "piece"], "left")
    own = {"state": F.when(F.col("__mine"), CLAIMED).otherwise(F.col("state")), "run_id": F.when(F.col("__mine"), F.lit(run_id).cast("bigint")).otherwise(F.col("run_id"))}
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in pieces.columns])


def finish(pieces: DataFrame, run_id: int, results: DataFrame) -> DataFrame:
    """pieces with the results (job, piece, key, result) of a run's claims; a result for another key than the piece has, or without a claim, is not taken."""
    new = results.select("job", "piece", "key", F.col("result").alias("__result"))
    rows = pieces.join(new, ["job", "piece", "key"], "left")
    taken = F.col("__result").isNotNull() & (F.col("state") == CLAIMED) & (F.col("run_id") == run_id)
    own = {"state": F.when(taken, DONE).otherwise(F.col("state")), "result": F.when(taken, F.col("__result")).otherwise(F.col("result"))}
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in pieces.columns])


def complete(pieces: DataFrame) -> DataFrame:
    """job, key, result of jobs whose pieces are all done: their results in order, an empty line between."""
    ready = pieces.groupBy("job", "key").agg(F.bool_and(F.col("state") == DONE).alias("ok"), F.array_sort(F.collect_list(F.struct("piece", "result"))).alias("held")).where("ok")  # the pieces of one job
    return ready.select("job", "key", F.array_join(F.transform("held", lambda x: x["result"]), "\n").alias("result"))


def progress(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("job").agg(F.count_if(F.col("state") == DONE).alias("done"), F.count("*").alias("of"))


class PieceStore:
    """The table of pieces in a versioned store: a claim is published before the work begins, a result with the run that made it."""

    def __init__(self, store: VersionedStore):
        self.store = store

    def pieces(self) -> DataFrame:
        return self.store.read("pieces")

    def claim(self, run_id: int, jobs: DataFrame, seconds: DataFrame, box_s: int, open_runs: list[int] = ()) -> DataFrame:
        """Publishes a run's claims and returns them."""
        self.store.begin(run_id)
        self.store.replace("pieces", run_id, claim(merged(self.pieces(), jobs, list(open_runs)), run_id, seconds, box_s))
        self.store.commit(run_id)
        return self.pieces().where((F.col("state") == CLAIMED) & (F.col("run_id") == run_id))

    def finish(self, run_id: int, claimed_by: int, results: DataFrame) -> DataFrame:
        """Publishes what a claim's run has made; the jobs that are complete."""
        self.store.begin(run_id)
        self.store.replace("pieces", run_id, finish(self.pieces(), claimed_by, results))
        self.store.commit(run_id)
        return complete(self.pieces())
