"""Erasure, holds, suppression and retention over snapshots kept by run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import glob_match
from tidemark.operators.graph import erasure_fixpoint

REASONS = ("upstream-deleted", "label-escalation", "dlp-remediation", "erasure-request", "operator")


def selected(items: DataFrame, by: str, value: str, source: str | None = None) -> DataFrame:
    """Items that a selector names: exactly one of id, path (a glob) or docs (a glob of output paths)."""
    if by not in ("id", "path", "docs"):
        raise ValueError(f"not a selector: {by}")
    rows = items if source is None else items.where(F.col("source_id") == source)
    return rows.where({"id": F.col("stable_id") == value, "path": glob_match("rel_path", value), "docs": glob_match("output_path", value)}[by])


def last_event(events: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last event of each key of an audit log."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("e")).select(key, "e.*")


def active_holds(events: DataFrame) -> DataFrame:
    """Scopes whose last event set a hold."""
    return last_event(events.where("event in ('hold', 'release')"), "scope").where("event = 'hold'").select("scope", "seq")


def held(rows: DataFrame, holds: DataFrame) -> DataFrame:
    """Rows that a hold keeps: one on their source, or on all."""
    scopes = holds.select(F.col("scope").alias("__scope"))
    everything = holds.where("scope = 'all'").limit(1).count() > 0
    return rows if everything else rows.join(scopes, rows["source_id"] == scopes["__scope"], "left_semi")


def active_suppressions(events: DataFrame) -> DataFrame:
    return last_event(events.where("event in ('suppress', 'unsuppress')"), "stable_id").where("event = 'suppress'").select("stable_id")


class HoldActive(Exception):
    """A purge would touch a source under a hold."""


def blocking_holds(ids: DataFrame, holds: DataFrame) -> list[str]:
    """The scopes of holds that cover a source of the ids: holds on one source, or on all."""
    sources = ids.select("source_id").distinct()
    on_source = holds.join(sources.withColumnRenamed("source_id", "scope"), "scope", "left_semi").select("scope")
    on_all = holds.where("scope = 'all'").select("scope") if not ids.isEmpty() else holds.select("scope").limit(0)
    return sorted(r["scope"] for r in on_source.unionByName(on_all).distinct().collect())  # holds are set by hand


def erase(tables: dict[str, DataFrame], history: DataFrame, seeds: DataFrame, holds: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the seeds and all that ever shared a path of their source with them, and the ids that went.

    history: source_id, stable_id, path.  Tables are told by (source_id, stable_id), by source_id and path, or by path.
    A hold on any source of the ids refuses the whole.
    """
    ids = erasure_fixpoint(history, seeds)
    if held_by := blocking_holds(ids, holds):
        raise HoldActive(", ".join(held_by))
    paths = history.join(ids, ["source_id", "stable_id"], "left_semi").select("source_id", "path").distinct()
    others = history.join(ids, ["source_id", "stable_id"], "left_anti").select("path").distinct()
    return {k: without(t, ids, paths, others) for k, t in tables.items()}, ids


def without(table: DataFrame, ids: DataFrame, paths: DataFrame, others: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of a table that name none of the ids; a table told by path alone keeps those that another object has too."""
    if {"source_id", "stable_id"} <= set(table.columns):
        return table.join(ids, ["source_id", "stable_id"], how)
    if {"source_id", "path"} <= set(table.columns):
        return table.join(paths, ["source_id", "path"], how)
    if "path" in table.columns:
        return table.join(paths.select("path").distinct().join(others, "path", "left_anti"), "path", how)
    return table if how == "left_anti" else table.limit(0)


def survivors(tables: dict[str, DataFrame], ids: DataFrame, paths: DataFrame, others: DataFrame) -> DataFrame:
    """table, n of rows that an erasure should have taken: none, over every retained snapshot."""
    each = [without(t, ids, paths, others, "left_semi").agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), each).where("n > 0")


def scrubbed(texts: DataFrame, words: list[str]) -> DataFrame:
    """Index-like texts (path, text) without the lines that name any of the words."""
    named = lambda line: reduce(lambda a, b: a | b, [F.contains(line, F.lit(w)) for w in words])
    return texts.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda line: ~named(line)), "\n"))


def purge_queue(queue: DataFrame, holds: DataFrame, keep: DataFrame) -> DataFrame:
    """Entries (source_id, stable_id, reason, seq) once each, the first to come, with what stands against them."""
    once = queue.groupBy("source_id", "stable_id").agg(F.min_by(F.struct("reason", "seq"), "seq").alias("q")).select("source_id", "stable_id", "q.*")
    everything = holds.where("scope = 'all'").limit(1).count() > 0
    scopes = holds.select(F.col("scope").alias("source_id")).distinct().withColumn("__held", F.lit(True))
    under = once.withColumn("__held", F.lit(True)) if everything else once.join(scopes, "source_id", "left")
    kept = keep.select("source_id", "stable_id").distinct().withColumn("__kept", F.lit(True))
    return under.join(kept, ["source_id", "stable_id"], "left").select("source_id", "stable_id", "reason", "seq", F.coalesce("__held", F.lit(False)).alias("held"), F.coalesce("__kept", F.lit(False)).alias("kept"))


def retained(snapshots: DataFrame, today: Column, days: int = 30, slack: int = 7, holds: DataFrame | None = None) -> DataFrame:
    """run_id, day, keep, state of snapshots: those within the days stay, as does the newest before them; with a hold all do.

    state of the whole: ok, due (something is past the days) or overdue (past the slack too).
    """
    on_hold = holds is not None and holds.limit(1).count() > 0
    cut = F.date_sub(today, days)
    base = snapshots.agg(F.max(F.when(F.col("day") < cut, F.col("run_id"))).alias("base"), F.min("day").alias("oldest")).first()  # one row
    oldest = F.lit(base["oldest"]).cast("date")
    state = F.when(oldest < F.date_sub(today, days + slack), "overdue").when(oldest < cut, "due").otherwise("ok")
    keep = F.lit(on_hold) | (F.col("day") >= cut) | (F.col("run_id") == F.lit(base["base"]))
    return snapshots.select("run_id", "day", F.coalesce(keep, F.lit(True)).alias("keep"), state.alias("state"))


def retired(items: DataFrame, outputs: DataFrame, source: str, run_id: int) -> DataFrame:
    """Tombstones of all outputs of a source that is retired; no breaker asks."""
    return outputs.where((F.col("source_id") == source) & (F.col("status") != "tombstone")).select("output_path", "source_id", "stable_id", "unit_id", F.lit(run_id).alias("deleted_run"), F.lit("retired").alias("reason"))


def history_secrets(history: DataFrame) -> DataFrame:
    """run_id, path, rule of secrets in the pages of older snapshots (run_id, path, text)."""
    from tidemark.operators.quality import secret_hits

    keyed = history.withColumn("path", F.concat_ws("\x1f", F.col("run_id").cast("string"), "path"))
    parts = F.split("path", "\x1f")
    return secret_hits(keyed).select(parts[0].cast("bigint").alias("run_id"), parts[1].alias("path"), "rule")


def carried_changes(changes: DataFrame, dirty: DataFrame) -> DataFrame:
    """Changes of an unfinished run whose pages are still not committed."""
    return changes.join(dirty.select("path").distinct(), "path", "left_semi")
