"""Decisions of a cycle: what is work, what is tried again, in which order, and what a run leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import in_scope
from tidemark.operators.classify import KEYS
from tidemark.operators.graph import numbered

#: How often a failed conversion and a failed re-read are tried in later cycles.
CONVERT_RETRIES, REREAD_ATTEMPTS = 2, 2


def work_rows(queue: DataFrame, run_id: int, complete_full: bool, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Queued rows that are work: those that a complete listing missed are deletion candidates, those out of scope are none."""
    seen = queue.where(F.col("last_seen_run") >= run_id) if complete_full else queue
    return seen.where(in_scope("rel_path", list(include), list(exclude)))


def retried(queue: DataFrame, tries: DataFrame, bound: int = CONVERT_RETRIES) -> DataFrame:
    """Rows whose failures with these bytes are under the bound; tries: keys, content_sha256, failures."""
    seen = tries.select(*KEYS, "content_sha256", F.col("failures").alias("__failures"))
    rows = queue.join(seen, [*KEYS, "content_sha256"], "left")
    return rows.where(F.coalesce("__failures", F.lit(0)) <= bound).drop("__failures")


def merged_policies(policies: DataFrame) -> DataFrame:
    """One policy of several (excluded: array, refuse_unlabelled): an exclusion in any of them applies."""
    return policies.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("excluded")))).alias("excluded"), F.bool_or("refuse_unlabelled").alias("refuse_unlabelled"))  # policies are set by hand


def failures_reopened(items: DataFrame, tried: DataFrame, prefix: str, done: bool) -> DataFrame:
    """items with the error verdict on every settled failure that no build with retries has tried; once, then never again."""
    if done:
        return items
    mark = tried.select(*KEYS).distinct().withColumn("__tried", F.lit(True))
    fits = (F.col("state") == "quarantined") & ~F.col("is_dir") & ~F.col("dataless") & F.col("state_reason").startswith(prefix) & F.col("__tried").isNull()
    verdict = F.when(F.coalesce(fits, F.lit(False)) & ~F.col("last_verdict").eqNullSafe("error"), "error").otherwise(F.col("last_verdict"))
    return items.join(mark, list(KEYS), "left").select(*[verdict.alias(c) if c == "last_verdict" else F.col(c) for c in items.columns])


def folder_answers(folders: DataFrame, cloud_roots: list[str], domains: list[str]) -> DataFrame:
    """folders (path, children) with answer: empty, listed, or unknown where a provider may not have listed the children yet.

    A cloud root itself, a path with '..' and all that lies in a provider folder that is a domain are unknown when they
    list nothing.
    """
    under = F.lit(False)
    for root in cloud_roots:
        inside = (F.col("path") == root) | F.col("path").startswith(root + "/")
        provider = F.regexp_extract(F.substr(F.col("path"), F.lit(len(root) + 2)), r"^([^/]*)", 1)
        under = under | (inside & ((provider == "") | F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)") | F.concat(F.lit(root + "/"), provider).isin(*domains)))
    return folders.select("path", F.when(F.col("children") > 0, "listed").when(under, "unknown").otherwise("empty").alias("answer"))


def recording_order(rows: DataFrame, may_download: bool) -> DataFrame:
    """place, source_id, stable_id of recordings in the order in which they are read.

    First what was begun and is on disk, oldest start first; then other files on disk; then online ones, newest first; then
    stubs.  Online ones wait for a run that may download.
    """
    online = F.col("online")
    rank = F.when(~online & F.col("started_run").isNotNull(), 0).when(online, 2).when(F.col("stub"), 3).otherwise(1)
    tie = F.when(rank == 0, F.col("started_run")).when(rank == 2, -F.coalesce("mtime_ns", F.lit(0))).otherwise(0)
    picked = rows.where(~online | F.lit(may_download)).withColumn("__order", F.struct(rank.alias("rank"), tie.alias("tie"), "source_place", "stable_id"))
    return numbered(picked, "__order").select(F.col("place").cast("int").alias("place"), "source_id", "stable_id")


def time_boxed(queue: DataFrame, by: list[str], order: list[str], seconds: str, box_s: int) -> DataFrame:
    """The rows of each group that start before the box is used up: the last to start may run over."""
    before = F.sum(seconds).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return queue.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < box_s).drop("__before")


def newest_first(chains: DataFrame, marks: DataFrame, overlap_ns: int = 300_000_000_000) -> DataFrame:
    """Message chains (source_id, chain, changed_ns) that a newest-first walk reaches before it stops: those at or above the
    high-water mark less the overlap.  A chain without a time never stops the walk and is taken."""
    floor = marks.select("source_id", (F.col("mark_ns") - overlap_ns).alias("__floor"))
    return chains.join(floor, "source_id", "left").where(F.col("__floor").isNull() | F.col("changed_ns").isNull() | (F.col("changed_ns") >= F.col("__floor"))).drop("__floor")


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest n runs of each source, and which of them is its newest full pass."""
    each = W.partitionBy("source_id")
    place = F.row_number().over(each.orderBy(F.desc("run_id")))
    full = F.max(F.when(F.col("pass_kind") == "full_enumeration", F.col("run_id"))).over(each)
    return runs.withColumns({"place": place, "newest_full": full}).where(F.col("place") <= n)


def restored(tombstones: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tombstones whose object lives again (keys of live), and those that stay."""
    keys = live.select(*KEYS).distinct()
    return tombstones.join(keys, list(KEYS), "left_semi"), tombstones.join(keys, list(KEYS), "left_anti")


def without_entry(queue: DataFrame, source_id: str, stable_id: str, reason: str | None = None) -> DataFrame:
    """A queue without one object's entries (of one reason, if given)."""
    hit = (F.col("source_id") == source_id) & (F.col("stable_id") == stable_id)
    if reason is not None:
        hit = hit & (F.col("reason") == reason)
    return queue.where(~F.coalesce(hit, F.lit(False)))


def accepted(events: DataFrame, lost: DataFrame, at: Column) -> DataFrame:
    """The audit trail with an acceptance for each lost record, so that it is lost no more."""
    return events.unionByName(lost.select("fingerprint", at.alias("at"), F.lit("remove").alias("event")))


def checkpoint_step(session: DataFrame, blockers: DataFrame, before: str, pending: str | None) -> dict[str, str | None]:
    """What becomes of the curated pointer: moved, held or untouched, to which snapshot, and what stays pending.

    With pages of a session, or with an earlier held step, and without blockers it moves; the pending base stays until it has.
    """
    wrote = session.limit(1).count() > 0
    if not wrote and pending is None:
        return {"outcome": "untouched", "curated": None, "pending": None}
    if blockers.limit(1).count():
        return {"outcome": "held", "curated": None, "pending": pending or before}
    return {"outcome": "advanced", "curated": before if wrote else pending, "pending": None}


def provenance(items: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """The columns of a page's head that don't move when a file is saved without a change: no version, no tag; the first id."""
    origin = aliases.where("origin").select("source_id", F.col("new_id").alias("stable_id"), F.col("old_id").alias("__first"))
    rows = items.join(origin, list(KEYS), "left").join(sources.select("source_id", "kind"), "source_id", "left")
    graph = F.coalesce(F.col("kind").startswith("graph"), F.lit(False))
    return rows.select(
        "source_id", F.col("kind").alias("source_kind"), F.coalesce("__first", "stable_id").alias("stable_id"), F.col("rel_path").alias("source_path"),
        F.when(graph, F.element_at("extra", F.lit("web_url"))).alias("source_web_url"),
    )


def rewritten_heads(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """old_path, path, text of pages whose source only moved: the head names the new source path, the body stays byte for byte.

    pages: path, text; moves: path, new_path, source_path.
    """
    rows = pages.join(moves.select("path", "new_path", F.col("source_path").alias("__source")), "path")
    end = F.locate("\n---\n", F.col("text"))
    head = F.substr(F.col("text"), F.lit(1), end)
    body = F.substr(F.col("text"), end + 1)
    line = F.concat(F.lit("source_path: "), F.replace(F.replace(F.col("__source"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit("\n"))
    return rows.select(F.col("path").alias("old_path"), F.col("new_path").alias("path"), F.concat(F.regexp_replace(head, F.lit("(?m)^source_path: .*\n"), line), body).alias("text"))


def heartbeat(run_id: int, phase: str, at: Column) -> list[Column]:
    """A line of the heartbeat table: which run, where it is, when."""
    return [F.lit(run_id).cast("bigint").alias("run_id"), F.lit(phase).alias("phase"), at.alias("at")]


def stalled(beats: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Runs whose last heartbeat is older than some seconds and is not their end."""
    last = beats.groupBy("run_id").agg(F.max_by("phase", "at").alias("phase"), F.max("at").alias("at"))
    return last.where((F.col("phase") != "end") & (F.col("at") < now - F.make_dt_interval(secs=F.lit(seconds))))


def report_lines(rows: DataFrame, columns: list[str], as_json: bool) -> DataFrame:
    """line: each row of a report as JSON with its keys in the order given, or as text 'name: value, …' without nulls."""
    if as_json:
        return rows.select(F.to_json(F.struct(*columns)).alias("line"))
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return rows.select(F.concat_ws(", ", *parts).alias("line"))


def pieces_left(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Pieces (sha, piece) of files that no earlier run has finished under the same key; held: sha, piece, key, done."""
    done = held.where("done").select("sha", "piece", "key").distinct()
    return wanted.join(done, ["sha", "piece", "key"], "left_anti")


def pieces_progress(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """sha, pieces, finished, complete of each file that is read in pieces."""
    done = held.where("done").select("sha", "piece", "key").distinct().withColumn("__done", F.lit(1))
    rows = wanted.join(done, ["sha", "piece", "key"], "left")
    return rows.groupBy("sha").agg(F.count("*").alias("pieces"), F.count("__done").alias("finished"), (F.count("*") == F.count("__done")).alias("complete"))


def withheld_suffixes(items: DataFrame, suffixes: list[str], rule_on: bool) -> DataFrame:
    """Rows that wait while a label rule is on, as no reader of labels knows their suffix."""
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | (F.lower("name").endswith(s) & (F.length("name") > len(s)))
    return items.where(hit & F.lit(rule_on))


def sidecar_digests(pages: DataFrame) -> DataFrame:
    """path, name, sha of the sidecars that a page lists in lines '- sidecar: NAME sha256:HEX'."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^- sidecar: (\S.*? sha256:[0-9a-f]{64})$"), F.lit(1))
    each = pages.select("path", F.explode(found).alias("s"))
    return each.select("path", F.regexp_extract("s", r"^(.*) sha256:", 1).alias("name"), F.regexp_extract("s", r"sha256:([0-9a-f]{64})$", 1).alias("sha"))
