"""Relational queries over the state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import fold_copy_suffix, glob_match
from tidemark.functions.text import nfc_fold
from tidemark.operators.classify import KEYS
from tidemark.schemas import PRESENT

LIVE = ("live", "dataless")


def produced_by(items: DataFrame, outputs: DataFrame, cache: DataFrame) -> DataFrame:
    """source_id, converter_id, converter_version, once each, of all outputs; the cache entry's provenance comes first."""
    c = cache.select("action_key", F.col("converter_id").alias("__id"), F.col("converter_version").alias("__version"))
    rows = items.select(*KEYS).join(outputs, list(KEYS)).join(c, "action_key", "left")
    return rows.select("source_id", F.coalesce("__id", "converter_id").alias("converter_id"), F.coalesce("__version", "converter_version").alias("converter_version")).distinct()


def reread_candidates(items: DataFrame, outputs: DataFrame, cache: DataFrame, targets: DataFrame, after: str | None = None, limit: int | None = None) -> DataFrame:
    """Items with an output that a target names, in order of id after a given one.

    targets: converter_id, version ('unavailable' for a converter that could not start), reason (null: pages that are ok),
    suffix.  A small table by nature, one row per converter that changed.
    """
    c = cache.select("action_key", F.col("converter_id").alias("__id"), F.col("converter_version").alias("__version"))
    o = outputs.join(c, "action_key", "left").select(*KEYS, "status", F.coalesce("__id", "converter_id").alias("converter_id"), F.coalesce("__version", "converter_version").alias("version"))
    hits = o.join(targets, ["converter_id", "version"]).select(*KEYS, "status", "version", "reason", "suffix")
    i = items.where(~F.col("is_dir") & ~F.col("dataless"))
    joined = i.join(hits, list(KEYS)).where(F.lower("name").endswith(F.col("suffix")) & (F.length("name") > F.length("suffix")))
    fits = (
        (F.col("reason").isNull() & (F.col("status") == "ok") & (F.col("state") == "live"))
        | ((F.col("reason") == F.col("state_reason")) & (F.col("status") == F.col("state")) & F.col("state").isin("quarantined", "refused"))
        | ((F.col("reason") == F.col("state_reason")) & (F.col("version") == "unavailable") & (F.col("status") == "failed") & (F.col("state") == "quarantined"))
    )
    out = i.join(joined.where(fits).select(*KEYS).distinct(), list(KEYS), "left_semi")
    return keyset_page(out, after, limit)


def keyset_page(rows: DataFrame, after: str | None, limit: int | None, key: str = "stable_id") -> DataFrame:
    """The next rows in order of a key; the limit is the page, the feature itself."""
    out = rows if after is None else rows.where(F.col(key) > after)
    return out if limit is None else out.orderBy(key).limit(limit)


def shared_content_counts(items: DataFrame) -> DataFrame:
    """a, b, n: live files of source a whose content a live file of a later source b has too; each counts once a source."""
    live = items.where(~F.col("is_dir") & F.col("state").isin(*LIVE) & F.col("canonical_sha256").isNotNull()).select("source_id", "canonical_sha256")
    files = live.groupBy("source_id", "canonical_sha256").agg(F.count("*").alias("files"))  # one row a hash and source before they meet
    other = files.select(F.col("source_id").alias("b"), F.col("canonical_sha256"))
    return files.join(other, "canonical_sha256").where("b > source_id").groupBy(F.col("source_id").alias("a"), "b").agg(F.sum("files").alias("n"))


def shard_export(items: DataFrame, outputs: DataFrame, aliases: DataFrame) -> DataFrame:
    """source_id, line: one JSON line per item, keys in order, outputs by unit; an item keeps the id it was first known by."""
    origin = aliases.where("origin").select("source_id", F.col("new_id").alias("stable_id"), F.col("old_id").alias("__first"))
    units = outputs.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("unit_id", "output_path", "rendered_sha256"))).alias("outputs"))  # those of one item
    rows = items.where(~F.col("is_dir")).join(origin, list(KEYS), "left").join(units, list(KEYS), "left")
    state = F.when(F.col("state") == "dataless", "live").otherwise(F.col("state"))
    line = F.to_json(F.struct(F.coalesce("__first", "stable_id").alias("id"), "outputs", F.col("rel_path").alias("path"), "size", state.alias("state")))
    return rows.select("source_id", F.coalesce("__first", "stable_id").alias("id"), line.alias("line"))


def governance_rows(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with their source's kind and state; items of unknown sources too."""
    return items.join(sources.select("source_id", "kind", "config_state"), "source_id", "left")


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select(*KEYS).distinct(), list(KEYS), "left_semi")


def unlisted(items: DataFrame, run_sources: DataFrame) -> DataFrame:
    """Present rows that the newest full pass of their source did not see; a source whose newest full pass failed has none."""
    newest = run_sources.where("pass_kind = 'full_enumeration'").groupBy("source_id").agg(F.max_by(F.struct("run_id", "outcome"), "run_id").alias("p"))
    ok = newest.where("p.outcome = 'ok'").select("source_id", F.col("p.run_id").alias("__run"))
    return items.where(F.col("state").isin(*PRESENT) & ~F.col("is_dir")).join(ok, "source_id").where("last_seen_run < __run").drop("__run")


def suppressed_out(observed: DataFrame, by_id: DataFrame, by_path: DataFrame, globs: list[str], by_hash: DataFrame | None = None) -> DataFrame:
    """Observations that no suppression names: by id, by exact folded path, by glob, or by content (never the empty file)."""
    out = observed.join(by_id.select(*KEYS).distinct(), list(KEYS), "left_anti")
    folded = by_path.select("source_id", nfc_fold("path").alias("__path")).distinct()
    out = out.withColumn("__path", nfc_fold("rel_path")).join(folded, ["source_id", "__path"], "left_anti").select(*observed.columns)
    for g in globs:
        out = out.where(~glob_match("rel_path", g))
    if by_hash is not None:
        known = by_hash.where(F.col("content_sha256") != F.sha2(F.lit("").cast("binary"), 256)).select("content_sha256").distinct()
        out = out.join(known, "content_sha256", "left_anti")
    return out


def vanished_sources(items: DataFrame, configured: DataFrame) -> DataFrame:
    """source_id, n of sources with present rows that the configuration no longer has."""
    return items.where(F.col("state").isin(*PRESENT)).groupBy("source_id").agg(F.count("*").alias("n")).join(configured.select("source_id"), "source_id", "left_anti")


def glob_hits(items: DataFrame, globs: list[str]) -> DataFrame:
    """Items once for each glob that their path matches; globs come from the configuration, so they are in the plan."""
    tests = [F.when(glob_match("rel_path", g), F.lit(g)) for g in globs]
    return items.withColumn("glob", F.explode(F.array_compact(F.array(*tests))))


def inbox_duplicates_by_content(inbox: DataFrame, items: DataFrame) -> DataFrame:
    """Dropped files whose content a live row of another kind of source has: file id and the first such (source, id)."""
    live = items.where(F.col("state").isin(*LIVE) & F.col("canonical_sha256").isNotNull()).groupBy("canonical_sha256").agg(F.min(F.struct("source_id", "stable_id")).alias("first"))
    return inbox.join(live, "canonical_sha256").select(inbox["stable_id"], F.col("first.source_id").alias("twin_source"), F.col("first.stable_id").alias("twin_id"))


def inbox_duplicates_by_name(inbox: DataFrame, items: DataFrame) -> DataFrame:
    """Dropped files with the folded name and size of a live row, found before any byte is read."""
    fold = lambda df: df.withColumn("__name", nfc_fold(fold_copy_suffix("name")))
    live = fold(items.where(F.col("state").isin(*LIVE) & ~F.col("is_dir"))).groupBy("__name", "size").agg(F.min(F.struct("source_id", "stable_id")).alias("first"))
    return fold(inbox).join(live, ["__name", "size"]).select("stable_id", F.col("first.source_id").alias("twin_source"), F.col("first.stable_id").alias("twin_id"))


def first_link(listing: DataFrame) -> DataFrame:
    """One row per object of a listing with hard links: the first path in byte order."""
    first = W.partitionBy(*KEYS).orderBy("rel_path")
    return listing.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def resolved_citations(cites: DataFrame, lines: DataFrame, reach: int = 10) -> DataFrame:
    """cites (page, recording, window, second, channel) with found, and for the lost ones the nearest line within reach.

    lines: recording, window, second, channel.  The hint meets lines in buckets of the reach, so it is an equality join.
    """
    keys = ["recording", "window", "second", "channel"]
    known = lines.select(*keys).distinct()
    hit = cites.join(known.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    lost = hit.where("not found").withColumn("__bucket", F.explode(F.array(*[F.floor(F.col("second") / reach) + k for k in (-1, 0, 1)])))
    near = known.select("recording", "channel", F.col("second").alias("at"), F.floor(F.col("second") / reach).alias("__bucket")).distinct()
    hint = (
        lost.join(near, ["recording", "channel", "__bucket"])
        .where(F.abs(F.col("at") - F.col("second")) <= reach)
        .groupBy("page", *keys)
        .agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("second")), "at")).alias("hint"))
    )
    return hit.join(hint, ["page", *keys], "left").select("page", *keys, "found", "hint")


def lost_records(events: DataFrame, current: DataFrame) -> DataFrame:
    """Additions in the audit trail (fingerprint, at) that neither stand now nor were taken back later."""
    added = events.where("event = 'add'").groupBy("fingerprint").agg(F.max("at").alias("at"))
    back = events.where("event = 'remove'").groupBy("fingerprint").agg(F.max("at").alias("back"))
    open_ = added.join(back, "fingerprint", "left").where("back is null or back < at").select("fingerprint", "at")
    return open_.join(current.select("fingerprint"), "fingerprint", "left_anti")


def newest_at_path(items: DataFrame) -> DataFrame:
    """The row that answers for a path: seen last, then the least id."""
    order = W.partitionBy("source_id", "rel_path").orderBy(F.desc("last_seen_run"), "stable_id")
    return items.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def snapshot_changes(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "sha") -> DataFrame:
    """op (A, M, D), path of what differs between two snapshots; a rename is a D and an A."""
    a, b = old.select(F.col(path).alias("__p"), F.col(digest).alias("__old")), new.select(F.col(path).alias("__q"), F.col(digest).alias("__new"))
    rows = a.join(b, F.col("__p") == F.col("__q"), "full_outer")
    op = F.when(F.col("__p").isNull(), "A").when(F.col("__q").isNull(), "D").when(~F.col("__old").eqNullSafe(F.col("__new")), "M")
    return rows.select(op.alias("op"), F.coalesce("__q", "__p").alias(path)).where("op is not null")


def one_change_per_page(changes: DataFrame) -> DataFrame:
    """seq, op, path, source_id, stable_id, prev_path with one A or M a page at its first place, an A if there was one."""
    keys = ["path", "source_id", "stable_id", "prev_path"]
    once = changes.where("op in ('A', 'M')").groupBy(*keys).agg(F.min("seq").alias("seq"), F.min("op").alias("op"))
    shown = ["seq", "op", *keys]
    return once.select(*shown).unionByName(changes.where("op not in ('A', 'M')").select(*shown))


def orphan_pages(pages: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pages that no output row owns, by folded path."""
    owned = outputs.select(nfc_fold("output_path").alias("__key")).distinct()
    return pages.withColumn("__key", nfc_fold("page")).join(owned, "__key", "left_anti").select(*pages.columns)


def broken_items(outputs: DataFrame, pages: DataFrame) -> DataFrame:
    """Items of which a page is gone or isn't what its row says."""
    rows = outputs.where("status <> 'tombstone'").join(pages.select(F.col("page").alias("output_path"), "sha"), "output_path", "left")
    return rows.groupBy(*KEYS).agg(F.bool_and(F.col("sha").eqNullSafe(F.col("page_sha256"))).alias("whole")).where("not whole").select(*KEYS)


def status_rows(sources: DataFrame, items: DataFrame, tombstones: DataFrame, runs: DataFrame) -> DataFrame:
    """A wide row per source: counts by state, tombstones, newest run."""
    by = items.where(~F.col("is_dir")).groupBy("source_id").agg(
        *[F.count_if(F.col("state") == x).alias(f"n_{x}") for x in (*PRESENT, "tombstone")], F.count_if(F.col("last_verdict") == "deferred").alias("n_deferred")
    )
    t = tombstones.groupBy("source_id").agg(F.count("*").alias("n_pages_gone"))
    r = runs.groupBy("source_id").agg(F.max("run_id").alias("last_run"))
    out = sources.select("source_id").join(by, "source_id", "left").join(t, "source_id", "left").join(r, "source_id", "left")
    return out.na.fill(0, [c for c in out.columns if c.startswith("n_")])


def source_health(sources: DataFrame, status: DataFrame, runs: DataFrame, now: Column, late_s: int = 86_400) -> DataFrame:
    """A source's wide status row with how fresh it is, whether a breaker holds its deletions, and whether it has a baseline.

    sources: config_state, baseline_complete, breaker_until and breaker_candidates as in the state; status: status_rows; runs: source_id,
    finished_at, outcome.  health: retired, held (by the breaker), no-baseline, never (no good run), late, ok; the first that holds.
    """
    good = runs.groupBy("source_id").agg(F.max(F.when(F.col("outcome") == "ok", F.col("finished_at"))).alias("last_ok"), F.max_by("outcome", "finished_at").alias("last_outcome"))
    rows = sources.select("source_id", "config_state", "baseline_complete", "breaker_until", "breaker_candidates").join(status, "source_id", "left").join(good, "source_id", "left")
    age = (F.unix_seconds(now) - F.unix_seconds("last_ok")).alias("age_s")
    held = F.coalesce(F.col("breaker_until") > now, F.lit(False))
    health = (
        F.when(F.col("config_state") == "retired", "retired").when(held, "held").when(~F.coalesce("baseline_complete", F.lit(False)), "no-baseline").when(F.col("last_ok").isNull(), "never")
        .when(age > late_s, "late").otherwise("ok")
    )
    counts = [c for c in status.columns if c != "source_id"]
    return rows.select("source_id", *counts, "last_outcome", age, held.alias("held"), F.when(held, F.col("breaker_candidates")).alias("held_candidates"), health.alias("health"))


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Ids for wanted bases (base, place): the base, or base-2, base-3 … clear of the ids that are taken."""
    used = taken.select(F.regexp_extract("id", r"^(.*?)(?:-([0-9]+))?$", 1).alias("base"), F.coalesce(F.regexp_extract("id", r"-([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("k"))
    top = used.groupBy("base").agg(F.max("k").alias("top"))
    n = F.row_number().over(W.partitionBy("base").orderBy("place")) + F.coalesce("top", F.lit(0))
    return wanted.join(top, "base", "left").withColumn("k", n).select("base", "place", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("id"))


def merged_log(first: DataFrame, second: DataFrame) -> DataFrame:
    """line, side, place: the lines of one log (place, line) in order, then those of the other that it lacks."""
    missing = second.join(first.select("line").distinct(), "line", "left_anti")
    once = missing.groupBy("line").agg(F.min("place").alias("place"))
    return first.select("line", F.lit(1).alias("side"), "place").unionByName(once.select("line", F.lit(2).alias("side"), "place"))
