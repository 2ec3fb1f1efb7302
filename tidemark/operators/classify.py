"""What changed: ordered metadata (H0), content (H1) and output (H2) tests over observed and stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.functions.text import nfc
from tidemark.schemas import PENDING, QUIET

KEYS = ("source_id", "stable_id")
STAT = ("size", "mtime_ns", "ctime_ns", "ino", "mode")
NAMES = {"mtime_ns": "mtime", "ctime_ns": "ctime"}
#: What an upsert would write: all equal means that nothing is to be written.
WRITTEN = (
    "rel_path", "name", *STAT, "gen_count", "created_ns", "parent_id", "etag", "ctag", "content_type", "quickxor", "sha1", "sha256_remote",
)


def o(name: str) -> Column:
    return F.col(f"o.{name}")


def s(name: str) -> Column:
    return F.col(f"s.{name}")


def outcome(verdict: str, reason: str | Column) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def last_record_wins(df: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "seq") -> DataFrame:
    """The record of each key that arrived last; equal places are settled by all other columns."""
    rest = [c for c in df.columns if c not in (*keys, order) and not df.schema[c].dataType.typeName() == "map"]
    latest = W.partitionBy(*keys).orderBy(F.col(order).desc(), *[F.col(c).desc() for c in rest])
    return df.withColumn("__place", F.row_number().over(latest)).where("__place = 1").drop("__place")


def both_sides(observed: DataFrame, stored: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """observed (alias o) full-outer stored (alias s); each key is once on either side."""
    on = [F.col(f"o.{k}") == F.col(f"s.{k}") for k in keys]
    return observed.alias("o").join(stored.alias("s"), on, "full_outer")


def content_rungs(written_at_ns: int) -> Column:
    """The first rung that decides, for an object with a stored row: struct(verdict, reason)."""
    both = lambda c: o(c).isNotNull() & s(c).isNotNull()
    hold = o("size").eqNullSafe(s("size")) & o("mtime_ns").eqNullSafe(s("mtime_ns"))
    rungs = F.when(o("dataless"), outcome("dataless", "dataless"))
    for c in ("quickxor", "sha1", "ctag"):
        rungs = rungs.when(both(c) & (o(c) == s(c)), outcome("unchanged", f"{c}-equal")).when(both(c), outcome("maybe_changed", f"{c}-differs"))
    moved = both("etag") & (o("etag") != s("etag"))
    rungs = rungs.when(moved & hold, outcome("metadata_only", "etag-moved")).when(moved, outcome("maybe_changed", "etag-moved+size-or-mtime-differs"))
    rungs = rungs.when(both("etag") & hold, outcome("unchanged", "etag-equal"))
    for c in STAT:
        rungs = rungs.when(~o(c).eqNullSafe(s(c)), outcome("maybe_changed", f"stat-differs:{NAMES.get(c, c)}"))
    unknown = (F.coalesce(o("gen_count"), F.lit(0)) == 0) | (F.coalesce(s("gen_count"), F.lit(0)) == 0)
    return (
        rungs.when(unknown, outcome("maybe_changed", "gen-count-unknown"))
        .when(o("gen_count") < s("gen_count"), outcome("maybe_changed", "gen-count-decreased"))
        .when(o("gen_count") != s("gen_count"), outcome("maybe_changed", "gen-count-differs"))
        .when(s("mtime_ns").isNull() | (s("mtime_ns") >= written_at_ns), outcome("maybe_changed", "racily-clean"))
        .otherwise(outcome("unchanged", "stat-equal"))
    )


def h0_equal(written_at_ns: int, rung: Column | None = None) -> Column:
    """True only where a pass would write nothing but when the row was seen; rung: content_rungs, where there is one."""
    rung = content_rungs(written_at_ns) if rung is None else rung
    plain = ~(o("deleted") | o("is_dir") | o("dataless") | s("is_dir") | s("dataless"))
    settled = s("state").isin("live", "quarantined", "refused") & ~F.coalesce(s("last_verdict"), F.lit("")).isin(*PENDING)
    has_content = s("content_sha256").isNotNull() | (s("state") != "live")
    same = F.lit(True)
    for c in WRITTEN:
        same = same & o(c).eqNullSafe(s(c))
    return F.coalesce(plain & settled & has_content & same & (rung["verdict"] == "unchanged"), F.lit(False))


def with_verdict(pairs: DataFrame, written_at_ns: int, fast: bool = False) -> DataFrame:
    """The joined sides with v: struct(verdict, reason, prev_path) of each observed object.

    Each step is a column of its own, so that the tests are evaluated once and not once for each use.  With fast, rows
    that a pass need not write are answered by the fast path.
    """
    new = s("stable_id").isNull()
    prev = F.when(~o("rel_path").eqNullSafe(s("rel_path")), s("rel_path"))
    tombstone = s("state") == "tombstone"
    pairs = pairs.withColumn("__rung", content_rungs(written_at_ns))
    rung = F.col("__rung")
    etag_moved = o("etag").isNotNull() & s("etag").isNotNull() & (o("etag") != s("etag"))
    extra = F.concat(F.when(prev.isNotNull(), "+renamed").otherwise(""), F.when(etag_moved & (rung["verdict"] == "unchanged"), "+etag-moved").otherwise(""))
    pairs = pairs.withColumn("__extra", extra)
    moved = rung["verdict"].isin("unchanged", "metadata_only") & (F.col("__extra") != "")
    shifted = F.when(moved, F.struct(F.lit("metadata_only").alias("verdict"), F.concat(rung["reason"], F.col("__extra")).alias("reason"))).otherwise(rung)
    pairs = pairs.withColumn("__shifted", shifted)
    shifted, last = F.col("__shifted"), F.coalesce(s("last_verdict"), F.lit(""))
    quiet = shifted["verdict"].isin(*QUIET)
    carried = F.struct(F.when(last == "created", "created").otherwise("maybe_changed").alias("verdict"), F.concat(F.lit("pending:"), last).alias("reason"))
    never = (shifted["verdict"] != "dataless") & s("content_sha256").isNull() & s("state").isin("live", "dataless")
    settled = F.when(quiet & last.isin(*PENDING), carried).when(quiet & never, outcome("maybe_changed", "never-materialised")).otherwise(shifted)
    folder = (
        F.when(tombstone, outcome("metadata_only", "reappeared"))
        .when(prev.isNotNull(), outcome("metadata_only", "renamed"))
        .when(~o("parent_id").eqNullSafe(s("parent_id")) | ~o("name").eqNullSafe(s("name")), outcome("metadata_only", "moved"))
        .otherwise(outcome("unchanged", "dir"))
    )
    gone = F.when(new, "deleted-unseen").when(tombstone, "already-tombstoned").otherwise("provider-tombstone")
    deleted = F.struct(F.lit("deleted").alias("verdict"), gone.alias("reason"))
    found = F.when(h0_equal(written_at_ns, rung), outcome("unchanged", "h0-equal")).when(o("deleted"), deleted) if fast else F.when(o("deleted"), deleted)
    found = found.when(new, outcome("created", "new-id")).when(o("is_dir"), folder).when(tombstone, outcome("maybe_changed", "reappeared")).otherwise(settled)
    pairs = pairs.withColumn("__found", found)
    v = F.struct(F.col("__found.verdict").alias("verdict"), F.col("__found.reason").alias("reason"), F.when(~new & ~o("deleted"), prev).alias("prev_path"))
    return pairs.withColumn("v", v)


def classify_observed(observed: DataFrame, stored: DataFrame, written_at_ns: int) -> DataFrame:
    """source_id, stable_id, verdict, reason, prev_path of every observed object, from its last record."""
    pairs = both_sides(last_record_wins(observed), stored).where(o("stable_id").isNotNull())
    return with_verdict(pairs, written_at_ns).select(o("source_id").alias("source_id"), o("stable_id").alias("stable_id"), "v.verdict", "v.reason", "v.prev_path")


def classify_content(rows: DataFrame) -> DataFrame:
    """H1 over rows with stored_* and new_* canonical hash, method and parts, and state: verdict, reason, changed parts.

    Parts are maps from part name to digest.
    """
    old, new = F.coalesce(F.col("stored_parts"), F.create_map().cast("map<string,string>")), F.coalesce(F.col("new_parts"), F.create_map().cast("map<string,string>"))
    names = F.array_union(F.map_keys(old), F.map_keys(new))
    changed = F.array_sort(F.filter(names, lambda k: ~F.element_at(old, k).eqNullSafe(F.element_at(new, k))))
    found = (
        F.when(F.col("state").isNull(), outcome("changed", "no-row"))
        .when(F.col("stored_sha256").isNull(), outcome("changed", "no-previous-canonical"))
        .when(F.col("state") == "tombstone", outcome("changed", "reappeared"))
        .when(F.col("stored_method").isNotNull() & (F.col("stored_method") != F.col("new_method")), outcome("changed", "canonical-method-changed"))
        .when(F.col("stored_sha256") == F.col("new_sha256"), outcome("touched_not_changed", "canonical-equal"))
        .otherwise(outcome("changed", "canonical-differs"))
    )
    parts = F.when(found["reason"] == "canonical-differs", changed).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("__h1", found).withColumn("changed_parts", parts).select("*", "__h1.verdict", "__h1.reason").drop("__h1")


def classify_output(previous: DataFrame, produced: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """H2 per item: output_unchanged if all earlier outputs were ok and the units and their hashes are the same.

    previous: keys, unit_id, rendered_sha256, status; produced: keys, unit_id, rendered_sha256, ok.
    """
    unit = F.struct("unit_id", "rendered_sha256")
    old = previous.where("status <> 'tombstone'").groupBy(*keys).agg(F.array_sort(F.collect_list(unit)).alias("old"), F.bool_and(F.col("status") == "ok").alias("all_ok"))
    new = produced.groupBy(*keys).agg(
        F.array_sort(F.collect_list(unit)).alias("new"), F.bool_and("ok").alias("ok"), (F.count("*") == F.count_distinct("unit_id")).alias("once")
    )  # units of one item are few
    same = F.col("ok") & F.col("once") & F.coalesce(F.col("all_ok"), F.lit(False)) & (F.col("old") == F.col("new"))
    return new.join(old, list(keys), "left").select(*keys, F.when(F.coalesce(same, F.lit(False)), "output_unchanged").otherwise("changed").alias("verdict"))


def unseen(stored: DataFrame, observed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Present rows that are no folders and that a pass did not list."""
    rows = stored.where(~F.col("is_dir") & (F.col("state") != "tombstone"))
    return rows.join(observed.select(*keys).distinct(), list(keys), "left_anti")


#: Answers of a folder after which nothing is known of what lies below it.
UNKNOWN = ("refused", "unread", "volume", "unknown")


def nearest_unknown(rows: DataFrame, answers: DataFrame, salts: int = 16) -> DataFrame:
    """rows (source_id, stable_id, rel_path …) with folder, the nearest folder above of which nothing is known, or null.

    answers: source_id, path ('' is the root), status.  Every folder above a row is looked up by one equality join, at any depth; as all rows of a
    source share its root, the few unknown folders are copied under some salts.
    """
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    salt = F.pmod(F.xxhash64("stable_id"), F.lit(salts)).cast("int")
    probes = rows.where("rel_path is not null").select(*KEYS, salt.alias("__salt"), F.explode(above).alias("path"))
    blind = answers.where(F.col("status").isin(*UNKNOWN)).select("source_id", "path").distinct()
    blind = blind.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = probes.join(blind, ["source_id", "path", "__salt"]).groupBy(*KEYS).agg(F.max_by("path", F.length("path")).alias("folder"))
    return rows.join(hit, list(KEYS), "left")


def absent_or_unknown(stored: DataFrame, listed: DataFrame, answers: DataFrame) -> DataFrame:
    """source_id, stable_id, rel_path, verdict, folder of stored rows that a pass did not list.

    A row under a folder of which nothing is known (nearest_unknown) is ``unknown`` and names it; all others are ``missing`` and may count as
    deleted, those without a path too.
    """
    rows = stored.select(*KEYS, "rel_path").join(listed.select(*KEYS).distinct(), list(KEYS), "left_anti")
    return nearest_unknown(rows, answers).select(*KEYS, "rel_path", F.when(F.col("folder").isNull(), "missing").otherwise("unknown").alias("verdict"), "folder")


def safe_saves(created: DataFrame, missing: DataFrame) -> DataFrame:
    """source_id, new_id, old_id: a new id at the path of one that vanished.

    A path (composed) with two new ids pairs nothing, nor does one whose newest vanished rows tie.
    """
    created, missing = (df.withColumn("rel_path", nfc("rel_path")) for df in (created, missing))
    at = ("source_id", "rel_path")
    news = created.where(~F.col("is_dir") & ~F.col("deleted")).groupBy(*at).agg(F.min("stable_id").alias("new_id"), F.max("stable_id").alias("__other")).where("new_id = __other")
    newest = missing.where(~F.col("is_dir") & (F.col("state") != "tombstone")).groupBy(*at).agg(F.max("last_seen_run").alias("last_seen_run"))
    olds = missing.where(~F.col("is_dir") & (F.col("state") != "tombstone")).join(newest, [*at, "last_seen_run"], "left_semi")
    olds = olds.groupBy(*at).agg(F.min("stable_id").alias("old_id"), F.count("*").alias("n")).where("n = 1")
    return news.join(olds, list(at)).where("new_id <> old_id").select("source_id", "new_id", "old_id")


def pass_rows(observed: DataFrame, stored: DataFrame, written_at_ns: int, busy: bool = True) -> DataFrame:
    """What a pass has to look at, from one outer join: observed objects with their verdicts, and present rows that were not listed.

    busy leaves out what the fast path answers, unless it was marked absent: no row of it is to be written.

    source_id, stable_id, listed, is_dir, deleted, path, verdict, reason, prev_path, old_path, last_seen_run.
    """
    pairs = both_sides(last_record_wins(observed), stored)
    here = o("stable_id").isNotNull()
    missing = ~here & ~s("is_dir") & (s("state") != "tombstone")
    look = (F.col("v.reason") != "h0-equal") | s("absent_since_run").isNotNull() if busy else F.lit(True)
    judged = with_verdict(pairs, written_at_ns, fast=True).where((here & look) | missing)
    said = lambda c: F.when(here, F.col(f"v.{c}")).alias(c)
    return judged.select(
        *[F.coalesce(o(k), s(k)).alias(k) for k in KEYS], here.alias("listed"), F.coalesce(o("is_dir"), s("is_dir")).alias("is_dir"), F.coalesce(o("deleted"), F.lit(False)).alias("deleted"),
        o("rel_path").alias("path"), said("verdict"), said("reason"), said("prev_path"), s("rel_path").alias("old_path"), s("last_seen_run").alias("last_seen_run"),
    )


def settle_pass(
    rows: DataFrame, live: DataFrame, full: bool, complete: bool, fraction: str = "0.20", floor: int = 25, answers: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts (with safe-save pairs applied), deletion candidates and breakers of pass_rows; live: source_id, live (its present rows).

    answers: what folders answered (nearest_unknown); a row under one of which nothing is known is not missing.
    Only objects that are new or gone are normalised for pairing, never the listing.
    """
    new = rows.where("listed and verdict = 'created'").select(*KEYS, "is_dir", "deleted", F.col("path").alias("rel_path"))
    missing = rows.where("not listed").select(*KEYS, "is_dir", F.col("old_path").alias("rel_path"), "last_seen_run", F.lit("live").alias("state"))
    if answers is not None:
        missing = nearest_unknown(missing, answers).where("folder is null").drop("folder")
    if full and not new.isEmpty() and not missing.isEmpty():
        saves = materialize(safe_saves(new, missing), "saves")
    else:  # a pair takes a new id and a missing one
        saves = rows.select("source_id", F.col("stable_id").alias("new_id"), F.col("stable_id").alias("old_id")).limit(0)
    paired = rows.where("listed").join(saves.withColumnRenamed("new_id", "stable_id"), list(KEYS), "left")
    saved = F.col("old_id").isNotNull()
    verdicts = paired.select(
        *KEYS, F.when(saved, "maybe_changed").otherwise(F.col("verdict")).alias("verdict"), F.when(saved, "safe-save").otherwise(F.col("reason")).alias("reason"), "prev_path", F.col("old_id").alias("replaces_id")
    )
    candidates = missing.join(saves.select("source_id", F.col("old_id").alias("stable_id")), list(KEYS), "left_anti").where(F.lit(full and complete)).select(*KEYS)
    counted = candidates.groupBy("source_id").agg(F.count("*").alias("candidates"))
    breaker = live.join(counted, "source_id", "full_outer").select("source_id", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return verdicts, candidates, breaker.withColumn("tripped", breaker_trips(F.col("candidates"), F.col("live"), fraction, floor))


def live_rows(stored: DataFrame) -> DataFrame:
    """source_id, live: the rows that a deletion breaker counts."""
    return stored.where(F.col("state").isin("live", "dataless") & ~F.col("is_dir")).groupBy("source_id").agg(F.count("*").alias("live"))


def breaker_trips(candidates: Column, live: Column, fraction: str = "0.20", floor: int = 25) -> Column:
    """More candidates than the larger of a fraction of the live rows and the floor, in exact decimals."""
    limit = F.greatest(F.lit(fraction).cast("decimal(9,6)") * live.cast("decimal(19,0)"), F.lit(floor).cast("decimal(29,6)"))
    return candidates.cast("decimal(29,6)") > limit


def classify_pass(
    observed: DataFrame, stored: DataFrame, written_at_ns: int, full: bool, complete: bool, fraction: str = "0.20", floor: int = 25
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole pass: verdicts (with safe-save pairs applied), deletion candidates, and per source whether the breaker holds.

    The fast path takes equal rows out before the ordered tests; both meet in one join.
    """
    return settle_pass(pass_rows(observed, stored, written_at_ns, busy=False), live_rows(stored), full, complete, fraction, floor)
