"""State as immutable snapshots: each function takes the tables of one run and returns those of the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.classify import KEYS, both_sides, last_record_wins, o, s
from tidemark.schemas import PENDING

#: What an online-only object keeps from its stored row.
KEPT_WHEN_DATALESS = ("size", "mtime_ns", "ctime_ns", "ino", "mode", "gen_count")
CONTENT = ("content_sha256", "canonical_sha256", "canonical_method")


def upsert(stored: DataFrame, observed: DataFrame, verdicts: DataFrame, run_id: int) -> DataFrame:
    """The next items table: stored rows, changed or added to by the observations of a pass and their verdicts.

    A provider's deletion changes verdict, state and time seen only; an online-only object keeps its stat columns; a
    reappeared one loses its content hashes; a moved one remembers its path; a reason lasts while the state does.
    """
    seen = last_record_wins(observed).join(verdicts.select(*KEYS, "verdict"), list(KEYS))
    gone, back = o("deleted"), (s("state") == "tombstone") & ~o("deleted")
    state = F.when(gone, "tombstone").when(o("dataless"), "dataless").when(s("state").isNull() | back, "live").when(s("state") == "dataless", "live").otherwise(s("state"))
    here = o("stable_id").isNotNull()

    def value(c: str) -> Column:
        if c in KEYS:
            return F.coalesce(s(c), o(c))
        if c == "state":
            return F.when(here, state).otherwise(s(c))
        if c == "state_reason":
            return F.when(here & ~state.eqNullSafe(s("state")), F.lit(None).cast("string")).otherwise(s(c))
        if c == "last_verdict":
            return F.when(here, o("verdict")).otherwise(s(c))
        if c == "last_seen_run":
            return F.when(here, F.lit(run_id).cast("bigint")).otherwise(s(c))
        if c == "first_seen_run":
            return F.coalesce(s(c), F.lit(run_id).cast("bigint"))
        if c == "absent_since_run":
            return F.when(here, F.lit(None).cast("bigint")).otherwise(s(c))
        if c == "prev_path":
            return F.when(here & ~gone & s("rel_path").isNotNull() & ~o("rel_path").eqNullSafe(s("rel_path")), s("rel_path")).otherwise(s(c))
        if c in CONTENT:
            return F.when(here & back, F.lit(None).cast("string")).otherwise(s(c))
        if c not in observed.columns:
            return s(c)
        keep = gone & s("stable_id").isNotNull()
        if c in KEPT_WHEN_DATALESS:
            keep = keep | (o("dataless") & s("stable_id").isNotNull())
        return F.when(here & ~keep, o(c)).otherwise(s(c))

    pairs = both_sides(seen, stored).where(s("stable_id").isNotNull() | ~o("deleted"))
    return pairs.select(*[value(c).alias(c) for c in stored.columns])


def touch(stored: DataFrame, seen: DataFrame, run_id: int, verdict: str | None = None) -> DataFrame:
    """Rows that were seen get the run and, if given, the verdict; nothing else moves."""
    mark = seen.select(*KEYS).distinct().withColumn("__seen", F.lit(True))
    hit = F.coalesce("__seen", F.lit(False))
    joined = stored.join(mark, list(KEYS), "left")
    last = F.when(hit, F.lit(verdict)).otherwise(F.col("last_verdict")) if verdict else F.col("last_verdict")
    own = {"last_seen_run": F.when(hit, F.lit(run_id).cast("bigint")).otherwise(F.col("last_seen_run")), "last_verdict": last}
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in stored.columns])


def rekey(items: DataFrame, children: dict[str, DataFrame], pairs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Safe-save pairs (source_id, new_id, old_id): the new row takes the old one's content, quarantine and first run;
    outputs and tombstones move to the new id; the old row goes; an alias remembers it, and older aliases follow."""
    old = items.select("source_id", F.col("stable_id").alias("old_id"), *[F.col(c).alias(f"__{c}") for c in (*CONTENT, "first_seen_run", "state", "state_reason")])
    moved = pairs.join(old, ["source_id", "old_id"]).withColumnRenamed("new_id", "stable_id")
    joined = items.join(moved, list(KEYS), "left").join(pairs.select("source_id", F.col("old_id").alias("stable_id")), list(KEYS), "left_anti")
    hit = F.col("old_id").isNotNull()
    own = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in CONTENT}
    own["first_seen_run"] = F.least("first_seen_run", "__first_seen_run")
    for c in ("state", "state_reason"):
        own[c] = F.when(hit & (F.col("__state") == "quarantined"), F.col(f"__{c}")).otherwise(F.col(c))
    out = joined.select(*[own.get(c, F.col(c)).alias(c) for c in items.columns])
    target = pairs.select("source_id", F.col("old_id").alias("stable_id"), F.col("new_id").alias("__to"))
    kids = {k: df.join(target, list(KEYS), "left").select(*[F.coalesce("__to", c).alias(c) if c == "stable_id" else F.col(c) for c in df.columns]) for k, df in children.items()}
    follow = aliases.join(pairs.select("source_id", F.col("old_id").alias("new_id"), F.col("new_id").alias("__to")), ["source_id", "new_id"], "left").select(
        "source_id", "old_id", F.coalesce("__to", "new_id").alias("new_id"), "origin"
    )
    first = pairs.join(aliases.where("origin").select("source_id", F.col("new_id").alias("old_id")), ["source_id", "old_id"], "left_anti").withColumn("origin", F.lit(True))
    later = pairs.join(first, ["source_id", "old_id"], "left_anti").withColumn("origin", F.lit(False))
    return out, kids, follow.unionByName(first.unionByName(later).select("source_id", "old_id", "new_id", "origin"))


def mark_absent(items: DataFrame, missing: DataFrame, run_id: int) -> DataFrame:
    """The first run in which a row was missing; rows that are not missing are cleared."""
    mark = missing.select(*KEYS).distinct().withColumn("__absent", F.lit(True))
    first = F.when(F.col("__absent"), F.coalesce("absent_since_run", F.lit(run_id).cast("bigint")))
    return items.join(mark, list(KEYS), "left").select(*[first.alias(c) if c == "absent_since_run" else F.col(c) for c in items.columns])


def confirmed_absent(items: DataFrame, missing: DataFrame, run_id: int, two_pass: Column) -> DataFrame:
    """Missing rows whose deletion stands: at once, or where ``two_pass`` holds only if an earlier run missed them too."""
    rows = items.join(missing.select(*KEYS).distinct(), list(KEYS), "left_semi")
    return rows.where(~two_pass | (F.coalesce("absent_since_run", F.lit(run_id)) < run_id))


def replace_outputs(outputs: DataFrame, produced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outputs with those of the items in ``produced`` replaced, and the units that vanished by it."""
    items = produced.select(*KEYS).distinct()
    vanished = outputs.join(items, list(KEYS), "left_semi").join(produced.select(*KEYS, "unit_id"), [*KEYS, "unit_id"], "left_anti")
    return outputs.join(items, list(KEYS), "left_anti").unionByName(produced), vanished


def tombstones_written(removed: DataFrame, run_id: int, day: Column, days: int = 180) -> DataFrame:
    return removed.withColumn("deleted_at", day).withColumn("deleted_run", F.lit(run_id).cast("bigint")).withColumn("reap_after", F.date_add(day, days))


def tombstones_due(tombstones: DataFrame, live_outputs: DataFrame, today: Column) -> DataFrame:
    """path and action of tombstones to reap: the page goes, or only the row where a live output has the path again."""
    due = tombstones.where(F.col("reap_after") <= today)
    live = live_outputs.select("output_path").distinct().withColumn("__live", F.lit(True))
    return due.join(live, "output_path", "left").select("output_path", F.when(F.col("__live"), "row").otherwise("page").alias("action"))


def upsert_sources(sources: DataFrame, configured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next sources table, and the ids whose scope changed (their passes are no baseline and their cursors go)."""
    new = configured.select("source_id", "kind", F.col("config_state").alias("__state"), F.col("config_fingerprint").alias("__print"))
    joined = sources.alias("s").join(new.withColumnRenamed("kind", "__kind"), "source_id", "full_outer")
    changed = F.col("__print").isNotNull() & F.col("config_fingerprint").isNotNull() & (F.col("__print") != F.col("config_fingerprint"))
    own = {
        "kind": F.coalesce("kind", "__kind"),
        "config_state": F.coalesce("__state", "config_state"),
        "config_fingerprint": F.coalesce("__print", "config_fingerprint"),
        "enumeration_complete": F.coalesce("enumeration_complete", F.lit(False)) & ~changed,
        "baseline_complete": F.coalesce("baseline_complete", F.lit(False)) & ~changed,
    }
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in sources.columns]), joined.where(changed).select("source_id")


def stage_cursors(cursors: DataFrame, fresh: DataFrame, run_id: int) -> DataFrame:
    """New tokens (source_id, token) wait beside the old ones until the run is published."""
    joined = cursors.join(fresh, "source_id", "full_outer")
    own = {"pending_token": F.coalesce("token", "pending_token"), "pending_run": F.when(F.col("token").isNotNull(), F.lit(run_id).cast("bigint")).otherwise(F.col("pending_run"))}
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in cursors.columns])


def promote_cursors(cursors: DataFrame, run_id: int, published: bool) -> DataFrame:
    """After publication the run's waiting tokens count; after a failure they are dropped."""
    mine = F.col("pending_run") == run_id
    own = {
        "current_token": F.when(mine & F.lit(published), F.col("pending_token")).otherwise(F.col("current_token")),
        "pending_token": F.when(mine, None).otherwise(F.col("pending_token")),
        "pending_run": F.when(mine, None).otherwise(F.col("pending_run")),
    }
    return cursors.select(*[own.get(c, F.col(c)).alias(c) for c in cursors.columns])


def breaker_state(sources: DataFrame, passes: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """passes: source_id, candidates, tripped.  A trip starts a hold of some days; a clean pass ends it."""
    joined = sources.join(passes.select("source_id", "candidates", "tripped"), "source_id", "left")
    on, off = F.coalesce("tripped", F.lit(False)), ~F.coalesce("tripped", F.lit(True))
    own = {
        "breaker_tripped_at": F.when(on, F.coalesce("breaker_tripped_at", now)).when(off, None).otherwise(F.col("breaker_tripped_at")),
        "breaker_until": F.when(on, now + F.make_dt_interval(F.lit(days))).when(off, None).otherwise(F.col("breaker_until")),
        "breaker_candidates": F.when(on, F.col("candidates")).when(off, None).otherwise(F.col("breaker_candidates")),
    }
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in sources.columns])


def breaker_active(sources: DataFrame, now: Column) -> DataFrame:
    return sources.where(F.col("breaker_until") > now)


def rescreen(items: DataFrame, suffixes: list[str]) -> DataFrame:
    """After a rule change: rows of those suffixes are read again; a refusal lasts until they are."""
    ends = F.lit(False)
    for x in suffixes:
        ends = ends | F.lower("name").endswith(x)
    hit = ends & (F.col("state").isin("live", "dataless") | ((F.col("state") == "refused") & F.col("state_reason").startswith("refused: ")))
    own = {c: F.when(hit, F.lit(None).cast(items.schema[c].dataType)).otherwise(F.col(c)) for c in (*CONTENT, "canonical_parts") if c in items.columns}
    own["last_verdict"] = F.when(hit, "maybe_changed").otherwise(F.col("last_verdict"))
    return items.select(*[own.get(c, F.col(c)).alias(c) for c in items.columns])


def forget(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select(*KEYS).distinct(), list(KEYS), "left_anti")


def cache_missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Units to convert: those whose key the cache lacks, or holds with a body that is not what its digest says."""
    good = cache.where(F.sha2(F.col("body").cast("binary"), 256) == F.col("body_sha256")).select("action_key")
    return wanted.join(good, "action_key", "left_anti")


def cache_put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Write-once: an entry that is there stays."""
    once = fresh.dropDuplicates(["action_key"]).join(cache.select("action_key"), "action_key", "left_anti")
    return cache.unionByName(once.select(*cache.columns))


def cache_gc(cache: DataFrame, outputs: DataFrame) -> DataFrame:
    """Entries that an output that is no tombstone still names."""
    live = outputs.where("status <> 'tombstone' and action_key is not null").select("action_key").distinct()
    return cache.join(live, "action_key", "left_semi")


def pending_work(items: DataFrame) -> DataFrame:
    """Rows with work left: a pending verdict, or online-only and never read."""
    work = F.col("last_verdict").isin(*PENDING) | ((F.col("last_verdict") == "dataless") & F.col("content_sha256").isNull())
    return items.where(~F.col("is_dir") & (F.col("state") != "tombstone") & work)


def set_content(items: DataFrame, read: DataFrame) -> DataFrame:
    """read: keys, content_sha256, canonical_sha256, canonical_method, verdict of the rows whose bytes were read."""
    new = read.select(*KEYS, *[F.col(c).alias(f"__{c}") for c in (*CONTENT, "verdict")])
    own = {c: F.coalesce(f"__{c}", c) for c in CONTENT} | {"last_verdict": F.coalesce("__verdict", "last_verdict")}
    return items.join(new, list(KEYS), "left").select(*[own.get(c, F.col(c)).alias(c) for c in items.columns])


def removals(items: DataFrame, explicit: DataFrame, candidates: DataFrame, retired_scope: DataFrame, breaker: DataFrame, accepted: bool = False) -> DataFrame:
    """source_id, stable_id, why of all rows to remove in a pass.

    What a provider deleted goes, with all under a deleted folder; what left the scope goes whatever the breaker says;
    what is merely absent goes unless the breaker holds its source and the deletions were not accepted.
    """
    from tidemark.operators.graph import descendants

    below = descendants(items.select("source_id", "stable_id", "parent_id"), explicit.select(*KEYS))
    held = breaker.where("tripped").select("source_id")
    absent = candidates if accepted else candidates.join(held, "source_id", "left_anti")
    every = (
        explicit.select(*KEYS, F.lit(1).alias("rank"), F.lit("provider").alias("why"))
        .unionByName(below.select(*KEYS, F.lit(2).alias("rank"), F.lit("below-deleted-folder").alias("why")))
        .unionByName(retired_scope.select(*KEYS, F.lit(3).alias("rank"), F.lit("scope-change").alias("why")))
        .unionByName(absent.select(*KEYS, F.lit(4).alias("rank"), F.lit("absent").alias("why")))
    )
    live = items.where("state <> 'tombstone'").select(*KEYS)
    return every.join(live, list(KEYS), "left_semi").groupBy(*KEYS).agg(F.min_by("why", "rank").alias("why"))


def runs_recovered(runs: DataFrame, committed: DataFrame) -> DataFrame:
    """run_id and action of unfinished runs: adopt one whose snapshot is the committed one, else discard it."""
    done = committed.select("run_id").distinct().withColumn("__done", F.lit(True))
    return runs.where("finished_at is null").join(done, "run_id", "left").select("run_id", F.when(F.col("__done"), "adopt").otherwise("discard").alias("action"))
