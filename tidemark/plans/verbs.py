"""The verbs: one function each over a snapshot store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.front import front_scalar, write_front
from tidemark.functions.scratch import materialize
from tidemark.functions.text import mirror_rel_path
from tidemark.operators import aggregates, classify, converters, cycle, governance, graph, parts, quality, state
from tidemark.sources import versions
from tidemark.sources.sinks import tombstone_pages
from tidemark.sources.versions import VersionedStore


@dataclass
class Report:
    run_id: int
    verdicts: DataFrame
    candidates: DataFrame
    breaker: DataFrame
    removed: DataFrame
    findings: DataFrame
    changes: DataFrame
    published: bool
    #: Rows staged by table.
    written: dict[str, int]


@dataclass
class Policy:
    """What a cycle is told beside the listing: labels that refuse, sources whose absences need two passes, objects that left the
    scope, bounds on what is read at once, and how often a failed conversion is tried again."""

    excluded_labels: list[str] = field(default_factory=list)
    refuse_unlabelled: bool = False
    two_pass_sources: list[str] = field(default_factory=list)
    out_of_scope: DataFrame | None = None
    accept_deletions: bool = False
    max_bytes: int = 1 << 62
    max_files: int = 1 << 30
    retries: int = cycle.CONVERT_RETRIES
    tombstone_days: int = 180
    engines: dict | None = None


KEYS = list(classify.KEYS)
UNIT_MARK = "\x1f"


def settled_items(items: DataFrame, passes: DataFrame) -> DataFrame:
    """items as they would be if every pass had touched every row that it saw: a row that is present and not marked absent was
    seen by the last full pass of its source.  Rows are not rewritten to say so."""
    last = passes.select("source_id", F.col("last_full_run").alias("__full"))
    present = (F.col("state") != "tombstone") & F.col("absent_since_run").isNull()
    seen = F.when(present, F.greatest("last_seen_run", "__full")).otherwise(F.col("last_seen_run"))
    return items.join(last, "source_id", "left").select(*[seen.alias(c) if c == "last_seen_run" else F.col(c) for c in items.columns])


@dataclass
class Pass:
    """The first half of a cycle: the working rows as they were and as they are now, and what follows for the other tables."""

    old: DataFrame
    new: DataFrame
    outputs: DataFrame
    new_outputs: DataFrame
    tombstones: DataFrame
    new_tombstones: DataFrame
    aliases: DataFrame
    verdicts: DataFrame
    candidates: DataFrame
    breaker: DataFrame
    removed: DataFrame


def observe(store: VersionedStore, observed: DataFrame, run_id: int, written_at_ns: int, full: bool, complete: bool, policy: Policy, answers: DataFrame | None = None) -> Pass:
    """Classify; move what a safe save renamed; mark what is absent; remove what is gone.

    Only working rows go on from here: those that the fast path does not answer, the absent, what has work left, and what is below a
    deleted folder.
    """
    items = settled_items(store.read("items"), store.read("passes"))
    rows = materialize(classify.pass_rows(observed, items, written_at_ns), "pass")
    verdicts, candidates, breaker = classify.settle_pass(rows, classify.live_rows(items), full, complete, answers=answers)
    verdicts, candidates, breaker = store.keep("verdicts", run_id, verdicts), store.keep("candidates", run_id, candidates), store.keep("breaker", run_id, breaker)
    pairs = verdicts.where("replaces_id is not null").select("source_id", F.col("stable_id").alias("new_id"), F.col("replaces_id").alias("old_id"))
    touched = verdicts.select(*KEYS).unionByName(candidates).unionByName(state.pending_work(items).select(*KEYS)).unionByName(pairs.select("source_id", F.col("old_id").alias("stable_id")))
    touched = materialize(touched.distinct(), "touched")
    old = materialize(items.join(touched, KEYS, "left_semi"), "old")
    upserted = state.upsert(old, observed.join(touched, KEYS, "left_semi"), verdicts, run_id)

    outputs, tombstones = (materialize(store.read(t).join(touched, KEYS, "left_semi"), "working") for t in ("outputs", "tombstones"))
    moved, kids, aliases = state.rekey(upserted, {"outputs": outputs, "tombstones": tombstones}, pairs, store.read("aliases"))
    moved = materialize(moved, "moved")
    twice = F.col("source_id").isin(*policy.two_pass_sources) if policy.two_pass_sources else F.lit(False)
    confirmed = state.confirmed_absent(moved, candidates, run_id, twice).select(*KEYS)
    left = policy.out_of_scope.select(*KEYS) if policy.out_of_scope is not None else candidates.limit(0)
    everything = items.join(touched, KEYS, "left_anti").unionByName(moved)
    explicit = materialize(observed.where("deleted").select(*KEYS).distinct(), "explicit")
    removed = store.keep("removed", run_id, state.removals(everything, explicit, confirmed, left, breaker, policy.accept_deletions))

    below = materialize(items.join(removed.join(touched, KEYS, "left_anti"), KEYS, "left_semi"), "below")  # not looked at so far
    marked = state.mark_absent(moved, candidates, run_id) if full and complete else moved
    gone = removed.select(*KEYS, F.lit(True).alias("__gone"))
    own = F.when(F.col("__gone"), "tombstone").otherwise(F.col("state"))
    new = marked.unionByName(below).join(gone, KEYS, "left").select(*[own.alias(c) if c == "state" else F.col(c) for c in moved.columns])
    more = {t: materialize(store.read(t).join(below.select(*KEYS), KEYS, "left_semi"), "more") for t in kids}
    kids = {t: materialize(kids[t].unionByName(more[t]), "kids") for t in kids}  # many steps read them
    return Pass(
        old.unionByName(below), materialize(new, "next"), outputs.unionByName(more["outputs"]), kids["outputs"], tombstones.unionByName(more["tombstones"]), kids["tombstones"],
        aliases, verdicts, candidates, breaker, removed,
    )


@dataclass
class Content:
    """The second half: what was read and made of the rows with work left."""

    outcomes: DataFrame  # keys, state, state_reason, verdict, content_sha256, canonical_sha256, failures
    produced: DataFrame  # keys, unit_id, output_path, action_key, converter_id, rendered_sha256, text
    fresh: DataFrame  # entries for the cache
    findings: DataFrame


def unit_paths(outputs: DataFrame) -> DataFrame:
    """source_id, stable_id (of a unit), path of live outputs."""
    return outputs.where("status = 'ok'").select("source_id", F.concat_ws(UNIT_MARK, "stable_id", "unit_id").alias("stable_id"), F.col("output_path").alias("path"))


def make_content(store: VersionedStore, seen: Pass, files: DataFrame, run_id: int, policy: Policy) -> Content:
    """Read within the budget; stop at what only a save changed (H1); convert through the cache; screen; give each unit its page."""
    todo, outputs = state.pending_work(seen.new), seen.new_outputs
    known = files if "labels" in files.columns else files.withColumn("labels", F.array().cast("array<string>"))
    found = known.join(todo.select(*KEYS, "rel_path", "canonical_sha256", "canonical_method", "state"), KEYS)
    judged = quality.label_policy(found, policy.excluded_labels, policy.refuse_unlabelled)
    sizes = materialize(judged.select(*KEYS, "rel_path", F.length("content").cast("bigint").alias("bytes"), "refused", "why"), "sizes")
    refused = sizes.where("refused").select(*KEYS, F.concat(F.lit("refused: "), "why").alias("why"))
    allowed = judged.where("not refused")
    fits = aggregates.greedy_budget(sizes.where("not refused").select("source_id", "rel_path", "stable_id", "bytes"), ["source_id"], ["rel_path", "stable_id"], "bytes", policy.max_bytes, policy.max_files)
    fits = materialize(fits.select(*KEYS, "taken"), "budget")
    taken = allowed.join(fits.where("taken").select(*KEYS), KEYS, "left_semi").withColumnsRenamed({"canonical_sha256": "stored_sha256", "canonical_method": "stored_method"})
    planned = converters.planned(taken, policy.engines).withColumns({"content_sha256": F.sha2("content", 256), "new_method": F.lit("canonical@1")})
    planned = materialize(planned.withColumn("path", F.concat_ws(UNIT_MARK, *KEYS)), "planned")  # a name for each object
    none = F.lit(None).cast("map<string,string>")
    h1 = classify.classify_content(planned.select(*KEYS, "path", "state", "stored_sha256", "stored_method", "new_method", F.col("canonical_sha256").alias("new_sha256"), none.alias("stored_parts"), none.alias("new_parts")))
    published = outputs.where("status = 'ok'").select(*KEYS).distinct().withColumn("__page", F.lit(True))
    same = h1.join(published, KEYS, "left").where((F.col("verdict") == "touched_not_changed") & F.col("__page")).select(*KEYS)

    cache = store.read("unit_cache").select("action_key", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"), "unit_id", "kind", "title", "body")
    units = materialize(converters.convert(planned.join(same, KEYS, "left_anti"), cache, policy.engines).drop("tokens"), "units")
    secrets = materialize(quality.secret_hits(units.where("body is not null").select(F.concat_ws(UNIT_MARK, "path", "unit_id").alias("path"), F.col("body").alias("text"))), "secrets")
    name = lambda c: F.concat_ws(UNIT_MARK, F.split(c, UNIT_MARK)[0], F.split(c, UNIT_MARK)[1])
    leaks = secrets.select(name("path").alias("path")).distinct()
    once = units.groupBy("path").agg(F.min("status").alias("status"), F.min("reason").alias("reason"), F.count("unit_id").alias("n"))
    told = planned.select(*KEYS, "path", "rel_path", "content_sha256", "canonical_sha256", "converter_id").join(once, "path", "left").join(leaks.withColumn("__leak", F.lit(True)), "path", "left")
    told = told.join(store.read("failures"), KEYS, "left").withColumn("failures", F.when(F.col("failed_sha256") == F.col("content_sha256"), F.col("failures")).otherwise(0))
    told = materialize(told, "told")

    leak, failed = F.coalesce("__leak", F.lit(False)), F.col("status") == "failed"
    tries = F.when(failed, F.col("failures") + 1).otherwise(0)
    gives_up = failed & (tries > policy.retries)
    ok = F.col("status").isNull() | ((F.col("status") == "ok") & ~leak)
    outcome = (
        F.when(ok, F.struct(F.lit("live").alias("state"), F.lit(None).cast("string").alias("why"), F.lit("unchanged").alias("verdict")))
        .when(leak, F.struct(F.lit("quarantined").alias("state"), F.lit("secret").alias("why"), F.lit("quarantined").alias("verdict")))
        .when(failed & ~gives_up, F.struct(F.lit("live").alias("state"), F.lit(None).cast("string").alias("why"), F.lit("error").alias("verdict")))
        .when(F.col("status") == "refused", F.struct(F.lit("refused").alias("state"), F.concat(F.lit("refused: "), F.coalesce("reason", F.lit(""))).alias("why"), F.lit("refused").alias("verdict")))
        .otherwise(F.struct(F.lit("quarantined").alias("state"), F.concat_ws(": ", "status", "reason").alias("why"), F.lit("quarantined").alias("verdict")))
    )
    read = told.select(*KEYS, outcome.alias("x"), "content_sha256", "canonical_sha256", tries.cast("bigint").alias("failures"))
    read = read.select(*KEYS, F.col("x.state").alias("state"), F.col("x.why").alias("state_reason"), "x.verdict", "content_sha256", "canonical_sha256", "failures")
    no = [F.lit(None).cast("string").alias(c) for c in ("content_sha256", "canonical_sha256")]
    unread = refused.select(*KEYS, F.lit("refused").alias("state"), F.col("why").alias("state_reason"), F.lit("refused").alias("verdict"), *no, F.lit(0).cast("bigint").alias("failures"))
    later = fits.where("not taken").select(*KEYS, F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("state_reason"), F.lit("deferred").alias("verdict"), *no, F.lit(0).cast("bigint").alias("failures"))
    outcomes = materialize(read.unionByName(unread).unionByName(later), "outcomes")

    good = told.where(ok & F.col("status").isNotNull()).select(*KEYS, "path", "rel_path", "converter_id", "n")
    body = units.where("unit_id is not null").select("path", "action_key", "unit_id", "title", "body")
    mark = F.concat_ws(UNIT_MARK, "stable_id", "unit_id")
    named = good.join(body.select("path", "unit_id"), "path")  # pages are named without their bodies
    wanted = named.select("source_id", mark.alias("stable_id"), mirror_rel_path("source_id", "rel_path", F.when(F.col("n") > 1, F.col("unit_id")).otherwise("")).alias("path"))
    owned = unit_paths(store.read("outputs").join(seen.old.select(*KEYS), KEYS, "left_anti").unionByName(outputs))
    placed = parts.allocated_paths(wanted, owned).select("source_id", F.col("stable_id").alias("__id"), F.col("path").alias("output_path"))
    pages = good.join(body, "path").withColumns({"rendered_sha256": F.sha2(F.col("body").cast("binary"), 256), "__id": mark}).join(placed, ["source_id", "__id"])
    head = F.struct("rendered_sha256", "source_id", F.col("rel_path").alias("source_path"), F.lit("current").alias("status"), F.nullif("title", F.lit("")).alias("title"))
    text = F.concat(write_front(F.to_json(head)), "body").alias("text")
    produced = materialize(pages.select("output_path", *KEYS, "unit_id", "action_key", "converter_id", "rendered_sha256", text), "produced")

    have = store.read("unit_cache").select("action_key").distinct()
    clean = units.where("status = 'ok' and unit_id is not null").join(leaks, "path", "left_anti").join(have, "action_key", "left_anti").dropDuplicates(["action_key", "unit_id"])
    fresh = clean.select("action_key", "unit_id", "kind", "title", "body", F.lit(run_id).cast("bigint").alias("created_run"))
    stops = secrets.select(F.lit("secret").alias("rule"), F.col("path"), F.col("rule").alias("detail"), F.lit(False).alias("blocking"))
    made = produced.select(F.col("output_path").alias("path"), "text")
    return Content(outcomes, produced, fresh, stops.unionByName(quality.path_findings(made.select("path").distinct())).unionByName(quality.contract_findings(made)))


def settle_items(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """rows with what became of those that were read, refused or put off; a verdict that is settled is work no more."""
    told = outcomes.select(*KEYS, *[F.col(c).alias(f"__{c}") for c in ("state", "state_reason", "verdict", "content_sha256", "canonical_sha256")])
    hit, read = F.col("__verdict").isNotNull(), F.col("__content_sha256").isNotNull()
    own = {
        "state": F.coalesce("__state", "state"), "state_reason": F.when(F.col("__state").isNotNull(), F.col("__state_reason")).otherwise(F.col("state_reason")),
        "last_verdict": F.when(hit, F.col("__verdict")).otherwise(F.col("last_verdict")),
        "content_sha256": F.coalesce("__content_sha256", "content_sha256"), "canonical_sha256": F.coalesce("__canonical_sha256", "canonical_sha256"),
        "canonical_method": F.when(read, F.lit("canonical@1")).otherwise(F.col("canonical_method")),
    }
    return rows.join(told, KEYS, "left").select(*[own.get(c, F.col(c)).alias(c) for c in rows.columns])


@dataclass
class Published:
    old_outputs: DataFrame
    outputs: DataFrame
    old_tombstones: DataFrame
    tombstones: DataFrame
    pages: DataFrame  # path, text of pages that are new or other than before
    pages_gone: DataFrame  # path
    changes: DataFrame  # op, source_id, path


def make_pages(store: VersionedStore, seen: Pass, items: DataFrame, made: Content, run_id: int, today: Column, policy: Policy) -> Published:
    """The outputs and pages that follow: rewritten where the units differ (H2), moved where only the source's name did, gone with vanished
    units, notices for what was removed, restored for what lives again, and reaped when their time has come."""
    before, produced = seen.new_outputs, made.produced
    live = before.where("status = 'ok'")
    h2 = classify.classify_output(before.select(*KEYS, "unit_id", "rendered_sha256", "status"), produced.select(*KEYS, "unit_id", "rendered_sha256", F.lit(True).alias("ok")))
    same = h2.where("verdict = 'output_unchanged'").select(*KEYS)
    stay = live.select(*KEYS, "unit_id", F.col("output_path").alias("__old_path"), F.col("page_sha256").alias("__old_sha"), F.col("built_run").alias("__old_run"))
    rows = produced.join(stay, [*KEYS, "unit_id"], "left").join(same.withColumn("__same", F.lit(True)), KEYS, "left")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    kept = F.coalesce(F.col("__same"), F.lit(False)) & (F.col("__old_path") == F.col("output_path")) & (F.col("__old_sha") == sha)
    built = rows.select(
        "output_path", *KEYS, "unit_id", "action_key", "rendered_sha256", sha.alias("page_sha256"), "converter_id", F.lit("1").alias("converter_version"),
        F.lit(None).cast("string").alias("options_hash"), F.lit("ok").alias("status"), F.when(kept, F.col("__old_run")).otherwise(F.lit(run_id)).cast("bigint").alias("built_run"), "text", "__old_path",
    )
    built = materialize(built, "built")
    replaced, vanished = state.replace_outputs(before, built.select(*before.columns))
    after_build = materialize(replaced, "replaced")

    renamed = seen.verdicts.where("prev_path is not null").select(*KEYS).join(built.select(*KEYS).distinct(), KEYS, "left_anti").join(items.where("state = 'live'").select(*KEYS, "rel_path"), KEYS)
    renamed = materialize(renamed, "renamed")
    units = live.groupBy(*KEYS).agg(F.count("*").alias("n"))
    target = live.join(renamed, KEYS).join(units, KEYS).withColumn("__id", F.concat_ws(UNIT_MARK, "stable_id", "unit_id"))
    wanted = target.select("source_id", F.col("__id").alias("stable_id"), mirror_rel_path("source_id", "rel_path", F.when(F.col("n") > 1, F.col("unit_id")).otherwise("")).alias("path"))
    others = unit_paths(store.read("outputs").join(seen.old.select(*KEYS), KEYS, "left_anti").unionByName(after_build))
    to = parts.allocated_paths(wanted, others.join(wanted.select("source_id", "stable_id"), ["source_id", "stable_id"], "left_anti")).select("source_id", F.col("stable_id").alias("__id"), F.col("path").alias("new_path"))
    moves = materialize(target.join(to, ["source_id", "__id"]).select(*KEYS, "unit_id", "output_path", "new_path", "rel_path"), "moves")
    heads = cycle.rewritten_heads(store.read("pages").join(moves.select(F.col("output_path").alias("path")), "path", "left_semi"), moves.select(F.col("output_path").alias("path"), "new_path", front_scalar("rel_path").alias("source_path")))
    heads = materialize(heads, "heads")
    shas = heads.select(F.col("old_path").alias("output_path"), F.col("path").alias("__to"), F.sha2(F.col("text").cast("binary"), 256).alias("__sha"))
    after = after_build.join(shas, "output_path", "left").withColumns({"output_path": F.coalesce("__to", "output_path"), "page_sha256": F.coalesce("__sha", "page_sha256")}).select(*before.columns)

    lost = after.where("status = 'ok'").join(items.where("state <> 'live' and state <> 'dataless'").select(*KEYS, "state"), KEYS)
    lost = materialize(lost, "lost")
    notices = lost.where("state = 'tombstone'").join(seen.removed, KEYS, "left")
    notices = notices.select("output_path", *KEYS, "unit_id", F.col("rendered_sha256").alias("last_rendered_sha256"), F.coalesce("why", F.lit("provider")).alias("reason"))
    notices = materialize(state.tombstones_written(notices, run_id, today, policy.tombstone_days).select(*seen.tombstones.columns), "notices")
    withdrawn = lost.where("state <> 'tombstone'").select("output_path", *KEYS, "unit_id")
    due = materialize(state.tombstones_due(store.read("tombstones"), after.where("status = 'ok'"), today), "due")
    aged = lambda t: store.read(t).join(seen.old.select(*KEYS), KEYS, "left_anti").join(due.select("output_path"), "output_path", "left_semi")  # noqa: E731  beside the working rows
    _, standing = cycle.restored(seen.new_tombstones, after.where("status = 'ok'").join(items.where("state = 'live'").select(*KEYS), KEYS, "left_semi"))
    tombstones = standing.join(due.select("output_path"), "output_path", "left_anti").join(notices.select("output_path"), "output_path", "left_anti").unionByName(notices)
    tombstones = materialize(tombstones, "standing")
    status = after.join(notices.select("output_path", F.lit(True).alias("__noticed")), "output_path", "left").join(withdrawn.select("output_path", F.lit(True).alias("__out")), "output_path", "left")
    status = status.where("__out is null").withColumn("status", F.when(F.col("__noticed"), "tombstone").otherwise(F.col("status")))
    outputs = materialize(status.join(due.select("output_path"), "output_path", "left_anti").select(*before.columns), "outputs")

    text = built.select(F.col("output_path").alias("path"), "text").unionByName(heads.select("path", "text")).unionByName(tombstone_pages(notices).select("path", "text"))
    gone = vanished.select(F.col("output_path").alias("path")).unionByName(heads.select(F.col("old_path").alias("path"))).unionByName(withdrawn.select(F.col("output_path").alias("path")))
    gone = gone.unionByName(built.where("__old_path <> output_path").select(F.col("__old_path").alias("path"))).unionByName(due.where("action = 'page'").select(F.col("output_path").alias("path")))
    gone = materialize(gone.distinct().join(text.select("path"), "path", "left_anti"), "pages-gone")
    was = store.read("pages").join(text.select("path").distinct(), "path", "left_semi").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("__sha"))
    now = text.join(was, "path", "left").where(~F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("__sha")))
    pages = materialize(now.select("path", "text", F.col("__sha").isNull().alias("__new")), "pages")
    source = F.split("path", "/")[1].alias("source_id")
    noticed, moved = notices.select(F.col("output_path").alias("path"), F.lit("D").alias("__op")), heads.select("path", F.lit("R").alias("__op"))
    op = pages.join(noticed.unionByName(moved), "path", "left").select(F.coalesce("__op", F.when(F.col("__new"), "A").otherwise("M")).alias("op"), source, "path")
    changes = op.unionByName(gone.join(heads.select(F.col("old_path").alias("path")), "path", "left_anti").select(F.lit("D").alias("op"), source, "path"))
    old_outputs = seen.outputs.unionByName(aged("outputs").where("status = 'tombstone'").select(*seen.outputs.columns))
    old_tombstones = seen.tombstones.unionByName(aged("tombstones").select(*seen.tombstones.columns))
    return Published(old_outputs, outputs, old_tombstones, tombstones, pages.drop("__new"), gone, changes)


def sync(
    store: VersionedStore, observed: DataFrame, files: DataFrame, run_id: int, written_at_ns: int, full: bool, complete: bool, policy: Policy | None = None,
    tokens: DataFrame | None = None, today: Column | None = None, answers: DataFrame | None = None,
) -> Report:
    """One cycle: recover what a crash left; classify; move, mark and remove; convert what changed; screen; write pages; publish if nothing blocks.

    files: source_id, stable_id, path, name, content (and labels, where items have some) of objects that can be read.
    tokens: source_id, token, the cursors that count once the run is published.
    answers: source_id, path, status of folders; rows under one that was refused or left unread are not taken for gone, and its source has had
    no full pass.  Every table gets its changed rows only, so a cycle without
    change writes no data of items, outputs or pages.  The published tag moves last, and not at all if a finding blocks.
    """
    policy, today = policy or Policy(), F.current_date() if today is None else today
    store.recover()
    store.begin(run_id)
    seen = observe(store, observed, run_id, written_at_ns, full, complete, policy, answers)
    made = make_content(store, seen, files, run_id, policy)
    items = materialize(settle_items(seen.new, made.outcomes), "settled")
    out = make_pages(store, seen, items, made, run_id, today, policy)
    findings = store.keep("findings", run_id, made.findings)
    changes = store.keep("changes", run_id, out.changes)

    written = {"items": store.change("items", run_id, *versions.differences(seen.old, items, KEYS, ["last_seen_run"]))}
    written["outputs"] = store.change("outputs", run_id, *versions.differences(out.old_outputs, out.outputs, store.keys["outputs"]))
    written["tombstones"] = store.change("tombstones", run_id, *versions.differences(out.old_tombstones, out.tombstones, store.keys["tombstones"]))
    written["pages"] = store.change("pages", run_id, out.pages, out.pages_gone)
    written["aliases"] = store.replace("aliases", run_id, seen.aliases)
    written["unit_cache"] = store.change("unit_cache", run_id, made.fresh)
    failed = made.outcomes.where("failures > 0").select(*KEYS, "failures", F.col("content_sha256").alias("failed_sha256"))
    cleared = store.read("failures").select(*KEYS).join(made.outcomes.where("failures = 0 and verdict <> 'deferred'").select(*KEYS), KEYS, "left_semi")
    written["failures"] = store.change("failures", run_id, failed, cleared)
    if full and complete:
        listed = observed.select("source_id").distinct().withColumn("last_full_run", F.lit(run_id).cast("bigint"))
        if answers is not None:
            listed = listed.join(answers.where(F.col("status").isin(*classify.UNKNOWN)).select("source_id").distinct(), "source_id", "left_anti")
        written["passes"] = store.change("passes", run_id, listed)
    if tokens is not None:
        written["cursors"] = store.replace("cursors", run_id, state.stage_cursors(store.read("cursors"), tokens, run_id))
    blocking = quality.gate(findings).first()["blocking"]
    if blocking:
        store.abandon(run_id)
    else:
        store.commit(run_id)
        for table in store.keys:
            if store.due(table):
                store.compact([table])
    return Report(run_id, seen.verdicts, seen.candidates, seen.breaker, seen.removed, findings, changes, not blocking, written)


def status(store: VersionedStore) -> DataFrame:
    """Rows per source and state of the published run."""
    return aggregates.state_counts(store.read("items"))


def curate(pages: DataFrame, heads: DataFrame, mirror: DataFrame) -> dict[str, DataFrame]:
    """Edges of topic pages (page, sources), what is not fresh, what is not covered."""
    edges = graph.dependency_edges(pages)
    once = edges.where("not again").withColumn("fields", F.lit(4))
    return {"edges": edges, "queue": graph.refresh_queue(once, heads), "uncovered": graph.uncovered_pages(mirror, once)}


def purge(store: VersionedStore, by: str, value: str, holds: DataFrame, reason: str, dry_run: bool = True, source: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Erase what a selector names, and all that ever shared a path of its source with it, from every retained file.

    The ids and, unless it is a dry run, rows that survive by table: none, or the erasure has failed and nothing has moved.
    """
    if reason not in governance.REASONS:
        raise ValueError(f"not a reason: {reason}")
    history = store.history("items")
    seeds = governance.selected(history, by, value, source).select("source_id", "stable_id").distinct()
    named = history.select("source_id", "stable_id", F.explode(F.array_compact(F.array("rel_path", "prev_path"))).alias("path")).distinct()
    _, ids = governance.erase({}, named, seeds, holds)
    if dry_run:
        return ids, {}
    pages = store.history("outputs").join(ids, KEYS).select("source_id", F.col("output_path").alias("path"))
    paths = materialize(named.join(ids, KEYS, "left_semi").select("source_id", "path").unionByName(pages).distinct(), "purged-paths")
    others = materialize(named.join(ids, KEYS, "left_anti").select("path").distinct(), "other-paths")
    told = materialize(ids, "purged-ids")
    hit = lambda df: governance.without(df, told, paths, others, "left_semi")
    left = store.rewrite(lambda df: governance.without(df, told, paths, others), lambda _, df: hit(df).count())
    return told, left


def offboard(store: VersionedStore, outputs: DataFrame, source: str, run_id: int) -> DataFrame:
    """Tombstones for all that a retired source published."""
    return governance.retired(store.read("items"), outputs, source, run_id)


def begin_run(runs: DataFrame, run_id: int, mode: str, now) -> DataFrame:
    """The ledger with a run that has begun; a run that begins again replaces its own row."""
    row = runs.sparkSession.createDataFrame([(run_id, mode)], "run_id bigint, mode string").withColumn("started_at", now)
    fresh = row.select(*[F.col(c) if c in row.columns else F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in runs.columns])
    return runs.where(F.col("run_id") != run_id).unionByName(fresh)


def finish_run(runs: DataFrame, run_id: int, outcome: str, now) -> DataFrame:
    mine = F.col("run_id") == run_id
    own = {"finished_at": F.when(mine, now).otherwise(F.col("finished_at")), "outcome": F.when(mine, F.lit(outcome)).otherwise(F.col("outcome"))}
    return runs.select(*[own.get(c, F.col(c)).alias(c) for c in runs.columns])


def archive(outputs: DataFrame, bodies: DataFrame, removed: DataFrame) -> DataFrame:
    """Copies (path, text) under archive/ of pages whose source a provider deleted."""
    gone = outputs.join(removed.where("why in ('provider', 'below-deleted-folder')").select(*classify.KEYS), list(classify.KEYS), "left_semi")
    return gone.join(bodies.select(F.col("path").alias("output_path"), "text"), "output_path").select(F.regexp_replace("output_path", "^mirror/", "archive/").alias("path"), "text")
