"""Counts, profiles and reports."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ordered import in_order
from tidemark.functions.columns import micros, type_label
from tidemark.functions.text import nfc_fold
from tidemark.schemas import PRESENT

WORD = r"[\p{L}&&[^\d_]][\p{L}\p{N}_'’-]{2,}"


def per_source(items: DataFrame) -> DataFrame:
    return items.where(~F.col("is_dir") & F.col("state").isin(*PRESENT)).groupBy("source_id").agg(F.count("*").alias("n"))


def state_counts(items: DataFrame) -> DataFrame:
    """source_id, state, n, deferred."""
    return items.where(~F.col("is_dir")).groupBy("source_id", "state").agg(F.count("*").alias("n"), F.count_if(F.col("last_verdict") == "deferred").alias("deferred"))


def key_presence(rows: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """How many rows have each key in a JSON column."""
    return rows.agg(*[F.count_if(F.get_json_object(json, f"$.{k}").isNotNull()).alias(k) for k in keys])


def live_action_keys(outputs: DataFrame) -> DataFrame:
    return outputs.where("status <> 'tombstone' and action_key is not null").select("action_key").distinct()


def next_sequence(runs: DataFrame) -> DataFrame:
    """next_run, oldest start and the newest run's outcome."""
    return runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("next_run"), F.min("started_at").alias("oldest"), F.max_by("outcome", "run_id").alias("newest_outcome"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("source_id", "verdict").agg(F.count("*").alias("n"))


def change_counts(changes: DataFrame) -> DataFrame:
    """Per source A, M, R, D; a D of a unit whose item lives counts as M."""
    op = F.when((F.col("op") == "D") & F.col("item_live"), "M").otherwise(F.col("op"))
    return changes.groupBy("source_id").agg(*[F.count_if(op == x).alias(x) for x in "AMRD"])


def run_subject(counts: DataFrame) -> DataFrame:
    """The subject line of a run's commit from change_counts."""
    t = counts.agg(*[F.sum(x).alias(x) for x in "AMRD"], F.count("*").alias("sources"))
    return t.select(F.concat_ws(", ", *[F.concat(F.col(x).cast("string"), F.lit(f" {w}")) for x, w in zip("AMRD", ("added", "modified", "renamed", "deleted"), strict=True)], F.concat(F.col("sources").cast("string"), F.lit(" sources"))).alias("subject"))


def type_histogram(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """column, type, n and the first value of each type by order: what a column holds when its values are read as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    each = rows.select(F.col(order).alias("__at"), F.explode(cells).alias("c")).select("__at", "c.*").where("value is not null and value <> ''")
    return each.groupBy("column", type_label("value").alias("type")).agg(F.count("*").alias("n"), F.min_by("value", F.struct("__at", "value")).alias("first"))


def used_range(cells: DataFrame, by: list[str]) -> DataFrame:
    """Bounds and counts of the rows and columns that hold something; cells: by, row, col."""
    return cells.groupBy(*by).agg(
        F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"),
        F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"),
    )


def first_rows(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group: the sample shown on a summary, whose full data stay beside it."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def terms(values: DataFrame, column: str) -> DataFrame:
    """term, n: short values with a letter whole, long ones by their words."""
    text = F.trim(F.regexp_replace(column, r"\s+", " "))
    found = F.when(F.length(text) <= 80, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    return values.where(text.rlike(r"\p{L}")).select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def top_terms(counts: DataFrame, limit: int = 400) -> DataFrame:
    """The most frequent terms, ties by folded term, then term; shown in the order of folded term and term."""
    folded = counts.withColumn("__key", F.lower("term"))
    return folded.orderBy(F.desc("n"), "__key", "term").limit(limit).orderBy("__key", "term").drop("__key")


def budget_prefix(rows: DataFrame, by: list[str], order: list[str], size: str, room: int) -> DataFrame:
    """The rows of each group that come before the running size passes the room."""
    run = F.sum(size).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("used", run).where(F.col("used") <= room)


def greedy_budget(rows: DataFrame, by: list[str], order: list[str], size: str, max_bytes: int, max_files: int) -> DataFrame:
    """by, key, taken: rows in order, each taken if it still fits; one too big is left and smaller ones may follow.

    The state is what was used; a group's rows stream past it in order, none is held.
    """

    def read(queue: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(queue, lambda r: r[: len(by)]):
            used = files = 0
            for *row, n in group:
                fits = n is not None and used + n <= max_bytes and files < max_files
                if fits:
                    used, files = used + n, files + 1
                yield (*row, fits)

    queue = rows.select(*by, *order, F.col(size).cast("bigint").alias("__size"))
    return in_order(queue, by, [*order, "__size"], read, {c: dict(rows.dtypes)[c] for c in order} | {"taken": "boolean"})


def contingency(pairs: DataFrame) -> DataFrame:
    """label, voice, n, and the totals of each side."""
    n = pairs.groupBy("label", "voice").agg(F.count("*").alias("n"))
    return n.withColumn("label_total", F.sum("n").over(W.partitionBy("label"))).withColumn("voice_total", F.sum("n").over(W.partitionBy("voice")))


def mode(rows: DataFrame, by: list[str], value: str, confidence: str, order: str) -> DataFrame:
    """The most frequent value of each group; ties by the highest confidence, then the earliest."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.max(confidence).alias("best"), F.min(order).alias("first"))
    return n.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", "best", -F.col("first"))).alias("m")).select(*by, f"m.{value}", "m.n")


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The upper of the two middle values where a count is even: ranked, not gathered."""
    place = W.partitionBy(*by).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(place).alias("__k"), F.count("*").over(W.partitionBy(*by)).alias("__n"))
    return ranked.where("__k = floor(__n / 2) + 1").select(*by, F.col(value).alias("median"))


def files_under_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """folder, n: each file at the nearest listed folder above it (paths folded)."""
    parts = F.split("key", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    keyed = files.where(F.contains("path", F.lit("/"))).select("path", nfc_fold("path").alias("key"))
    each = keyed.select("path", F.explode(above).alias("prefix"))
    named = folders.select(F.col("path").alias("folder"), nfc_fold("path").alias("prefix"))
    near = each.join(named, "prefix").groupBy("path").agg(F.max_by("folder", F.length("prefix")).alias("folder"))
    return near.groupBy("folder").agg(F.count("*").alias("n"))


def folder_classes(files: DataFrame, folders: DataFrame) -> DataFrame:
    """source_id, path, class, n, other of listed folders (source_id, path): has-files (n files lie below it as it is spelled), would-collide
    (files lie only below another spelling of it, the least of which is ``other``), clear.

    One index of the folded prefixes of all files answers for all three; sources don't mix.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    prefixes = files.where(F.contains("path", F.lit("/"))).select("source_id", F.explode(above).alias("prefix")).groupBy("source_id", "prefix").agg(F.count("*").alias("n"))
    index = prefixes.withColumn("__key", nfc_fold("prefix"))  # a name is folded once, however many files lie below it
    asked = folders.select("source_id", "path").distinct().withColumn("__key", nfc_fold("path"))
    met = asked.join(index, ["source_id", "__key"], "left")
    own = F.col("prefix") == F.col("path")
    out = met.groupBy("source_id", "path").agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n"), F.min(F.when(~own, F.col("prefix"))).alias("other"))
    kind = F.when(F.col("n") > 0, "has-files").when(F.col("other").isNotNull(), "would-collide").otherwise("clear")
    return out.select("source_id", "path", kind.alias("class"), "n", "other")


def collision_groups(paths: DataFrame) -> DataFrame:
    """key, spellings: path prefixes that are one under the fold (case, composed letters)."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = paths.select(F.explode(prefixes).alias("p")).distinct()
    return each.withColumn("key", nfc_fold("p")).groupBy("key").agg(F.count("*").alias("spellings"), F.min("p").alias("first")).where("spellings > 1")


def quarantine_report(items: DataFrame) -> DataFrame:
    return items.where("state in ('quarantined', 'refused')").select("source_id", "rel_path", F.coalesce("state_reason", F.lit("")).alias("reason")).distinct()


def recent_changes(changes: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Changes of the last days by day and source."""
    return changes.where(F.col("day") > F.date_sub(today, days)).groupBy("day", "source_id").agg(*[F.count_if(F.col("op") == x).alias(x) for x in "AMRD"])


def index_areas(pages: DataFrame, max_lines: int = 200, max_bytes: int = 25_000) -> DataFrame:
    """group, area, lines, bytes, split: areas that pass the line or byte budget are to be split."""
    size = F.sum(F.octet_length("title") + F.octet_length("path") + 8)
    by = pages.groupBy("group", "area").agg(F.count("*").alias("lines"), size.alias("bytes"))
    return by.withColumn("split", (F.col("lines") > max_lines) | (F.col("bytes") > max_bytes))


def queue_reasons(queue: DataFrame) -> DataFrame:
    """reason, runnable, kept, held of a purge queue (reason, held, kept)."""
    return queue.groupBy("reason").agg(
        F.count_if(~F.col("held") & ~F.col("kept")).alias("runnable"), F.count_if(F.col("kept")).alias("kept"), F.count_if(F.col("held") & ~F.col("kept")).alias("held")
    )


def eval_scores(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Scores by category: correct, cited strictly (same second) and leniently (within ten), wrong though sure."""
    rows = key.join(answers, "question", "left")
    right = F.coalesce(F.lower("given") == F.lower("expected"), F.lit(False))
    off = F.abs(F.col("cited") - F.col("second"))
    return rows.groupBy("category").agg(
        F.count("*").alias("asked"), F.count_if(right).alias("correct"), F.count_if(off == 0).alias("strict"), F.count_if(off <= 10).alias("lenient"),
        F.count_if(~right & (F.col("confidence") == "high")).alias("wrong_and_sure"),
    )


def layout_agreement(ticks: DataFrame) -> DataFrame:
    """Share of ticks (platform, recording, tick, truth, read) that agree; those beside a change of truth are not scored."""
    w = W.partitionBy("platform", "recording").orderBy("tick")
    edge = F.coalesce(F.lag("truth").over(w) != F.col("truth"), F.lit(False)) | F.coalesce(F.lead("truth").over(w) != F.col("truth"), F.lit(False))
    return ticks.withColumn("__edge", edge).where("not __edge").groupBy("platform").agg(F.count("*").alias("scored"), F.count_if(F.col("truth") == F.col("read")).alias("agreed"))


def tallies(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """A map of counts per group."""
    n = rows.groupBy(*by, name).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("counts"))


def month_rollup(messages: DataFrame) -> DataFrame:
    """channel, month, n, oldest, newest, sha of the latest record of each message, in the month of its thread's root.

    messages: channel, id, root_id (null for a root), created, modified, body, deleted, seq.  A message whose root is
    nowhere is left out.
    """
    latest = W.partitionBy("channel", "id").orderBy(F.desc("modified"), F.desc("seq"))
    rows = messages.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    roots = rows.where("root_id is null").select("channel", F.col("id").alias("__root"), F.date_trunc("month", "created").alias("month"))
    placed = rows.withColumn("__root", F.coalesce("root_id", "id")).join(roots, ["channel", "__root"])
    line = F.concat_ws("|", F.col("id").cast("string"), micros("modified").cast("string"), F.when(F.col("deleted"), "").otherwise(F.col("body")))
    doc = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created", F.col("id").alias("id"), line.alias("line")))), lambda x: x["line"]), "\n")
    return placed.groupBy("channel", "month").agg(
        F.count("*").alias("n"), F.min("created").alias("oldest"), F.max("modified").alias("newest"), F.sha2(doc.cast("binary"), 256).alias("sha")
    )  # a document is one month of one channel


def high_water(marks: DataFrame, seen: DataFrame, overlap_seconds: int = 300) -> DataFrame:
    """source_id, mark, resume: marks never go back; a resumed read starts some minutes before."""
    new = seen.groupBy("source_id").agg(F.max("modified").alias("newest"))
    mark = F.greatest("mark", "newest")
    return marks.join(new, "source_id", "full_outer").select("source_id", mark.alias("mark"), (mark - F.make_dt_interval(secs=F.lit(overlap_seconds))).alias("resume"))


def late_merge(documents: DataFrame, late: DataFrame) -> DataFrame:
    """Months (channel, month, n, oldest, newest, sha) with those rewritten that late records changed; action says which."""
    key = ["channel", "month"]
    new = late.select(*key, *[F.col(c).alias(f"__{c}") for c in ("n", "oldest", "newest", "sha")])
    rows = documents.join(new, key, "full_outer")
    action = F.when(F.col("sha").isNull(), "new").when(F.col("__sha").isNull() | (F.col("__sha") == F.col("sha")), "kept").otherwise("rewritten")
    return rows.select(*key, *[F.coalesce(f"__{c}", c).alias(c) for c in ("n", "oldest", "newest", "sha")], action.alias("action"))
