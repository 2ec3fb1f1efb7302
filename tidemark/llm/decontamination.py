"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts and benchmark items become lower-case runs of letters and digits.  A mask of stride s and weight w looks at w tokens,
each s after the one before, and ignores those between.  An item that an overlap may miss in k places is covered by k + 1
masks at least that have no token in common (segments of the item, each dealt to masks of stride 2, or 3 where their number
is odd), so one of them stands whole in the document wherever the misses fall, at the ends of the item or past those of the
document too: no overlap at or over the threshold is lost.  Masks of stride 2 over ``MIN_RUN`` tokens at every place of an
item find its parts.  There are at most 2 x ``MAX_WEIGHT`` masks whatever the benchmark.

The hashes of the items' masks meet those of all places of all documents; each hit fixes an alignment of an item along a
document, and the overlap is verified there: the share of the item's tokens that the document has at the same places.
Alignments at or over the threshold count, and so do those with a run of ``MIN_RUN`` equal tokens, as a part of an item is a
leak too.

Scale: items of equal words are one, and get their names back at the end.  Texts are cut into blocks of ``BLOCK`` places, and
what a place meets leaves its block as numbers (row, item, start), once for each alignment: no row of a place or of a hit
carries its text.  While the benchmark's hashes with their places are measured under a bound they are broadcast, and the
documents are not shuffled; beyond it the hashes alone sieve the places, and narrow rows (row, place, hash) are shuffled
against those that passed, with heavy hashes dealt to several tasks.  Then only texts with alignments are read again, and of
the blocks that these begin in each alignment gets the words that face its item.

Defined results: null or empty text gives no row, nor does an item without a token; one row per doc_id and item with its
best overlap (the earliest of equal ones), so rows with one doc_id count once; a null doc_id is a doc_id like any other;
empty tables give no rows; extra columns are ignored.  A text of any length is met whole, place by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import BROADCAST_BYTES, fresh, heavy, keyed, materialize, row_bytes, salted_join, side, small_batches

MIN_OVERLAP = 0.8
MIN_RUN = 13
#: A mask of stride 2 that spans MIN_RUN tokens.
MAX_WEIGHT = (MIN_RUN + 1) // 2
#: Places in a block of a text.
BLOCK = 1024
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ", -1)


def seed_of(words: Column, at: Column, stride: int, weight: int) -> Column:
    """The hash of the tokens that a mask looks at, from ``at`` on."""
    return F.xxhash64(F.lit(stride), F.lit(weight), *[F.get(words, at + stride * j) for j in range(weight)])


def masks(items: DataFrame, threshold: float) -> DataFrame:
    """Each row of (item_id, words) once for each of its masks: columns at (its first token), stride and weight beside its own.

    Misses allowed + 1 masks are needed, and so many that none has a weight over MAX_WEIGHT.
    """
    n = F.size("words")
    need = F.least(n, F.greatest(n - F.ceil(threshold * n) + 1, F.ceil(n / MAX_WEIGHT))).cast("int")
    segments = F.greatest(F.floor(F.col("need") / 2), F.lit(1)).cast("int")
    cut = lambda k: F.floor(k * n / F.col("segments")).cast("int")
    placed = items.withColumn("need", need).withColumn("segments", segments).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
    # a segment's masks: as many as its stride; an odd number makes the first segment one of three
    placed = placed.withColumn("stride", F.when(F.col("need") == 1, 1).when((F.col("need") % 2 == 1) & (F.col("k") == 0), 3).otherwise(2))
    placed = placed.withColumn("low", cut(F.col("k"))).withColumn("high", cut(F.col("k") + 1)).withColumn("phase", F.explode(F.sequence(F.lit(0), F.col("stride") - 1)))
    even = placed.withColumn("at", F.col("low") + F.col("phase")).withColumn("weight", F.ceil((F.col("high") - F.col("at")) / F.col("stride")).cast("int")).where("weight > 0")
    runs = items.where(n >= MIN_RUN).withColumn("at", F.explode(F.sequence(F.lit(0), n - MIN_RUN))).withColumn("stride", F.lit(2)).withColumn("weight", F.lit(MAX_WEIGHT))
    return even.select(*items.columns, "at", "stride", "weight").unionByName(runs)


def blocks(texts: DataFrame, places: int, beyond: int) -> DataFrame:
    """Each text's words in blocks of so many places, with the words beyond the last of them that a place there looks at: texts' columns but text, base, words."""
    keep = [c for c in texts.columns if c != "text"]
    worded = texts.select(*keep, words_of(F.coalesce("text", F.lit(""))).alias("words"))
    bases = F.sequence(F.lit(0), F.size("words") - 1, F.lit(places))
    cut = F.transform(bases, lambda base: F.struct(base.alias("base"), F.slice("words", base + 1, F.lit(places + beyond)).alias("words")))
    return worded.select(*keep, F.explode(cut).alias("b")).select(*keep, "b.base", "b.words")


def overlaps(docs: DataFrame, benchmark: DataFrame, threshold: float = MIN_OVERLAP, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, start (token of the document where the item begins), matched, item_words, overlap."""
    picked = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, _ = keyed(picked, "row")
    items, names = kinds(benchmark)
    top = best(judged(texts, items, threshold, limit), "doc_id", "item")
    top = best(top.join(side(names, limit), "item"), "doc_id", "item_id")  # an id may have several texts
    return top.select("doc_id", "item_id", F.col("start").cast("long"), F.col("matched").cast("long"), F.col("item_words").cast("long"), (F.col("matched") / F.col("item_words")).alias("overlap"))


def best(found: DataFrame, *names: str) -> DataFrame:
    """The best alignment of each combination of names."""
    top = found.groupBy(*names).agg(F.max(F.struct("matched", (-F.col("start")).alias("back"), "item_words")).alias("b"))
    return top.select(*names, (-F.col("b.back")).alias("start"), "b.matched", "b.item_words")


def kinds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The benchmark's different texts (item, words) and the ids of each (item_id, item)."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    named = named.where(F.get("words", F.lit(0)) != "").distinct()
    items = materialize(named.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    return items, materialize(named.join(items, "words").select("item_id", "item"), "names")


def judged(texts: DataFrame, items: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Alignments that count, of texts (row, text and any others, which are carried): texts' columns but text, item, start, matched, item_words."""
    placed = masks(items, threshold)
    shapes = sorted(tuple(r) for r in placed.select("stride", "weight").distinct().collect())  # a few pairs of small numbers
    of_shape = [F.when((F.col("stride") == s) & (F.col("weight") == w), seed_of(F.col("words"), F.col("at"), s, w)) for s, w in shapes]
    seeds = placed.select(F.coalesce(F.lit(None).cast("long"), *of_shape).alias("seed"), "item", F.col("at").alias("item_at"), F.size("words").alias("n")).distinct()
    seeds = materialize(seeds.groupBy("seed").agg(F.collect_list(F.struct("item", "item_at", "n")).alias("places")), "seeds")  # numbers only
    keep = [c for c in texts.columns if c != "text"]
    windows = F.array(*[F.when(F.size("words") - F.col("at") > s * (w - 1), seed_of(F.col("words"), F.col("at"), s, w)) for s, w in shapes]).cast("array<bigint>")
    cut = blocks(texts.select("row", "text"), BLOCK, max((s * (w - 1) for s, w in shapes), default=0))
    at_each = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.least(F.size("words"), F.lit(BLOCK)) - 1)))
    narrow = at_each.select("row", (F.col("base") + F.col("at")).alias("place"), F.explode(windows).alias("seed")).where(F.col("seed").isNotNull())
    if small(seeds, limit):
        hits = narrow.join(F.broadcast(seeds), "seed")
    else:
        hits = materialize(narrow.join(side(seeds.select("seed"), limit), "seed", "left_semi"), "seeded")
        common = hits.groupBy("seed").agg(F.count("*").alias("n"))
        hits = salted_join(hits, seeds, ["seed"], heavy(common, ["seed"], hits.count()))
    hits = hits.select("row", "place", F.explode("places").alias("p")).select("row", F.col("p.item").alias("item"), (F.col("place") - F.col("p.item_at")).alias("start"), F.col("p.n").alias("n"))
    # each alignment once, beside the block that it begins in; one that begins before its text is in the first
    places = max(BLOCK, items.agg(F.max(F.size("words"))).first()[0] or 0)
    met = materialize(hits.distinct().withColumn("base", (F.floor(F.greatest("start", F.lit(0)) / places) * places).cast("int")), "hits")
    again = blocks(texts.join(side(met.select("row").distinct(), limit), "row", "left_semi"), places, places)
    head = F.greatest(-F.col("start"), F.lit(0))
    faced = F.slice("words", F.greatest("start", F.lit(0)) - F.col("base") + 1, F.col("n") - head)
    near = again.join(side(met, limit), ["row", "base"]).select(*keep, "item", "start", faced.alias("faced"))
    aligned = near.join(side(items.select("item", F.col("words").alias("item_text")), limit), "item")
    same = F.zip_with(F.slice("item_text", head + 1, F.size("item_text")), "faced", lambda a, b: F.when(a == b, "1").otherwise("0"))
    out = aligned.select(*keep, "item", "start", F.size("item_text").alias("item_words"), F.array_join(same, "").alias("same"))
    out = out.withColumn("matched", F.length(F.translate("same", "0", "")))
    return out.where((F.col("matched") >= threshold * F.col("item_words")) | F.contains("same", F.lit("1" * MIN_RUN))).drop("same")


def small(df: DataFrame, limit: int) -> bool:
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a contaminating overlap, each judged by its own text; all columns stay."""
    key = fresh(docs, "__row")
    rows, _ = keyed(small_batches(docs), key)
    items, _ = kinds(benchmark)
    dirty = judged(rows.select(F.col(key).alias("row"), F.col("text").cast("string").alias("text")), items, MIN_OVERLAP, BROADCAST_BYTES)
    dirty = materialize(dirty.select(F.col("row").alias(key)).distinct(), "dirty")
    return rows.join(side(dirty), key, "left_anti").select(*docs.columns)


#: DuckDB SQL of overlaps(documents, benchmark) that seeds nothing: all alignments in which any token agrees are tried.
ORACLE_SQL = r"""
WITH items AS (
  SELECT DISTINCT item_id, w FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark) WHERE w[1] <> ''
), docs AS (
  SELECT doc_id, w, row_number() OVER () AS r FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents) WHERE w[1] <> ''
), itokens AS (
  SELECT item_id, w AS item, unnest(w) AS t, unnest(range(len(w))) AS pos FROM items
), dtokens AS (
  SELECT r, unnest(w) AS t, unnest(range(len(w))) AS pos FROM docs
), agreed AS (
  SELECT r, item_id, item, CAST(d.pos AS INTEGER) - CAST(i.pos AS INTEGER) AS start, count(*) AS m
  FROM dtokens d JOIN itokens i USING (t) GROUP BY ALL
), likely AS (
  SELECT * FROM agreed WHERE m >= 0.8 * len(item) OR m >= 13
), judged AS (
  SELECT d.doc_id, item_id, start, len(item) AS n, m, array_to_string(list_transform(range(1, len(item) + 1), lambda j: CASE WHEN start + j >= 1 AND start + j <= len(d.w) AND d.w[greatest(start + j, 1)] = item[j] THEN '1' ELSE '0' END), '') AS same
  FROM likely JOIN docs d USING (r)
)
SELECT doc_id, item_id, CAST(arg_max(start, (m, -start)) AS BIGINT) AS start, CAST(max(m) AS BIGINT) AS matched, CAST(arg_max(n, (m, -start)) AS BIGINT) AS item_words,
  CAST(max(m) AS DOUBLE) / arg_max(n, (m, -start)) AS overlap
FROM judged WHERE m >= 0.8 * n OR contains(same, '1111111111111') GROUP BY doc_id, item_id
"""
