"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

A line is a sequence of units and the edit distance counts units: its blank-separated words where it has ``NEAR_WORDS`` or
more, else, where it has ``NEAR_CHARS`` characters or more, its characters (scripts without blanks, long tokens).  The edit
bound of such lines is one unit, that of shorter lines is none.  A line goes if a line within the bound stands earlier, in
the order of rows and line numbers.  Lines of fewer than ``MIN_WORDS`` words and ``MIN_CHARS`` characters always stay:
they are brackets, headings, single answers.  Both floors are properties of one line and hold at any size of the input.

Everything works on distinct lines.  A sieve that loses nothing comes first: two lines one edit apart agree in their
first or their last half, so only lines that share the hash of a half with another are expanded.  Those emit themselves
and every variant with one unit deleted as hashed keys, which are joined: two lines one substitution apart leave the same
variant at the same place; a line one insertion longer leaves a variant that is the other line.  A group of equal keys is
reduced to its earliest line before the join back, so a group of any size gives as many rows as it has and no pairs.  The
distance of each line and its earliest neighbour is then verified unit by unit.

Scale: shuffled are narrow rows (hashes, positions) and the expanded variants of the lines that pass the sieve.  Counts are
made map-side first; a key with more rows than one task should have is dealt to several on its way back.  The units of
expanded lines come from a second read of the texts against the positions sought, and the lines that go meet the texts in
a third; both sides are written tables that are broadcast while their measured bytes are under a bound and joined by a
shuffle of the texts beyond.

Defined results: a row is told apart by its id and its content, so rows that share an id, or have none, keep or lose lines
each by its own text, in the order of id (null last) and content; rows that agree in both are one text and keep or lose the
same lines.  Null or empty text has no line to drop and stays as it is; an empty table gives no rows; extra columns stay,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import fresh, heavy, keyed, materialize, salted_join, side, small_batches

BLANKS = r"[ \t\r\f\x0B]+"
MIN_WORDS, MIN_CHARS = 3, 16
NEAR_WORDS, NEAR_CHARS = 8, 64


def place(row: Column, line: Column) -> Column:
    """The order of lines as one number that hash aggregation can keep in place."""
    return row.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + line.cast("decimal(11,0)")


def words_of(line: Column) -> Column:
    """The words of a line; a line without any gives one empty word."""
    return F.split(F.btrim(line, F.lit(" \t\r\f\x0b")), BLANKS, -1)


def units_of(words: Column) -> Column:
    """The units of a line that may have neighbours: words, or characters with a mark that no word holds."""
    each = F.transform(F.regexp_extract_all(F.array_join(words, " "), F.lit("(?s)."), F.lit(0)), lambda c: F.concat(F.lit("\n"), c))
    return F.when(F.size(words) >= NEAR_WORDS, words).otherwise(each)


def without(words: Column, i: Column) -> Column:
    """The words but that at place i, counted from 0."""
    return F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words)))


def split_lines(texts: DataFrame) -> DataFrame:
    """row, line (number from 0) and raw text of every line of texts (row, text)."""
    return texts.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))


def hashed(texts: DataFrame) -> DataFrame:
    """Hashes of each line that takes part, and for lines that may have neighbours those of their halves."""
    words, chars = F.col("words"), F.col("chars")
    found = split_lines(texts).select("row", "line", words_of(F.col("raw")).alias("words"))
    found = found.select("row", "line", "words", F.when(F.size(words) < NEAR_WORDS, F.array_join(words, " ")).alias("chars"))
    found = found.where((F.size(words) >= MIN_WORDS) | (F.length(chars) >= MIN_CHARS))
    n = F.coalesce(F.length(chars), F.size(words))

    def half(size: Column, last: bool) -> Column:
        by_words = F.slice(words, n - size + 1, size) if last else F.slice(words, F.lit(1), size)
        by_chars = F.substring(chars, n - size + 1, size) if last else F.substring(chars, 1, size)
        side_of = F.lit(int(last))
        return F.when(chars.isNull(), F.xxhash64(side_of, size, by_words)).when(n >= NEAR_CHARS, F.xxhash64(side_of, size, by_chars))

    large, small = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return found.select(
        "row", "line", F.xxhash64("words").alias("h1"), F.hash("words").alias("h2"),
        half(large, False).alias("a"), half(large, True).alias("b"), F.when(n % 2 == 0, half(small, False)).alias("c"), F.when(n % 2 == 0, half(small, True)).alias("d"),
    )


def sifted(distinct: DataFrame, rows: int) -> DataFrame:
    """first (place) of the lines that share a half with another line, and whether they share a first and a last half."""
    halves = F.array(*[F.struct(F.lit(last).alias("last"), F.col(c).alias("key")) for c, last in (("a", False), ("b", True), ("c", False), ("d", True))])
    keys = distinct.where("a is not null").select("first", F.explode(halves).alias("k")).select("first", "k.*").where("key is not null")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = salted_join(keys, shared.select("key"), ["key"], heavy(shared, ["key"], rows))
    return met.groupBy("first").agg(F.max(~F.col("last")).alias("head"), F.max("last").alias("tail"))


def fetched(texts: DataFrame, sought: DataFrame) -> DataFrame:
    """first, units, head and tail of the lines sought; a row number stands for one content, so a place for one line."""
    found = split_lines(texts).select(place(F.col("row"), F.col("line")).alias("first"), "raw").join(side(sought), "first")
    return found.dropDuplicates(["first"]).select("first", units_of(words_of(F.col("raw"))).alias("units"), "head", "tail")


def neighbours(expanded: DataFrame) -> DataFrame:
    """first of each line with a neighbour at an earlier place, and least, the place of its earliest neighbour.

    A line that shares its first half with another is one edit off behind that half only, and the other way about, so
    units are deleted there only.
    """
    n = F.size("units")
    middle = F.floor((n - 1) / 2).cast("int")
    begin, end = F.when(F.col("tail"), 0).otherwise(middle), F.when(F.col("head"), n - 1).otherwise(n - middle - 1)
    variants = expanded.select("first", "units", F.explode(F.sequence(begin, end)).alias("i")).select("first", "i", F.xxhash64(without(F.col("units"), F.col("i"))).alias("key"))
    whole = expanded.select("first", F.lit(-1).alias("i"), F.xxhash64("units").alias("key"))
    keyed_rows = materialize(variants.unionByName(whole), "variants")
    rows = keyed_rows.count()
    groups = keyed_rows.groupBy("key", "i").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    same = F.struct("i", "least", "n")
    each = groups.groupBy("key").agg(
        F.min(F.when(F.col("i") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("least"))).alias("cut"), F.sum("n").alias("n"),
        F.collect_list(F.when((F.col("i") >= 0) & (F.col("n") > 1), same)).alias("same"),  # at most one for each place of a line
    )
    each = materialize(each.where("n > 1"), "meets")
    both = "whole is not null and cut is not null"
    # what a row meets: the earliest with the same unit deleted; the line that its variant is; the variant that it is
    meets = (
        each.select("key", F.explode("same").alias("s")).select("key", F.col("s.i").alias("at"), "s.least")
        .unionByName(each.where(both).select("key", F.lit(-1).alias("at"), F.col("cut").alias("least")))
        .unionByName(each.where(both).select("key", F.lit(-2).alias("at"), F.col("whole").alias("least")))
    )
    met = salted_join(keyed_rows, meets, ["key"], heavy(each, ["key"], rows))
    met = met.where(((F.col("i") == F.col("at")) | ((F.col("at") == -2) & (F.col("i") >= 0))) & (F.col("least") < F.col("first")))
    return met.groupBy("first").agg(F.min("least").alias("least"))


def within_one(x: Column, y: Column) -> Column:
    """Whether two arrays of units are at most one edit apart."""
    long, short = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    same = F.size(F.filter(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), lambda d: d)) <= 1
    agree = F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda a, b: F.when(a.eqNullSafe(b), "1").otherwise("0"))
    first = F.instr(F.concat(F.array_join(agree, ""), F.lit("0")), "0") - 1  # the first place at which they differ is the unit to delete
    return F.when(F.size(x) == F.size(y), same).when(F.size(long) == F.size(short) + 1, without(long, first) == short).otherwise(False)


def removed_lines(texts: DataFrame) -> DataFrame:
    """row and the sorted numbers of the lines that go, for rows of texts (row, text) that lose any."""
    all_lines = materialize(hashed(texts), "lines")
    rows = all_lines.count()
    where = place(F.col("row"), F.col("line"))
    least = [F.min(c).alias(c) for c in "abcd"]
    distinct = materialize(all_lines.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n"), *least), "distinct")
    expanded = materialize(fetched(texts, materialize(sifted(distinct, rows), "sifted")), "expanded").select("first", "units", "head", "tail")
    pairs = materialize(neighbours(expanded), "pairs")
    units = expanded.select("first", "units")
    hubs = heavy(pairs.groupBy("least").agg(F.count("*").alias("n")), ["least"], rows)
    judged = (
        salted_join(pairs.join(units, "first"), units.select(F.col("first").alias("least"), F.col("units").alias("other")), ["least"], hubs)
        .where(within_one(F.col("units"), F.col("other")))
        .select("first", F.lit(True).alias("close"))
    )
    fate = materialize(distinct.join(materialize(judged, "close"), "first", "left").where("n > 1 or close").select("h1", "h2", "first", "n", F.coalesce("close", F.lit(False)).alias("close")), "fate")
    met = salted_join(all_lines.select("row", "line", "h1", "h2"), fate.drop("n"), ["h1", "h2"], heavy(fate, ["h1", "h2"], rows))
    gone = met.where(F.col("close") | (where > F.col("first")))
    return gone.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("lines"))  # bounded by the lines of one text


def kept_lines(text: Column, gone: Column) -> Column:
    """text less the lines at the places of gone (sorted), cut out between these, so in time that is linear in the lines."""

    def between(x: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), x["gone"], F.array(F.size(x["lines"])))
        parts = F.transform(F.sequence(F.lit(0), F.size(x["gone"])), lambda j: F.struct(F.get(edges, j).alias("a"), F.get(edges, j + 1).alias("b")))
        return F.flatten(F.transform(parts, lambda p: F.slice(x["lines"], p["a"] + 2, p["b"] - p["a"] - 1)))

    once = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), gone.alias("gone")))  # a lambda's argument is evaluated once
    return F.array_join(F.get(F.transform(once, between), F.lit(0)), "\n")


def deduplicate(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """All rows and columns of docs with the text less its duplicate lines, and two columns beside them whose names are
    returned: the number of lines and of those removed."""
    key, lost, total, removed = (fresh(docs, c) for c in ("__row", "__gone", "__n_lines", "__n_removed"))
    rows, _ = keyed(small_batches(docs), key)
    texts = rows.select(F.col(key).alias("row"), F.col("text").cast("string").alias("text"))
    gone = materialize(removed_lines(texts), "gone").select(F.col("row").alias(key), F.col("lines").alias(lost))
    joined = rows.join(side(gone), key, "left")
    text = F.col("text").cast("string")
    done = joined.select(
        *[F.when(F.col(lost).isNull(), text).otherwise(kept_lines(text, F.col(lost))).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias(total),
        F.coalesce(F.size(F.col(lost)), F.lit(0)).cast("long").alias(removed),
    )
    return done, total, removed


def digest(docs: DataFrame) -> DataFrame:
    done, total, removed = deduplicate(docs)
    return done.select(
        "doc_id", F.col(total).alias("n_lines"), F.col(removed).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's form: a document that loses all it had goes; n_chars, where there is one, follows the text."""
    done, _, removed = deduplicate(docs)
    done = done.where((F.col(removed) == 0) | (F.length(F.trim("text")) > 0))
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


#: DuckDB SQL of digest(documents): pairs are sought by equal halves and verified by the same distance.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS r
  FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
), numbered AS (
  SELECT r, unnest(ls) AS l, unnest(range(len(ls))) AS line FROM (SELECT r, string_split(text, chr(10)) AS ls FROM texts)
), worded AS (
  SELECT r, line, list_filter(string_split_regex(l, '[ \t\r\f\x0B]+'), lambda w: w <> '') AS words FROM numbered
), lined AS (
  SELECT *, array_to_string(words, ' ') AS l FROM worded WHERE len(words) >= 3 OR length(array_to_string(words, ' ')) >= 16
), firsts AS (
  SELECT words, l, min((r, line)) AS first FROM lined GROUP BY words, l
), near AS (
  SELECT l, first, units, len(units) AS n FROM (
    SELECT l, first, CASE WHEN len(words) >= 8 THEN words WHEN length(l) >= 64 THEN list_transform(range(1, length(l) + 1), lambda i: chr(10) || l[i]) END AS units FROM firsts)
  WHERE units IS NOT NULL
), halves AS (
  SELECT DISTINCT l, units, first, n, (side, m, CASE WHEN side = 0 THEN units[1:m] ELSE units[n - m + 1:n] END) AS k
  FROM (SELECT *, unnest([n // 2, (n - 1) // 2]) AS m FROM near), (VALUES (0), (1)) s(side)
), pairs AS (
  SELECT DISTINCT x.l, x.units AS w, y.units AS o FROM halves x JOIN halves y ON x.k = y.k AND y.first < x.first
), close AS (
  SELECT DISTINCT l FROM pairs
  WHERE (len(w) = len(o) AND len(list_filter(range(1, len(w) + 1), lambda i: w[i] <> o[i])) <= 1)
     OR (len(w) = len(o) + 1 AND len(list_filter(range(1, len(w) + 1), lambda i: list_concat(w[1:i - 1], w[i + 1:len(w)]) = o)) > 0)
     OR (len(o) = len(w) + 1 AND len(list_filter(range(1, len(o) + 1), lambda i: list_concat(o[1:i - 1], o[i + 1:len(o)]) = w)) > 0)
), gone AS (
  SELECT x.r, x.line FROM lined x JOIN firsts f ON x.l = f.l
  WHERE (x.r, x.line) > f.first OR x.l IN (SELECT l FROM close)
), lost AS (
  SELECT r, list(DISTINCT line) AS g FROM gone GROUP BY r
), done AS (
  SELECT t.doc_id, t.text, g, string_split(t.text, chr(10)) AS ls FROM texts t LEFT JOIN lost USING (r)
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(ls) AS BIGINT) END AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN x.text
    ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(g, i - 1)), lambda i: ls[i]), chr(10)) END) AS kept_sha256
FROM documents d JOIN done x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND coalesce(d.text, '') = x.text
"""
