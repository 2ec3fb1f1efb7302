"""Time-ordered target encoding over a dyadic time tree.

What a row may know of a value (an item, a vendor, a client) is how often it was met, and returned, strictly earlier and in
other folds.  Time is a whole number of microseconds from the first one on; a node (level, place) of a key's tree is a
stretch of time whose length is a power of two, and holds the key's counts by fold.  The time before a leaf is a disjoint
union of one node for each bit set in the leaf's number, so each leaf explodes into at most as many probes as its tree has
levels, which meet the nodes by equality and are summed; inside a leaf a running sum goes on to the microsecond.  Only left
children are ever asked for, so only these are stored.  All folds less the row's own are its history.

Trees are as tall as their keys need: leaves are meant to hold LEAF rows.  Keys of the usual size share one height; heavy
keys (more rows than LEAF_ROWS and than one in HEAVY_SHARE of all, so at most HEAVY_SHARE of them, which are broadcast)
get their own, and those with leaves fuller than that bound grow until they have none, at last to leaves of one microsecond.
Rows of one microsecond are no history of each other, so where even such a leaf is too full (a third of all lines may be one
sale's) its rows are dealt to several tasks, each with the leaf's counts.  So no task holds more of a key than a leaf.  A node is
asked for by each leaf below its right neighbour; nodes that are asked for very often are copied and their probes dealt to the copies.

A leaf's rows stream through a task in order of time behind a marker with the counts before the leaf; a batch of rows is in
memory at a time.  Shuffled: the rows once for each column, their leaves with nodes and probes, and the parents' sums by time and fold
with the rows that get their rates.  Nothing but the heights of heavy keys and crowded leaves is broadcast, and only a few counts
reach the driver.

Defined results: a null id of the columns is -1, an ordinary id; ids that the table of parents lacks, or whose parent is null, share one
parent; where that table repeats an id its least parent counts; rows without a time or a unit take no part and are not in the result;
repeated rows count as often as they stand; equal times are no history of each other; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scratch import in_own_session
from tidemark.llm import runtime
from tidemark.llm.runtime import heavy, salted_join

LEAF = 32
LEAF_ROWS = 50_000
#: Levels by which the tree of a key grows while one of its leaves is too full; twice as many each time.
GROW = 4
AT = ("t", "fold")
#: Most columns here are times, ids and sums that seldom repeat: a dictionary is built in vain.
PLAIN = {"parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Rate:
    """floor((scale * s + weight * p) / (n + weight)), or the prior p where nothing is known, in whole numbers."""

    scale: int = 1_000_000
    weight: int = 50
    prior: int = 500_000

    def of(self, n: Column, s: Column, p: Column) -> Column:
        return F.when(n < 1, p).otherwise(F.call_function("div", self.scale * s + self.weight * p, n + self.weight))


def micros(column: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as it reads, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(column.cast("timestamp"))
    days = F.unix_date(column.cast("date")).cast("long")
    seconds = F.call_function("date_part", F.lit("SECOND"), column)  # with its fraction
    return ((days * 24 + F.hour(column)) * 60 + F.minute(column)) * 60_000_000 + (seconds * 1_000_000).cast("long")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return runtime.materialize(df, tag, **PLAIN)


def sums(df: DataFrame, *keys: str | Column, more: list[Column] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *more)


def heights(events: DataFrame, total: int, bits: int) -> tuple[int, DataFrame | None]:
    """The height that all but heavy keys have, and (key, height) of these."""
    sizes = events.groupBy("key").agg(F.count("*").alias("m"))
    keys, most = sizes.agg(F.count("*"), F.max("m")).first()
    usual = min(bits, max(1, math.ceil(math.log2(max(1, total / keys / LEAF)))))
    bound = max(LEAF_ROWS, total // runtime.HEAVY_SHARE)
    if most <= bound:
        return usual, None
    tall = F.least(F.lit(bits), F.greatest(F.lit(usual), F.ceil(F.log2(F.col("m") / LEAF)))).cast("int")
    return usual, materialize(sizes.where(F.col("m") > bound).select("key", tall.alias("height")), "heights")


def leafed(events: DataFrame, usual: int, own: DataFrame | None, bits: int) -> DataFrame:
    """events with the height of their key's tree and their leaf."""
    if own is None:
        tall = events.withColumn("height", F.lit(usual))
    else:
        tall = events.join(F.broadcast(own), "key", "left").withColumn("height", F.coalesce("height", F.lit(usual)))  # at most HEAVY_SHARE narrow rows
    return tall.withColumn("leaf", F.call_function("shiftright", F.col("t"), F.lit(bits) - F.col("height")))


def leaves_of(events: DataFrame, total: int, bits: int, folds: int) -> tuple[DataFrame, DataFrame]:
    """events with their leaves, and the leaves with counts by fold; the trees of heavy keys grow until no leaf is too full."""
    usual, own = heights(events, total, bits)
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(folds) for c in ("n", "s")]
    bound = max(LEAF_ROWS, total // runtime.HEAVY_SHARE)
    grow = GROW
    while True:
        placed = leafed(events, usual, own, bits)
        leaves = materialize(placed.groupBy("key", "height", "leaf").agg(F.count("*").alias("rows"), *by_fold), "leaves")
        if own is None or not leaves.where((F.col("rows") > bound) & (F.col("height") < bits)).limit(1).count():
            return placed, leaves
        full = leaves.where(F.col("rows") > bound).select("key").distinct().withColumn("full", F.lit(grow))
        own = materialize(own.join(full, "key", "left").select("key", F.least(F.lit(bits), F.col("height") + F.coalesce("full", F.lit(0))).alias("height")), "heights")
        grow *= 2


def before_leaves(leaves: DataFrame, folds: int) -> DataFrame:
    """key, leaf and the counts by fold of all time before the leaf, from the nodes of the key's tree."""
    counts = [f"{c}{f}" for f in range(folds) for c in ("n", "s")]
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    place = F.call_function("shiftright", F.col("leaf"), F.col("level"))
    left, right = place % 2 == 0, place % 2 == 1
    keys = ["key", "level", "node"]
    nodes = levels.where(left).groupBy("key", "level", place.alias("node")).agg(*[F.sum(c).alias(c) for c in counts])
    probes = levels.where(right).select("key", "leaf", "level", (place - 1).alias("node"))
    parts = None
    if leaves.count() > runtime.HEAVY_ROWS:  # else no node is asked for that often
        asked = materialize(probes.groupBy(*keys).agg(F.count("*").alias("n")), "asked")
        parts = heavy(asked, keys, asked.agg(F.sum("n")).first()[0] or 0)
    return salted_join(probes, nodes, keys, parts).groupBy("key", "leaf").agg(*[F.sum(c).alias(c) for c in counts])


def schema_with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(more).fields])


def sum_leaves(folds: int, parent: bool):
    """Over rows sorted by key, leaf and time, each leaf led by a marker (fold -1, known: the counts before it): the rows with hn and hs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, tie = np.zeros(2 * folds, np.int64), np.zeros(2 * folds, np.int64)  # of the leaf at hand: up to its last moment, and in it
        last_t, last_parent = -1, 0
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            take = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            t, fold = take("t"), take("fold").astype(np.int64)
            marker = fold < 0
            ones = np.zeros((2 * folds, m + 1), np.int64)
            rows = np.flatnonzero(~marker)
            ones[2 * fold[rows], rows + 1], ones[2 * fold[rows] + 1, rows + 1] = take("n")[rows], take("s")[rows]
            sums = ones.cumsum(1)
            lead = np.flatnonzero(marker)
            told = batch.column("known").filter(pa.array(marker)).flatten().to_numpy(zero_copy_only=False).reshape(len(lead), 2 * folds)
            known, starts = np.vstack([before + tie, told]), np.concatenate([[0], lead])
            group = np.cumsum(marker)
            moment = np.ones(m, bool)
            moment[1:] = (t[1:] != t[:-1]) | marker[1:]
            moment = np.maximum.accumulate(np.where(moment, np.arange(m), 0))
            past = sums[:, moment] - sums[:, starts[group]] + known[group].T
            goes_on = not marker[0] and t[0] == last_t
            if goes_on:  # the moment at which the last batch ended
                past[:, moment == 0] -= tie[:, None]
            own = 2 * np.maximum(fold, 0)
            hn, hs = past[0::2].sum(0) - past[own, np.arange(m)], past[1::2].sum(0) - past[own + 1, np.arange(m)]
            at = int(moment[-1])
            now = sums[:, m] - sums[:, at]
            tie = tie + now if goes_on and at == 0 else now
            before, last_t = past[:, -1].copy(), int(t[-1])
            keep = pa.array(~marker)
            columns = [batch.column(c) for c in batch.schema.names if c not in ("key", "leaf", "known", "parent_key")]
            names = [c for c in batch.schema.names if c not in ("key", "leaf", "known", "parent_key")]
            if parent:
                parents = np.concatenate([[last_parent], take("parent_key")[lead]])
                columns, names, last_parent = [*columns, pa.array(parents[group])], [*names, "parent_key"], int(parents[-1])
            out = pa.RecordBatch.from_arrays([*columns, pa.array(hn), pa.array(hs)], [*names, "hn", "hs"])
            yield out.filter(keep)

    return run


def history(rows: DataFrame, key: Column, bits: int, folds: int, parents: DataFrame | None = None) -> DataFrame:
    """rows (t, fold, n, s and more, all of them whole numbers) with hn and hs, the sums of n and s over rows of the same key, other folds and earlier times.

    parents: key and parent_key, each key once; adds parent_key, -1 for keys that it lacks.
    """
    events = rows.select(key.alias("key"), *rows.columns)
    total = events.count()  # from the files' footers
    more = "parent_key bigint, hn bigint, hs bigint" if parents is not None else "hn bigint, hs bigint"
    if not total:
        return rows.sparkSession.createDataFrame([], schema_with(rows, more))
    placed, leaves = leaves_of(events, total, bits, folds)
    counts = [f"{c}{f}" for f in range(folds) for c in ("n", "s")]
    led = leaves.select("key", "leaf", "height", "rows").join(before_leaves(leaves, folds), ["key", "leaf"], "left")
    led = led.withColumn("known", F.array(*[F.coalesce(c, F.lit(0)).cast("long") for c in counts])).drop(*counts)
    led = led.withColumn("parent_key", F.lit(0).cast("long")) if parents is None else led.join(parents, "key", "left").withColumn("parent_key", F.coalesce("parent_key", F.lit(-1).cast("long")))
    bound = max(LEAF_ROWS, total // runtime.HEAVY_SHARE)
    # a leaf of one microsecond can't be cut by time; its rows are no history of each other, so they may be dealt to several tasks
    crowds = materialize(leaves.where(F.col("rows") > bound).select("key", "leaf", F.ceil(F.col("rows") / bound).cast("int").alias("copies")), "crowds")
    if crowds.limit(1).count():
        of = F.broadcast(crowds)  # at most HEAVY_SHARE narrow rows
        led = led.join(of, ["key", "leaf"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        placed = placed.join(of, ["key", "leaf"], "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("copies")), F.lit(0)).cast("int"))
    else:
        led, placed = led.withColumn("copy", F.lit(0)), placed.withColumn("copy", F.lit(0))
    blank = {"t": F.lit(-1).cast("long"), "fold": F.lit(-1)}
    markers = led.select("key", "leaf", "copy", "known", "parent_key", *[blank.get(c, F.lit(0)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    dealt = placed.select("key", "leaf", "copy", F.lit(None).cast("array<bigint>").alias("known"), F.lit(0).cast("long").alias("parent_key"), *rows.columns).unionByName(markers)
    dealt = dealt.repartition("key", "leaf", "copy").sortWithinPartitions("key", "leaf", "copy", "t").drop("copy")
    return dealt.mapInArrow(sum_leaves(folds, parents is not None), schema_with(rows, more))


def numbered(parents: DataFrame) -> DataFrame:
    """key, parent_key of parents (key, parent): a number for each parent; keys without one are left out."""
    once = materialize(parents.where("parent is not null").select(F.col("key").cast("long").alias("key"), F.col("parent").cast("string").alias("parent")).groupBy("key").agg(F.min("parent").alias("parent")), "parents")
    names = materialize(once.select("parent").distinct().withColumn("parent_key", F.monotonically_increasing_id()), "names")
    return materialize(once.join(names, "parent").select("key", "parent_key"), "parents")


def rated(rows: DataFrame, column: str, parents: DataFrame, bits: int, folds: int, rate: Rate) -> DataFrame:
    """rows (t, fold, n, s, p, the rate of all history at that time and fold, and ids) with <column>_n and <column>_rate."""
    name = column.removesuffix("_id")
    known = materialize(history(rows, F.col(column), bits, folds, numbered(parents)), "history")
    above = materialize(sums(known, F.col("parent_key").alias("of"), *AT), "above")
    above = history(above, F.col("of"), bits, folds).select(F.col("of").alias("parent_key"), *AT, F.col("hn").alias("pn"), F.col("hs").alias("ps"))
    both = known.join(above, ["parent_key", *AT])
    prior = rate.of(F.col("pn"), F.col("ps"), F.col("p"))
    return both.select(*rows.columns, F.col("hn").alias(f"{name}_n"), rate.of(F.col("hn"), F.col("hs"), prior).alias(f"{name}_rate"))


def encode(
    lines: DataFrame, units: DataFrame, unit: str, at: str, label: Column, line_ids: dict[str, DataFrame], unit_ids: dict[str, DataFrame], folds: int = 5, rate: Rate | None = None
) -> DataFrame:
    """A row for each unit and ids of its lines: n_lines, n_returned (lines with the label), and <id>_n, <id>_rate for each id.

    lines and units meet on ``unit`` (once in units); ``at`` is the time of a unit, whose fold is the CRC-32 of its digits
    modulo ``folds``.  line_ids and unit_ids map id columns of either to their parents (key, parent).
    """
    rate = rate or Rate()
    tidy = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # shuffle files of a step go when it ends
    lines, units = in_own_session(lines, tidy), in_own_session(units, tidy)
    id_of = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long"))
    digits = F.col(unit).cast("long")
    kind = dict(units.dtypes)[at]
    told = units.where(F.col(unit).isNotNull() & F.col(at).isNotNull()).select(
        digits.alias("__unit"), micros(F.col(at), kind).alias("__us"), (F.crc32(digits.cast("string").cast("binary")) % folds).cast("int").alias("fold"), *[id_of(c).alias(c) for c in unit_ids]
    )
    first, last = told.agg(F.min("__us"), F.max("__us")).first()
    bits = max(1, (0 if first is None else last - first).bit_length())
    told = told.withColumn("t", F.col("__us") - F.lit(first or 0).cast("long")).drop("__us")
    counted = lines.where(F.col(unit).isNotNull()).select(digits.alias("__unit"), *[id_of(c).alias(c) for c in line_ids], F.lit(1).cast("long").alias("n"), F.when(label, 1).otherwise(0).cast("long").alias("s"))
    whole = materialize(sums(counted, "__unit").join(told, "__unit"), "units")
    every = history(materialize(sums(whole, *AT), "all"), F.lit(0).cast("long"), bits, folds)
    all_rate = rate.of(F.col("hn"), F.col("hs"), F.lit(rate.prior).cast("long"))
    rows = materialize(whole.join(every.select(*AT, all_rate.alias("p")), list(AT)), "units")
    for c, parents in unit_ids.items():
        rows = materialize(rated(rows, c, parents, bits, folds, rate), "units")
    rows = materialize(sums(counted, "__unit", *line_ids).join(rows.drop("n", "s"), "__unit"), "rows")
    for k, (c, parents) in enumerate(line_ids.items()):
        rows = rated(rows, c, parents, bits, folds, rate)
        rows = rows if k == len(line_ids) - 1 else materialize(rows, "rows")
    names = [f"{c.removesuffix('_id')}_{x}" for c in (*line_ids, *unit_ids) for x in ("n", "rate")]
    return rows.select(F.col("__unit").alias(unit), *line_ids, F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), *names)


def shop_rates(sale_lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """The returned rate of items (by kind), vendors (by nation) and clients (by segment) as known when each sale was made."""
    of = lambda df, key, parent: df.select(F.col(key).alias("key"), F.col(parent).alias("parent"))
    return encode(
        sale_lines, sales, "sale_id", "sold_at", F.col("flag") == "returned",
        {"item_id": of(items, "item_id", "kind"), "vendor_id": of(vendors, "vendor_id", "nation_id")}, {"client_id": of(clients, "client_id", "segment")},
    )


#: Windows over all lines instead of trees; the CRC-32 is worked out bit by bit.
ORACLE_SQL = """
WITH digits AS (SELECT sale_id, sold_at, coalesce(client_id, -1) AS client_id, CAST(sale_id AS VARCHAR) AS d FROM sales WHERE sold_at IS NOT NULL AND sale_id IS NOT NULL),
sold AS (
  SELECT sale_id, sold_at, client_id,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 5 AS fold
  FROM digits
),
rows_ AS (
  SELECT l.sale_id, s.sold_at, s.fold, coalesce(l.item_id, -1) AS item_id, coalesce(l.vendor_id, -1) AS vendor_id, s.client_id, i.kind, v.nation_id, c.segment,
    CASE WHEN l.flag = 'returned' THEN 1 ELSE 0 END AS r
  FROM sale_lines l JOIN sold s ON l.sale_id = s.sale_id
  LEFT JOIN items i ON i.item_id = coalesce(l.item_id, -1) LEFT JOIN vendors v ON v.vendor_id = coalesce(l.vendor_id, -1) LEFT JOIN clients c ON c.client_id = s.client_id
),
seen AS (
  SELECT *,
    count(*) OVER a - count(*) OVER fa AS an, coalesce(sum(r) OVER a, 0) - coalesce(sum(r) OVER fa, 0) AS as_,
    count(*) OVER k - count(*) OVER fk AS kn, coalesce(sum(r) OVER k, 0) - coalesce(sum(r) OVER fk, 0) AS ks,
    count(*) OVER o - count(*) OVER fo AS on_, coalesce(sum(r) OVER o, 0) - coalesce(sum(r) OVER fo, 0) AS os,
    count(*) OVER g - count(*) OVER fg AS gn, coalesce(sum(r) OVER g, 0) - coalesce(sum(r) OVER fg, 0) AS gs,
    count(*) OVER i - count(*) OVER fi AS item_n, coalesce(sum(r) OVER i, 0) - coalesce(sum(r) OVER fi, 0) AS is_,
    count(*) OVER v - count(*) OVER fv AS vendor_n, coalesce(sum(r) OVER v, 0) - coalesce(sum(r) OVER fv, 0) AS vs,
    count(*) OVER c - count(*) OVER fc AS client_n, coalesce(sum(r) OVER c, 0) - coalesce(sum(r) OVER fc, 0) AS cs
  FROM rows_
  WINDOW
    a AS (ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    fa AS (PARTITION BY fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    k AS (PARTITION BY kind ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    fk AS (PARTITION BY kind, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    o AS (PARTITION BY nation_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    fo AS (PARTITION BY nation_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    g AS (PARTITION BY segment ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    fg AS (PARTITION BY segment, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    i AS (PARTITION BY item_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    fi AS (PARTITION BY item_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    v AS (PARTITION BY vendor_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    fv AS (PARTITION BY vendor_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    c AS (PARTITION BY client_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    fc AS (PARTITION BY client_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)
),
p0 AS (SELECT *, CAST(CASE WHEN an < 1 THEN 500000 ELSE (1000000 * as_ + 50 * 500000) // (an + 50) END AS BIGINT) AS p FROM seen),
p1 AS (
  SELECT *, CASE WHEN kn < 1 THEN p ELSE (1000000 * ks + 50 * p) // (kn + 50) END AS kp, CASE WHEN on_ < 1 THEN p ELSE (1000000 * os + 50 * p) // (on_ + 50) END AS op,
    CASE WHEN gn < 1 THEN p ELSE (1000000 * gs + 50 * p) // (gn + 50) END AS gp
  FROM p0
)
SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, CAST(sum(r) AS BIGINT) AS n_returned,
  max(item_n) AS item_n, CAST(max(CASE WHEN item_n < 1 THEN kp ELSE (1000000 * is_ + 50 * kp) // (item_n + 50) END) AS BIGINT) AS item_rate,
  max(vendor_n) AS vendor_n, CAST(max(CASE WHEN vendor_n < 1 THEN op ELSE (1000000 * vs + 50 * op) // (vendor_n + 50) END) AS BIGINT) AS vendor_rate,
  max(client_n) AS client_n, CAST(max(CASE WHEN client_n < 1 THEN gp ELSE (1000000 * cs + 50 * gp) // (client_n + 50) END) AS BIGINT) AS client_rate
FROM p1 GROUP BY sale_id, item_id, vendor_id
"""
