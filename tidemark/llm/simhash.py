"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: majority bits of the XXH64 of all word shingles, computed in a map.  Equal fingerprints collapse first, so
what follows works on distinct fingerprints, whatever the size of a group of copies.  These are dealt into tiles by
population count and hash; a pair of tiles is compared only if its population counts differ by no more than the radius.
Inside a pair the rows are ordered by the counts of their four 16-bit quarters, and only quarters whose counts differ by
the radius in sum meet under exclusive-or and bit count.  Each pair of tiles leaves a spanning forest of its links, never
the links themselves, so a group of near copies costs its size.  Components come from alternating star contraction.

The work grows with the square of distinct fingerprints that may meet, as the method has it.

Similarity groups (the pipeline's stage) use the same comparison over wide fingerprints: WIDTH words of 64 bits over the
set of five-word shingles, whose differing bits tell a Jaccard similarity of SIMILAR from an unrelated text.  Two sets of
that similarity differ in a share of 0.157 of the bits at most (0.19 for sets of up to FEW shingles), so radii at four
standard deviations above lose about one link in ten thousand at the very threshold and none much above.  Tiles hold sets of like sizes, as sets
whose sizes differ by more than the similarity allows can't be linked.  What is linked is then confirmed on whole sets (``jaccard``).

Shuffled: one narrow row per fingerprint, the tiles (eight bytes a word for each tile they meet), the forests; for similarity
groups the shingle sets of candidates.

Defined results: null or empty text has no shingle and fingerprint zero, linked like any other; a text with fewer words
than a shingle is one shingle; repeated rows each get their row; a null id takes no part in the smallest id of its
component; an empty table gives no rows; extra columns are ignored; very long texts are met whole, their hashes (eight bytes a word)
held one text at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jaccard import PERCENT, TILE_HASHES, components, exact_components, hook, set_digest, shingle_hashes, shingle_set
from tidemark.llm.runtime import fresh, heavy, keyed, materialize, salted_join, session_conf, side, small_batches

#: The least Jaccard similarity of near copies in the pipeline.
SIMILAR = PERCENT / 100
WIDTH = 4
FEW = 5
#: Most bits that may differ in the first word and in all, for sets of up to FEW shingles and for larger ones.
NEAR_BITS = {True: (25, 76), False: (22, 64)}


def fingerprint(hashes: np.ndarray, step: int = 1 << 14) -> int:
    """Bit b is set if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (a signed 64-bit number) of every row."""

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), print_of(F.col("text").cast("string")).alias("fp"))


def tile_forest(a: np.ndarray, b: np.ndarray, radius: int, buffer: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, root) of a spanning forest of the links within radius between two tiles of unsigned numbers."""

    def quartered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        counts = np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)
        code = counts @ np.array([1 << 15, 1 << 10, 1 << 5, 1], np.int64)
        order = np.argsort(code, kind="stable")
        _, at = np.unique(code[order], return_index=True)
        return x[order], counts[order][at], at, np.append(at[1:], len(x))

    a, count_a, from_a, to_a = quartered(np.ascontiguousarray(a, "<u8"))
    b, count_b, from_b, to_b = quartered(np.ascontiguousarray(b, "<u8"))
    both, label = np.concatenate([a, b]), np.arange(len(a) + len(b))
    us, vs, held = [], [], 0
    for k in range(len(from_a)):
        near = np.flatnonzero(np.abs(count_b - count_a[k]).sum(1) <= radius)
        if not len(near):
            continue
        other = np.concatenate([np.arange(from_b[j], to_b[j]) for j in near])
        left = a[from_a[k] : to_a[k]]
        for at in range(0, len(left), step := max(1, (1 << 22) // len(other))):
            i, j = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ b[other][None, :]) <= radius)
            if len(i):
                us.append(i + from_a[k] + at)
                vs.append(other[j] + len(a))
                held += len(i)
                if held > buffer:
                    label, us, vs, held = hook(label, np.concatenate(us), np.concatenate(vs)), [], [], 0
    if us:
        label = hook(label, np.concatenate(us), np.concatenate(vs))
    child = np.flatnonzero((label != np.arange(len(label))) & (both != both[label]))
    return both[child].view("<i8"), both[label[child]].view("<i8")


def tile_pairs(rows: DataFrame, cell: Column, values: list[str], reach: Callable[[int], range], tile: int) -> DataFrame:
    """left and right: the values of all pairs of tiles that may hold links, each tile's rows end to end in one array.

    Rows are dealt by ``cell`` (a small number; cells x and y >= x meet if y is in reach(x)) and by hash where a cell has
    more than ``tile`` rows.
    """
    spark = rows.sparkSession
    celled = rows.select(*values, cell.alias("cell"))
    count = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    tiles = {c: -(-n // tile) for c, n in count.items()}
    split = F.lit(1)
    for c, n in tiles.items():
        if n > 1:
            split = F.when(F.col("cell") == c, n).otherwise(split)
    dealt = celled.withColumn("sub", F.pmod(F.xxhash64(values[0]), split).cast("int"))
    blocks = materialize(dealt.groupBy("cell", "sub").agg(F.flatten(F.collect_list(F.array(*values))).alias("held")), "tiles")
    near = [(x, y) for x in tiles for y in reach(x) if y in tiles]
    n = sum(tiles[x] * tiles[y] for x, y in near)
    name = blocks.select("cell", "sub")
    pairs = spark.createDataFrame(near, "x int, y int").join(name.select(F.col("cell").alias("x"), F.col("sub").alias("s")), "x")
    pairs = pairs.join(name.select(F.col("cell").alias("y"), F.col("sub").alias("t")), "y").where("x < y or s <= t")
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n, 20_000))
    return (
        pairs.join(blocks.select(F.col("cell").alias("x"), F.col("sub").alias("s"), F.col("held").alias("left")), ["x", "s"])
        .join(blocks.select(F.col("cell").alias("y"), F.col("sub").alias("t"), F.col("held").alias("right")), ["y", "t"])
        .repartition(spread, "x", "s", "y", "t")
        .select("left", "right")
    )


def compared(pairs: DataFrame, forest: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], batch: int, schema: str = "u long, v long") -> DataFrame:
    """What ``forest`` makes of all pairs of tiles."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for x, y in zip(rows["left"], rows["right"], strict=True):
                found = forest(np.asarray(x, np.int64), np.asarray(y, np.int64))
                yield pd.DataFrame({c.split()[0]: values for c, values in zip(schema.split(", "), found, strict=True)})

    with session_conf(pairs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)):
        return materialize(pairs.mapInPandas(compare, schema), "links")


def links(distinct: DataFrame, radius: int, tile: int = 1 << 15) -> DataFrame:
    """A forest (u, v) over distinct fingerprints whose trees span the groups linked within the radius."""
    pairs = tile_pairs(distinct, F.bit_count("fp").cast("int"), ["fp"], lambda pop: range(pop, pop + radius + 1), tile)
    return compared(pairs, lambda x, y: tile_forest(x.view(np.uint64), y.view(np.uint64), radius), 16)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(fingerprints(docs, words), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return salted_join(prints, of, ["fp"], heavy(distinct, ["fp"], prints.count())).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_print(hashes: np.ndarray) -> list[int]:
    """WIDTH words of majority bits, each over the hashes mixed in its own way."""
    out = []
    for k in range(1, WIDTH + 1):
        h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(fingerprint(h ^ (h >> np.uint64(31))))
    return out


def wide_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (u, v, weight) between sets in two tiles whose wide prints and sizes may belong to similar sets.

    A tile is rows of (node, size, print) end to end.  The first words are compared for all pairs of like sizes, the others
    for those that pass.  The edges are a spanning forest of all candidates (weight 0), and for each set the nearest one of lesser node.
    """
    a, b = (x.reshape(-1, 2 + WIDTH) for x in (a, b))
    a, b = (x[np.argsort(x[:, 1], kind="stable")] for x in (a, b))
    nodes, size = np.concatenate([a[:, 0], b[:, 0]]), b[:, 1]
    left, right, label = np.ascontiguousarray(a[:, 2:].T).view(np.uint64), np.ascontiguousarray(b[:, 2:].T).view(np.uint64), np.arange(len(a) + len(b))
    best = np.full(len(nodes), 1 << 62)
    at = 0
    while at < len(a):
        n = a[at, 1]
        first, most = NEAR_BITS[bool(n <= FEW)]
        low = np.searchsorted(size, np.ceil(SIMILAR * n - 1e-9))
        step = max(1, (1 << 22) // max(1, len(b) - low))
        end = min(at + step, int(np.searchsorted(a[:, 1], FEW, "right")) if n <= FEW else len(a), int(np.searchsorted(a[:, 1], 1.05 * n, "right")))
        high = np.searchsorted(size, np.floor(a[end - 1, 1] / SIMILAR + 1e-9), "right")
        i, j = np.nonzero(np.bitwise_count(left[0, at:end, None] ^ right[0, None, low:high]) <= first)
        i, j = i + at, j + low
        apart = np.bitwise_count(left[:, i] ^ right[:, j]).sum(0, dtype=np.int64)
        small, large = np.minimum(a[i, 1], size[j]), np.maximum(a[i, 1], size[j])
        ok = (apart <= most) & (small >= SIMILAR * large - 1e-9) & (nodes[i] != nodes[j + len(a)])
        if ok.any():
            i, j, apart = i[ok], j[ok] + len(a), apart[ok]
            label = hook(label, i, j)
            later = np.where(nodes[i] > nodes[j], i, j)
            np.minimum.at(best, later, (apart << 32) | (i + j - later))
        at = end
    child = np.flatnonzero(label != np.arange(len(label)))
    child = child[nodes[child] != nodes[label[child]]]
    near = np.flatnonzero(best < 1 << 62)
    partner = best[near] & 0xFFFFFFFF
    return (
        np.concatenate([nodes[child], nodes[near]]), np.concatenate([nodes[label[child]], nodes[partner]]), np.concatenate([np.zeros(len(child), np.int64), 1 + 64 * WIDTH - (best[near] >> 32)])
    )


def size_cell(n: Column) -> Column:
    """Sizes up to 32 have a cell each, larger ones one for each step of a twentieth."""
    return F.when(n <= 32, n).otherwise(33 + F.floor(F.log(n / 33.0) / math.log(1.05))).cast("int")


def cells_in_reach(cell: int) -> range:
    """The cells, from this one on, of sizes that SIMILAR allows."""
    top = cell + 1 if cell <= 32 else 33 * 1.05 ** (cell - 32)  # above any size of the cell
    most = top / SIMILAR
    return range(cell, (int(most) if most < 33 else 33 + int(math.log(most / 33) / math.log(1.05))) + 2)


def similar_groups(named: DataFrame, key: str, words: int, tile: int = 1 << 15, tile_hashes: int = TILE_HASHES) -> DataFrame:
    """``key`` and first, the least key of its group, of the rows of named (key, text), linked where sets of word shingles have a Jaccard similarity of SIMILAR or more.

    Equal sets are one.  Their wide fingerprints are compared tile by tile; what they link is confirmed on whole sets.
    """

    @F.pandas_udf("sid binary, n long, print array<long>")
    def head_of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"sid": [set_digest(x) for x in sets], "n": [len(x) for x in sets], "print": [wide_print(x) for x in sets]})

    heads = materialize(named.select(F.col(key).alias("node"), head_of(F.col("text").cast("string")).alias("h")).select("node", "h.*"), "heads")
    prints = [F.get("print", F.lit(k)).alias(f"w{k}") for k in range(WIDTH)]
    sets = heads.groupBy("sid").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("print").alias("print"), F.count("*").alias("rows"))
    sets = materialize(sets.select("sid", "node", "n", "rows", *prints), "sets")
    pairs = tile_pairs(sets, size_cell(F.col("n")), ["node", "n", *[f"w{k}" for k in range(WIDTH)]], cells_in_reach, tile)
    edges = compared(pairs, wide_forest, 4, "u long, v long, weight long")
    linked = exact_components(named, key, words, sets, edges, tile_hashes)
    of = sets.select("sid", "node").join(linked, "node", "left").select("sid", F.coalesce("root", "node").alias("first"))
    return salted_join(heads.select(F.col("node").alias(key), "sid"), of, ["sid"], heavy(sets, ["sid"], heads.count(), "rows")).select(key, "first")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """The first row of each group linked by SIMILAR word shingles, in the order of id (null last) and text; all columns stay.

    Each row is judged by its own text, whatever others have its id; rows that agree in id and text count once.
    """
    key, mark = fresh(docs, "__row"), fresh(docs, "__first")
    named, apart = keyed(small_batches(docs), key)
    found = similar_groups(named, key, words).withColumnRenamed("first", mark)
    gone = materialize(found.where(F.col(key) != F.col(mark)).select(key).distinct(), "gone")
    kept = named.join(side(gone), key, "left_anti")
    return (kept if apart else kept.dropDuplicates([key])).select(*docs.columns)
