"""Exact links of shingle sets, PERCENT of their union in common or more, from the candidates that a search has left.

Candidates come as edges (u, v, weight) over distinct sets; those of one cluster (connected by candidates) may all be linked, those
of different clusters are not.  First each set meets one other, its edge of most weight: the sets that share a partner pass it in a stream, so
a large group of near copies costs one comparison a set.  What these links join is settled.  Only where a cluster falls into several
parts is more to be done: the sets outside its largest part meet all others of the cluster, tile by tile, through an index of the
hashes in a pair of tiles.  No link between two parts is missed, and none inside a part is needed.

A task holds a pair of tiles of TILE_HASHES hashes each (or one set, if that is larger), or one set and a batch of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialize, side, small_batches

SEED = 42
#: The least share of their union that two linked sets have in common, in hundredths.
PERCENT = 80
TILE_HASHES = 200_000
#: Sets that meet one partner in a task.
MEMBERS = 2_000
#: Rows of a batch of sets.
SET_ROWS = 256


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begins = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1).tolist()
    stops = (ends - 1).tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, stops[words - 1 :], strict=False)), np.uint64, len(parts) - words + 1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; sets are compared by these 64 bits."""
    return np.unique(shingle_hashes(text, words))


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that tell a set from all others."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def is_link(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (100 + PERCENT) * shared >= PERCENT * (n + m)


def hook(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the trees of u[k] and v[k] in a forest of labels; every label ends at its root."""
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, root of every node of the edges but the roots (the least nodes), by alternating large-star and small-star contraction.

    A star step carries one row per edge and groups by node with a minimum only; the join back has one row per node on
    its other side, so a hub can be split by the engine.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.where("u <> v").distinct()
    before = None
    for _ in range(limit):
        now = materialize(star(star(now, True), False), "stars")
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("star contraction did not settle")


def label_open(sizes: np.ndarray, hashes: np.ndarray, parts: np.ndarray, opened: np.ndarray, step: int = 32) -> np.ndarray:
    """A label for each set, equal for linked ones; hashes holds one set after the other.

    Sets of one part are known to be linked.  Each opened set is compared with all others through the hashes that they share; when all
    are linked no more need be compared.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, name = np.unique(hashes, return_inverse=True)
    order = np.argsort(name, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(name))
    begins, stops = np.append(0, ends[:-1]), np.cumsum(sizes)
    _, first, at = np.unique(parts, return_index=True, return_inverse=True)
    label = hook(np.arange(len(sizes)), np.arange(len(sizes)), first[at])
    us, vs, todo = [], [], np.flatnonzero(opened)
    for i, k in enumerate(todo):
        mine = name[stops[k] - sizes[k] : stops[k]]
        shared = np.bincount(np.concatenate([holders[begins[x] : ends[x]] for x in mine]), minlength=len(sizes)) if len(mine) else np.zeros(len(sizes), int)
        near = np.flatnonzero(is_link(shared, sizes, sizes[k]))
        us.append(np.full(len(near), k))
        vs.append(near)
        if i % step == step - 1 or i == len(todo) - 1:
            label, us, vs = hook(label, np.concatenate(us), np.concatenate(vs)), [], []
            if not label.any():
                break
    return label


def tree_links(full: DataFrame, tree: DataFrame) -> DataFrame:
    """The edges (u, v) of tree, one for each u, that are links; full: node, hashes."""
    spread = tree.groupBy("v").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    members = tree.join(spread, "v").join(full, F.col("u") == F.col("node")).select("v", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int").alias("copy"), "u", F.lit(False).alias("hub"), "hashes")
    hubs = spread.join(full, F.col("v") == F.col("node")).select("v", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("v").alias("u"), F.lit(True).alias("hub"), "hashes")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub = np.zeros(0, np.int64)
        for batch in batches:
            us, vs = [], []
            for v, u, leads, hashes in zip(batch["v"], batch["u"], batch["hub"], batch["hashes"], strict=True):
                mine = np.asarray(hashes, np.int64)
                if leads:
                    hub = np.sort(mine)  # comes before its members
                    continue
                at = np.searchsorted(hub, mine)
                shared = int((hub[np.minimum(at, len(hub) - 1)] == mine).sum()) if len(hub) else 0
                if is_link(shared, len(mine), len(hub)):
                    us.append(u)
                    vs.append(v)
            yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    rows = hubs.unionByName(members).repartition("v", "copy").sortWithinPartitions("v", "copy", F.desc("hub")).select("v", "u", "hub", "hashes")
    return materialize(small_batches(rows, SET_ROWS).mapInPandas(meet, "u long, v long"), "tree-links")


def open_links(full: DataFrame, clusters: DataFrame, found: DataFrame, tile_hashes: int) -> DataFrame:
    """Links (u, v) between the parts that ``found`` leaves of clusters (node, root, n)."""
    parts = components(found)
    state = clusters.join(parts.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    state = materialize(state, "state")
    size = state.groupBy("root", "part").agg(F.sum("n").alias("n"))
    split = size.groupBy("root").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("core"), F.max("n").alias("inner"), F.sum("n").alias("all")).where("parts > 1")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / tile_hashes)).cast("int")
    split = split.select("root", "core", tiles(F.col("all") - F.col("inner")).alias("outer_tiles"), tiles(F.col("inner")).alias("inner_tiles"))
    placed = state.join(split, "root").withColumn("open", F.col("part") != F.col("core"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("outer_tiles")).otherwise(F.col("inner_tiles"))).cast("int")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    outer, inner = F.sequence(F.lit(0), F.col("outer_tiles") - 1), F.sequence(F.lit(0), F.col("inner_tiles") - 1)
    t = F.col("t")
    meets = F.when(
        F.col("open"),
        F.concat(F.transform(F.filter(outer, lambda x: x != t), lambda x: pair(F.least(t, x), F.greatest(t, x))), F.transform(inner, lambda x: pair(t, F.col("outer_tiles") + x))),
    ).otherwise(F.transform(outer, lambda x: pair(x, F.col("outer_tiles") + t)))
    placed = materialize(placed.withColumn("t", own).select("node", "root", "part", "open", F.explode(meets).alias("m")).select("node", "root", "part", "open", "m.*"), "placed")

    def join_tiles(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows["node"].to_numpy(np.int64)
        label = label_open(np.array([len(x) for x in rows["hashes"]]), np.concatenate(rows["hashes"].to_list()), rows["part"].to_numpy(), rows["open"].to_numpy())
        child = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": nodes[child], "v": nodes[label[child]]})

    met = placed.join(full, "node").select("root", "a", "b", "node", "part", "open", "hashes").groupBy("root", "a", "b")
    return materialize(met.applyInPandas(join_tiles, "u long, v long"), "open-links")


def exact_components(docs: DataFrame, key: str, words: int, sets: DataFrame, edges: DataFrame, tile_hashes: int = TILE_HASHES) -> DataFrame:
    """node, root (the least node) of every set that is linked to another, but the roots.

    docs: key and text.  sets: node (the key of a row that has the set) and n, its size.  edges: candidates (u, v, weight).
    """

    @F.pandas_udf("array<long>")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts])

    edges = materialize(edges, "candidates")
    clusters = materialize(components(edges), "clusters")
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root")).distinct()
    clusters = materialize(clusters.join(sets.select("node", "n"), "node"), "clusters")
    wanted = side(materialize(clusters.select(F.col("node").alias("__node")), "wanted"))
    texts = small_batches(docs).join(wanted, F.col(key) == F.col("__node")).select(F.col("__node").alias("node"), F.col("text").cast("string").alias("text"))
    full = materialize(texts.select("node", set_of("text").alias("hashes")).dropDuplicates(["node"]), "full")
    tree = edges.groupBy("u").agg(F.max_by("v", F.struct("weight", "v")).alias("v"))
    found = tree_links(full, materialize(tree, "tree"))
    more = open_links(full, clusters, found, tile_hashes)
    return materialize(components(found.unionByName(more)), "linked")
