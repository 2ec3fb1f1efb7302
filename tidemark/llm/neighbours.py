"""Approximate nearest neighbours by balanced posting lists.

Index: centroids come from size-penalised k-means over a bounded sample of at most ``SAMPLE`` vectors; their number
follows the table up to ``MAX_LISTS``.  They are searched through an in-memory neighbour graph by beam search.  Every
vector goes to its nearest list, and boundary vectors also to further lists whose distance is within ``BOUNDARY`` of the
nearest, unless a list taken already is nearer to that centroid than the vector is.  A query takes the lists whose
distance ratio to its nearest centroid is under a bound that is calibrated on the sample for ``TARGET`` recall.

Lists and the queries that meet one are dealt into chunks of bounded size from counts by list, so a list that holds a
third of the table, or a centroid that every query wants, is spread over many tasks.  A chunk leaves the best few of each
query only; these are merged.  Scores are cosines in double precision over the original vectors, summed alike wherever a
vector lies, so equal vectors tie and the smaller vec_id comes first.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a null
vec_id or a dimension other than the most frequent; rows with one vec_id are one candidate (the best of them counts) and
one query (the least vector asks), and none is its own neighbour; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialize

SAMPLE, MAX_LISTS, LIST_SIZE, COPIES, BOUNDARY, TARGET, CHUNK = 20_000, 4096, 512, 4, 1.08, 0.985, 4096


@dataclass
class Router:
    """Centroids on the unit sphere, their neighbour graph, and the calibrated pruning ratio."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratio: float = 1.0
    beam: int = 32

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search over the graph: centroid numbers and distances, nearest first, for each row of x."""
        k, n = len(self.centroids), len(x)
        beam = min(beam, k)
        seen, dist = np.zeros((n, k), bool), np.full((n, beam), np.inf)
        best, open_ = np.full((n, beam), -1), np.zeros((n, beam), bool)

        def offer(rows: np.ndarray, ids: np.ndarray) -> None:
            fresh = ~seen[rows[:, None], ids]
            np.put_along_axis(seen_rows := seen[rows], ids, True, 1)
            seen[rows] = seen_rows
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nmd,nd->nm", self.centroids[ids], x[rows])))
            d[~fresh] = np.inf
            all_d = np.concatenate([dist[rows], d], 1)
            all_i = np.concatenate([best[rows], ids], 1)
            all_o = np.concatenate([open_[rows], fresh], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows], best[rows], open_[rows] = (np.take_along_axis(a, order, 1) for a in (all_d, all_i, all_o))

        everyone = np.arange(n)
        offer(everyone, np.tile(self.entries, (n, 1)))
        while (alive := np.flatnonzero((open_ & np.isfinite(dist)).any(1))).size:
            at = np.argmax(open_[alive] & np.isfinite(dist[alive]), axis=1)
            node = best[alive, at]
            open_[alive, at] = False
            offer(alive, self.graph[node])
        return best, dist

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that keep each vector: the nearest, and boundary lists by distance ratio and relative neighbourhood."""
        ids, dist = self.search(x, 4 * COPIES)
        out = []
        for i, d in zip(ids, dist, strict=True):
            kept = [i[0]]
            for c, near in zip(i[1:], d[1:], strict=True):
                if len(kept) == COPIES or c < 0 or near > BOUNDARY * d[0] + 1e-12:
                    break
                gap = np.sqrt(np.maximum(0, 2 - 2 * self.centroids[kept] @ self.centroids[c]))
                if (gap >= near).all():
                    kept.append(c)
            out.append(np.asarray(kept))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means on the sphere whose assignment pays for the size of a cluster, which evens the lists out."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    size = np.zeros(len(c))
    for _ in range(rounds):
        label = np.empty(len(x), np.int64)
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 512)):
            label[part] = np.argmax(x[part] @ c.T - 0.05 * size / max(1.0, len(x) / len(c)), axis=1)
            size = 0.9 * size + 0.1 * np.bincount(label[part], minlength=len(c)) * (len(x) / len(part))
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        c = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, unit(total), c)
    return c


def build_router(sample: np.ndarray, rows: int, top: int) -> Router:
    x = unit(sample)
    k = int(min(MAX_LISTS, max(1, rows // LIST_SIZE), len(np.unique(x, axis=0))))
    c = balanced_centroids(x, k)
    k = len(c)
    near = np.argsort(-(c @ c.T), axis=1, kind="stable")[:, : min(k, 25)]
    rng = np.random.default_rng(13)
    graph = np.concatenate([near, rng.integers(0, k, (k, 8))], 1)
    router = Router(c, graph, np.unique(np.concatenate([[int(np.argmax(c @ c.mean(0)))], rng.integers(0, k, min(k, 16))])))
    asks = rng.permutation(len(x))[:256]
    if k == 1 or len(x) <= top:
        router.beam = k
        return router
    sims = x[asks] @ x.T
    sims[np.arange(len(asks)), asks] = -np.inf
    nearest = np.argsort(-sims, axis=1, kind="stable")[:, :top]
    ids, dist = router.search(x[asks], k)
    where = dict(zip((targets := np.unique(nearest)).tolist(), router.lists_of(x[targets]), strict=True))
    need = []
    for q in range(len(asks)):
        at = {int(c): d for c, d in zip(ids[q], dist[q], strict=True) if c >= 0}
        floor = max(dist[q][0], 1e-9)
        need += [min((at.get(int(c), np.inf) for c in where[int(t)]), default=np.inf) / floor for t in nearest[q]]
    router.ratio = float(np.quantile(np.where(np.isfinite(need), need, np.max(dist[np.isfinite(dist)])), TARGET))
    wanted = (dist <= router.ratio * np.maximum(dist[:, :1], 1e-9)).sum(1)
    router.beam = int(min(k, 1.25 * wanted.max() + 8))
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part, of the most frequent dimension."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), finite.alias("f")).where("vec_id is not null and v is not null and f").where(F.exists("v", lambda e: e != 0)).drop("f")
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return good.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def search(vectors: DataFrame, every: int = 50, top: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of each query, whose vec_id is divisible by ``every``."""
    rows = materialize(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    n = rows.count()
    cut = (1 << 63) - 1 if n <= SAMPLE else int((1 << 63) * (SAMPLE / n))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 1) <= cut).orderBy("vec_id", "v").toPandas().drop_duplicates("vec_id") if n else None  # about SAMPLE rows
    if sample is None or not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = build_router(np.stack([np.asarray(v, float) for v in sample["v"]]), n, top)
    arrays = lambda s: np.stack([np.asarray(v, np.float64) for v in s])

    @F.pandas_udf("array<int>")
    def homes(v: pd.Series) -> pd.Series:
        parts = np.array_split(np.arange(len(v)), -(-len(v) // 1024)) if len(v) else []
        return pd.Series([x.astype(np.int32) for part in parts for x in router.lists_of(unit(arrays(v.iloc[part])))])

    index = materialize(rows.withColumn("list", F.explode(homes("v"))), "lists")
    counted = index.groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")).collect()  # <= MAX_LISTS rows
    sizes, candidates = {r["list"]: r["n"] for r in counted}, {r["list"]: r["ids"] for r in counted}

    @F.pandas_udf("array<int>")
    def asked(v: pd.Series) -> pd.Series:
        out = []
        for part in np.array_split(np.arange(len(v)), max(1, -(-len(v) // 1024))):
            if not len(part):
                continue
            ids, dist = router.search(unit(arrays(v.iloc[part])), router.beam)
            for i, d in zip(ids, dist, strict=True):
                taken, held = [], 0
                for c, near in zip(i.tolist(), d, strict=True):
                    if c < 0 or near > router.ratio * max(d[0], 1e-9) and held >= 4 * COPIES * (top + 1):
                        break
                    taken.append(c)
                    held += candidates.get(c, 0)
                out.append(np.asarray(taken, np.int32))
        return pd.Series(out)

    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    wanted = materialize(queries.withColumn("list", F.explode(asked("q"))), "asked")
    calls = {r["list"]: r["n"] for r in wanted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    deal = vectors.sparkSession.createDataFrame([(c, -(-m // CHUNK), -(-calls[c] // CHUNK)) for c, m in sizes.items() if c in calls], "list int, row_chunks int, query_chunks int")
    deal = F.broadcast(deal)  # <= MAX_LISTS rows

    def dealt(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row to its own chunk of the list, met with every chunk of the other side."""
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(f"{own}_at")
        return side.join(deal, "list").select(*side.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"))

    keys = ["list", "row_chunks_at", "query_chunks_at"]
    left = dealt(wanted, "query_id", "query_chunks", "row_chunks").groupBy(*keys)
    right = dealt(index, "vec_id", "row_chunks", "query_chunks").groupBy(*keys)

    def compare(asks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        cols = {"query_id": [], "vec_id": [], "score": []}
        if len(asks) and len(found):
            found = found.sort_values("vec_id", kind="stable")
            q, v, ids = arrays(asks["q"]), arrays(found["v"]), found["vec_id"].to_numpy(np.int64)
            length = np.sqrt((v * v).sum(1))
            shown = (v / length[:, None]).T
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            for one, name in zip(q, asks["query_id"].to_numpy(np.int64), strict=True):
                norm = np.sqrt((one * one).sum())
                rough = (one / norm) @ shown
                rough[ids == name] = -np.inf
                each = np.maximum.reduceat(rough, first)  # the best row of each id
                m = min(top, int(np.isfinite(each).sum()))
                if not m:
                    continue
                likely = np.flatnonzero(rough >= np.partition(each, -m)[-m] - 1e-9)
                exact = (v[likely] * one).sum(1) / (norm * length[likely])
                order, kept = np.lexsort((ids[likely], -exact)), []
                for j in order:  # an id that stands in several rows counts once
                    if ids[likely[j]] not in kept:
                        kept.append(int(ids[likely[j]]))
                        cols["query_id"].append(int(name))
                        cols["vec_id"].append(kept[-1])
                        cols["score"].append(float(exact[j]))
                        if len(kept) == top:
                            break
        return pd.DataFrame(cols).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    best = left.cogroup(right).applyInPandas(compare, "query_id long, vec_id long, score double")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
