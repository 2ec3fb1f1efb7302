"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of character n-grams (orders 1 to 3), of word one- and two-grams and of two-grams of one word that come up a
number of times are hashed into buckets, scaled by the
smoothed log-count ratio of the two classes, divided by the root of their number, and a linear hinge-loss model is fitted
to them by dual coordinate descent.  A logistic curve fitted on rows kept out of training turns margins into scores, with
the classes weighted as they are in the whole of the labels.

Training takes a bounded sample: at most about ``per_class`` labelled rows of each class, chosen by a hash cut-off on the
id that follows from exact class counts; their features are built on the executors.  Scoring is a map over rows with a
model of one number per bucket; a text of any length is folded in windows, so memory is constant.

Defined results: null or empty text has no indicator and gets the score of the bare intercept; labels that contradict
each other for one id, null labels and null ids are not learnt from; without labels of both classes every score is the
share of label 1 (one half without any); repeated rows are scored alike; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import id_bucket, small_batches

BUCKETS = 1 << 16
ORDERS = 3
WINDOW = 1 << 20
KEEP = 0.7
REPEATS = (1, 4, 16, 64)
_POWERS: tuple[np.ndarray, np.ndarray] | None = None
BASE = 0x9E3779B97F4A7C15 | 1


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power k and to the power -k, modulo 2^64."""
    global _POWERS
    if _POWERS is None:
        n = WINDOW + 16
        inverse = pow(BASE, -1, 1 << 64)
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % BUCKETS


def indicators(text: str | None) -> np.ndarray:
    """The sorted bucket numbers that a text hits."""
    hit, doubled = np.zeros(BUCKETS, bool), 0
    up, down = powers()
    for at in range(0, len(text or ""), WINDOW):
        c = np.frombuffer(text[at : at + WINDOW + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c[(c >= 48) & (c <= 57)] = 48
        h = np.zeros(len(c), np.uint64)
        for order in range(1, ORDERS + 1):
            if len(c) < order:
                break
            h = h[: len(c) - order + 1] * np.uint64(0x100000001B3) + c[order - 1 :]
            hit[mixed(h, order)] = True
        blank = (c == 32) | ((c >= 9) & (c <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        if len(begin):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up[: len(c)], dtype=np.uint64)])
            word = (total[end] - total[begin]) * down[begin]
            hit[mixed(word, 11)] = True
            hit[mixed(word[:-1] * np.uint64(BASE) + word[1:], 12)] = True
            doubled += int((word[1:] == word[:-1]).sum())
    for level in REPEATS:
        if doubled >= level:
            hit[mixed(np.array([level], np.uint64), 13)] = True
    return np.flatnonzero(hit)


@dataclass
class QualityModel:
    weights: np.ndarray | None
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        if self.weights is None:
            return self.intercept
        return float(self.weights[ids].sum() / np.sqrt(max(1, len(ids))) + self.intercept)

    def score(self, ids: np.ndarray) -> float:
        if self.weights is None:
            return self.intercept
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    count = [np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)]
    for ids, label in zip(rows, y, strict=True):
        count[int(label > 0)][ids] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, rng) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model with a bias feature of 1: one box-constrained dual variable a row."""
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            if (d := new - alpha[i]) != 0:
                w[rows[i]] += d * y[i] * values[i]
                b += d * y[i]
                alpha[i] = new
                worst = max(worst, abs(d))
        if worst < 1e-4 * cost:
            break
    return w, b


def logistic_curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by damped Newton steps, with softened targets."""
    target = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    x = np.stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        grad = x @ (weight * (p - target))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)) @ x.T + 1e-9 * np.eye(2), grad)
        theta = theta - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, shares: dict[int, float], cost: float = 1.0, epochs: int = 40, seed: int = 5) -> QualityModel:
    """rows: indicators; y: +1 or -1; shares: the part of each class in all labels, by which the curve is weighted."""
    if len(set(y.tolist())) < 2:
        return QualityModel(None, shares.get(1, 0.5))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    check, train = (order[::4], np.array([j for k, j in enumerate(order) if k % 4])) if len(rows) >= 40 else (order, order)
    if len(set(y[train].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        check = train = order
    ratio = log_count_ratios([rows[i] for i in train], y[train])
    used = [rows[i] for i in train]
    w, b = dual_coordinate_descent(used, [ratio[r] / np.sqrt(max(1, len(r))) for r in used], y[train].astype(float), cost, epochs, rng)
    model = QualityModel(w * ratio, b)
    held = {c: max(1, int(np.sum(y[check] == c))) for c in (1, -1)}
    weight = np.array([shares[int(c > 0)] * len(check) / held[int(c)] for c in y[check]])
    model.slope, model.shift = logistic_curve(np.array([model.margin(rows[i]) for i in check]), y[check], weight)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, modulus: int = 4, held: int = 2) -> QualityModel:
    agreed = (
        labels.where(F.col("quality").isNotNull() & (id_bucket("doc_id", modulus) != held))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min("quality").alias("q"), F.max("quality").alias("top"))
        .where("q = top and q in (0, 1)")
        .select("id", F.col("q").cast("int").alias("q"))
    )
    counts = {r["q"]: r["n"] for r in agreed.groupBy("q").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if not total:
        return QualityModel(None, 0.5)
    cut = {q: (1 << 63) - 1 if n <= per_class else int((1 << 63) * (per_class / n)) for q, n in counts.items()}
    bound = F.when(F.col("q") == 1, cut.get(1, 0)).otherwise(cut.get(0, 0))
    chosen = agreed.where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= bound)  # about 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("x")).join(F.broadcast(chosen), "id")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "q": batch["q"], "f": [indicators(x).astype("<u2").tobytes() for x in batch["x"]]})

    sample = texts.mapInPandas(build, "id long, q int, f binary").groupBy("id", "q").agg(F.min("f").alias("f")).toPandas().sort_values("id", kind="stable")  # rows that share an id count once
    rows = [np.frombuffer(f, "<u2").astype(np.int64) for f in sample["f"]]
    return fit(rows, np.where(sample["q"].to_numpy() == 1, 1, -1), {q: counts.get(q, 0) / total for q in (0, 1)})


def score(docs: DataFrame, model: QualityModel, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(indicators(x)) for x in texts], dtype="float64")

    rated = small_batches(docs).select("doc_id", F.coalesce(id_bucket("doc_id", modulus) == held, F.lit(True)).alias("held_out"), rate(F.col("text").cast("string")).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
