"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed letter n-grams (orders 2 to 4 over case-folded letters, runs of
anything else being one blank).  Embeddings and softmax are trained together by stochastic gradient descent in numpy on
a bounded sample of labelled rows: ``per_language`` rows a language, ``SAMPLE_ROWS`` in all, and of each row's buckets the
``TOP`` most frequent, so what reaches the driver has a bound in bytes.

Scores and rejection are calibrated on rows held back from training and on what no language is: the same rows with the
letters of each text shuffled.  One temperature fits both, held-back rows by their language and shuffled ones by even odds.
A text is rejected by its surety, the odds that it is in one of its two likeliest languages, as a text in two languages is a
text too.  The threshold parts real rows from shuffled ones best, but never lies where more than ``REFUSED`` of the rows kept
back, or of mixtures of two of them in different languages, would go (less three standard errors, where these are few).

Memory: the model is ``buckets x dim`` floats.  A text is folded in windows of ``WINDOW`` characters that overlap by
``max order - 1``, so a text of any length needs constant space.  Scoring is a map over rows: no shuffle.

Defined results: null text or no letter gives ``und`` with score 0; no labelled row at all gives ``und`` everywhere;
rows with a null language or null id are never learnt from; repeated rows are scored one by one, each alike; columns
other than the named ones are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import fresh, id_bucket, materialize, side, small_batches

ORDERS = (2, 3, 4)
WINDOW = 1 << 20
UNKNOWN = "und"
SAMPLE_ROWS, TOP = 8000, 2048
REFUSED = 0.001


@dataclass
class LanguageModel:
    """What training leaves: per bucket one logit per language (embedding and softmax multiplied out)."""

    languages: list[str] = field(default_factory=list)
    logits: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0


_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter, else a blank."""
    global _FOLD
    if _FOLD is None:
        out = np.full(0x110000, 32, np.uint32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                out[point] = ord(low) if len(low) == 1 else point
        _FOLD = out
    return _FOLD


def gram_ids(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, window by window; grams that start at a blank run are kept once."""
    table, overlap = fold_table(), max(ORDERS) - 1
    for at in range(0, max(len(text), 1), WINDOW):
        part = text[at : at + WINDOW + overlap]
        folded = table[np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(folded), bool)
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        folded = folded[keep]
        if len(folded) < 3:
            continue
        h = folded.copy()
        for order in range(2, max(ORDERS) + 1):
            if len(folded) < order:
                break
            h = h[:-1] * np.uint32(0x9E3779B1) + folded[order - 1 :]
            if order in ORDERS:
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(buckets)


def gram_counts(text: str, buckets: int) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    for ids in gram_ids(text, buckets):
        total += np.bincount(ids, minlength=buckets)
    return total


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Bucket numbers and counts of the TOP most frequent buckets; counts over 16 bits are scaled down together."""
    i = np.flatnonzero(counts)
    if len(i) > TOP:
        i = np.sort(np.argsort(-counts, kind="stable")[:TOP])
    c = counts[i]
    c = np.maximum(1, c * 65535 // c.max()) if len(c) and c.max() > 65535 else c
    return i.astype("<u2").tobytes(), c.astype("<u2").tobytes()


def shuffled(text: str) -> str:
    """The text with its characters in another order, the same for the same text."""
    points = np.frombuffer(text[:WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(len(points)).permutation(points).tobytes().decode("utf-32-le", "surrogatepass")


def labelled_features(docs: DataFrame, buckets: int, per_language: int, modulus: int, held: int) -> pd.DataFrame:
    """y, back (kept out of training), odd (shuffled) and sparse gram counts of a bounded sample, counted on the executors.

    The rows of a language are those whose id hash lies under a cut-off set by the number of rows of that language; every
    fifth of them by another hash is kept back, and comes shuffled too.
    """
    known = F.col("lang").isNotNull() & (id_bucket("doc_id", modulus) != held)
    pool = materialize(docs.where(known).select(F.col("lang").cast("string").alias("y")).groupBy("y").agg(F.count("*").alias("n")), "languages")
    each = max(1, min(per_language, SAMPLE_ROWS // max(1, pool.count())))
    cut = F.when(F.col("n") <= each, F.lit((1 << 63) - 1)).otherwise((F.lit(float(1 << 63)) * each / F.col("n")).cast("long"))
    shares = side(pool.select("y", cut.alias("cut")))
    back = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(5)) == 0
    rows = small_batches(docs).where(known).select(F.col("lang").cast("string").alias("y"), F.col("text").cast("string").alias("x"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"), back.alias("back"))
    chosen = rows.join(shares, "y").where("h <= cut").select("y", "x", "back")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, x, back in zip(batch["y"], batch["x"], batch["back"], strict=True):
                for odd in (False, True) if back else (False,):
                    c = gram_counts(shuffled(x) if odd else x, buckets) if x else np.zeros(0, np.int64)
                    if c.any():
                        out.append((y, bool(back), odd, *packed(c)))
            yield pd.DataFrame(out, columns=["y", "back", "odd", "i", "c"])

    return chosen.mapInPandas(count, "y string, back boolean, odd boolean, i binary, c binary").toPandas()


def surety(odds: np.ndarray) -> np.ndarray:
    """The odds of the two likeliest languages together."""
    return np.sort(odds, axis=-1)[..., -2:].sum(-1)


def fit(sample: pd.DataFrame, buckets: int, dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on the sample by stochastic gradient descent; calibrate on the rows kept back and their shuffled forms."""
    if not len(sample):
        return LanguageModel()
    sample = sample.sort_values(["y", "odd", "i", "c"], kind="stable").reset_index(drop=True)  # the order of arrival must not matter
    rng = np.random.default_rng(seed)
    languages = sorted(sample["y"].unique())
    y = sample["y"].map({k: n for n, k in enumerate(languages)}).to_numpy()
    rows = [(np.frombuffer(i, "<u2"), np.frombuffer(c, "<u2")) for i, c in zip(sample["i"], sample["c"], strict=True)]
    back, odd = sample["back"].to_numpy(bool), sample["odd"].to_numpy(bool)
    del sample
    train, check, none = np.flatnonzero(~back), np.flatnonzero(back & ~odd), np.flatnonzero(odd)
    if len(train) < 10 or len(set(y[train])) < len(languages):  # too few rows to keep any back
        train = np.flatnonzero(~odd)
        check = check if len(check) else train

    def dense(part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(part), buckets), np.float32)
        for n, j in enumerate(part):
            x[n, rows[j][0]] = rows[j][1] / rows[j][1].sum(dtype=np.int64)
        return x

    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    g_emb, g_out = np.full(buckets, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            x = dense(part)
            h = x @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            touched = np.flatnonzero(x.any(0))
            d_emb = x[:, touched].T @ (p @ out.T)
            d_out = h.T @ p
            g_emb[touched] += (d_emb**2).mean(1)
            g_out += d_out**2
            emb[touched] -= rate * d_emb / np.sqrt(g_emb[touched])[:, None]
            out -= rate * d_out / np.sqrt(g_out)
            bias -= rate * p.sum(0)
    model = LanguageModel(languages, emb @ out, bias)

    def margins(part: np.ndarray) -> np.ndarray:
        if not len(part):
            return np.zeros((0, len(languages)))
        return np.concatenate([dense(some) @ model.logits for some in np.array_split(part, max(1, len(part) // 64))]).astype(float)

    real, unreal = margins(check), margins(none)
    pairs = [(j, k) for j, k in zip(range(len(check)), rng.permutation(len(check)), strict=True) if y[check[j]] != y[check[k]]]
    mixed = np.array([(real[j] + real[k]) / 2 for j, k in pairs]).reshape(-1, len(languages))

    def odds(z: np.ndarray, t: float) -> np.ndarray:
        z = (z + bias) / t
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def loss(t: float) -> float:
        own = -np.log(np.maximum(odds(real, t)[np.arange(len(real)), y[check]], 1e-12)).mean()
        return float(own - (np.log(np.maximum(odds(unreal, t), 1e-12)).mean() if len(unreal) else 0.0))

    model.temperature = float(min(np.geomspace(0.25, 16, 61), key=loss))
    sure = {name: surety(odds(z, model.temperature)) for name, z in (("real", real), ("unreal", unreal), ("mixed", mixed)) if len(z)}
    if "unreal" in sure:
        tries = np.unique(np.concatenate([sure["real"], sure["unreal"]]))
        wrong = [(sure["real"] < t).mean() + (sure["unreal"] >= t).mean() for t in tries]
        bounds = [np.quantile(x, REFUSED) - 3 * x.std() / len(x) ** 0.5 for x in (sure[name] for name in ("real", "mixed") if name in sure)]
        model.threshold = float(min(tries[int(np.argmin(wrong))], *bounds))
    return model


def train(docs: DataFrame, buckets: int = 1 << 14, per_language: int = 600, modulus: int = 3, held: int = 1) -> LanguageModel:
    return fit(labelled_features(docs, buckets, per_language, modulus, held), buckets)


def predictor(model: LanguageModel, text: str = "text"):
    """A column expression: struct(lang_pred, score, sure) of a text column."""
    buckets = 0 if model.logits is None else len(model.logits)
    logits = None if model.logits is None else model.logits.astype(np.float64)

    @F.pandas_udf("lang_pred string, score double, sure double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            names, scores, sures = [], [], []
            for x in series:
                name, score, sure = UNKNOWN, 0.0, 0.0
                if x and buckets:
                    z, n = np.zeros(logits.shape[1]), 0
                    for ids in gram_ids(x, buckets):
                        c = np.bincount(ids, minlength=buckets)
                        z += c @ logits
                        n += len(ids)
                    # a lone blank-padded run without letters leaves no gram, so n > 0 implies a letter
                    if n:
                        z = (z / n + model.bias) / model.temperature
                        p = np.exp(z - z.max())
                        p /= p.sum()
                        k = int(p.argmax())
                        name, score, sure = model.languages[k], float(p[k]), float(surety(p))
                names.append(name)
                scores.append(score)
                sures.append(sure)
            yield pd.DataFrame({"lang_pred": names, "score": scores, "sure": sures})

    return predict(F.col(text))


def identify(docs: DataFrame, model: LanguageModel | None = None, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (a language, with a surety at or over the threshold) of every row."""
    model = model or train(docs, modulus=modulus, held=held)
    rated = small_batches(docs).select("doc_id", F.coalesce(id_bucket("doc_id", modulus) == held, F.lit(True)).alias("held_out"), predictor(model).alias("p"))
    return rated.select("doc_id", "held_out", "p.lang_pred", "p.score", ((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.sure") >= model.threshold)).alias("accepted"))


def reject(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows whose language is recognised with a surety at or over the calibrated threshold; all columns stay."""
    model = model or train(docs)
    mark = fresh(docs, "__lang_prediction")
    kept = small_batches(docs).withColumn(mark, predictor(model)).where((F.col(f"{mark}.lang_pred") != UNKNOWN) & (F.col(f"{mark}.sure") >= model.threshold))
    return kept.select(*docs.columns)
