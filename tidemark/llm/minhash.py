"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has SIZE coordinates.  In round i < SIZE every element of a set is hashed to one coordinate, in round SIZE + j all are
hashed to coordinate j; a coordinate keeps the least hash of the first round that reaches it, so all are filled after
2 * SIZE rounds at most, a set of n elements needs some SIZE * ln(SIZE) / n rounds, and the share of equal coordinates of
two sets is concentrated about their Jaccard similarity as with SIZE independent hash functions.  All texts of a batch go through a round at
once, and leave it when they are full.

Sketches are cut into bands of ROWS coordinates.  Sets that agree in a band are candidates; two sets at the very threshold of
0.8 share none of the 40 bands with odds of 7 in 10**10.  In each band's bucket every set is tied to the least one, never to all
others.  Links are then confirmed on whole sets (``jaccard``).  Exact copies are one set from the start.

Shuffled: a row with the bands for each distinct set, a narrow row for each band, the sets of candidates once, those of what stays
open once for each tile that they meet.

Defined results: null or empty texts, and those of blanks, have no shingle, are linked with nothing and stay; a text of fewer words
than a shingle is one shingle; rows are told apart by id and text, so rows that share an id are each linked by their own text; repeated
rows each get their row; a null id is in no component's least id, and a row without one is kept where its component has no id at all;
an empty table gives no rows; extra columns are ignored; very long texts are met whole, a batch of texts at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jaccard import exact_components, set_digest, shingle_set
from tidemark.llm.runtime import fresh, heavy, keyed, materialize, salted_join, side, small_batches

SIZE, ROWS = 160, 4
UNFILLED = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the argument moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """A row of ``size`` coordinates for each set (of one element or more) of hashes."""
    out = np.full((len(sets), size), UNFILLED)
    flat = out.reshape(-1)
    owner, hashes = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.zeros(0, np.uint64), *sets])
    for i in range(2 * size):
        if not len(hashes):
            break
        x = mix(hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
        at = owner * size + ((high * np.uint64(size)) >> np.uint64(32)).astype(np.int64) if i < size else owner * size + (i - size)
        free = flat[at] == UNFILLED  # later rounds leave what an earlier one has filled
        np.minimum.at(flat, at[free], (low[free] << np.uint64(32)) | high[free])
        left = (out == UNFILLED).any(1)[owner]
        owner, hashes = owner[left], hashes[left]
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of each sketch."""
    cut = sketch.reshape(len(sketch), -1, rows)
    out = np.broadcast_to(np.arange(cut.shape[1], dtype=np.uint64), cut.shape[:2])
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return out.view(np.int64)


def candidates(sets: DataFrame) -> DataFrame:
    """u, v, weight: each set (node, bands) with the least of those that it shares a band with, and the number of these bands."""
    rows = sets.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("__most"), F.count("*").alias("n")).where(F.col("v") != F.col("__most"))
    shared = materialize(shared.select("band", "v", "n"), "shared")
    parts = heavy(shared, ["band"], shared.agg(F.sum("n")).first()[0] or 0)
    met = salted_join(rows, side(shared.select("band", "v")), ["band"], parts)
    return met.where("node <> v").groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("weight"))


def near_duplicates(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""

    @F.pandas_udf("sid binary, n long, bands array<long>")
    def head_of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        some = [k for k, s in enumerate(sets) if len(s)]
        of = [np.zeros(0, np.int64)] * len(sets)
        for k, row in zip(some, bands(sketches([sets[k] for k in some])) if some else [], strict=True):
            of[k] = row
        return pd.DataFrame({"sid": [set_digest(s) for s in sets], "n": [len(s) for s in sets], "bands": of})

    key = fresh(docs, "__row")
    named, _ = keyed(small_batches(docs, tidy=True), key)
    named = named.select(key, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heads = materialize(named.select(F.col(key).alias("node"), "doc_id", head_of("text").alias("h")).select("node", "doc_id", "h.*"), "heads")
    some = heads.where("n > 0")
    sets = some.groupBy("sid").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    sets = materialize(sets, "sets")
    linked = exact_components(named, key, words, sets, candidates(sets))
    rooted = sets.select("sid", "node", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("sid", "component_id")
    met = salted_join(some.select("doc_id", "n", "sid"), of, ["sid"], heavy(sets, ["sid"], heads.count(), "rows"))
    rest = heads.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = met.select("doc_id", "n", "component_id").unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
