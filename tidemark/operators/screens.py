"""What changes on a screen: rows from one instant to the next, rows that a state takes over, cells of grids under masks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import bucketed

RECTS = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def row_diffs(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, at_ms, text, op ('-' or '+'), n: what goes and comes at each instant, as multisets of texts.

    rows: by, text, start_ms, end_ms (null: to the end).  A text that ends and begins as often at one instant is no change.
    """
    came = rows.select(*by, "text", F.col("start_ms").alias("at_ms"), F.lit(1).alias("__d"))
    gone = rows.where("end_ms is not null").select(*by, "text", F.col("end_ms").alias("at_ms"), F.lit(-1).alias("__d"))
    net = came.unionByName(gone).groupBy(*by, "at_ms", "text").agg(F.sum("__d").alias("__d")).where("__d <> 0")
    return net.select(*by, "at_ms", "text", F.when(F.col("__d") > 0, "+").otherwise("-").alias("op"), F.abs("__d").alias("n"))


def carried_over(states: DataFrame, rows: DataFrame, by: list[str], width_ms: int = 300_000) -> DataFrame:
    """by, state, previous, gone, stayed: how many rows of the state before are gone when a state begins, and how many stay.

    states: by, state, start_ms, end_ms, one after the other.  rows: by, start_ms, end_ms (null: to the end).  A row counts if it overlaps the state
    before and began before this one; it is gone if it ended from that state's end on to this one's start, and stays if it ends later.  The
    first state of a group has none before it.
    """
    order = W.partitionBy(*by).orderBy("start_ms", "state")
    before = [F.lag(c).over(order).alias(a) for c, a in (("state", "previous"), ("start_ms", "__from"), ("end_ms", "__to"))]
    spans = states.select(*by, "state", F.col("start_ms").alias("__start"), *before)
    held = spans.where("previous is not null").select(*by, "state", "__start", F.col("__from").alias("start_ms"), F.col("__to").alias("end_ms"))
    last = states.groupBy(*by).agg((F.max("end_ms") + 1).alias("__last"))  # no state sees further
    there = rows.join(last, by).select(*by, "start_ms", F.coalesce("end_ms", F.greatest("start_ms", "__last")).alias("end_ms"))
    right = bucketed(there, width_ms).withColumnsRenamed({"start_ms": "__s", "end_ms": "__e"})
    met = bucketed(held, width_ms).join(right, [*by, "__bucket"])
    both = (F.col("__s") < F.col("end_ms")) & (F.col("__e") > F.col("start_ms")) & (F.col("__s") < F.col("__start"))
    once = F.col("__bucket") == F.floor(F.greatest("start_ms", "__s") / width_ms)
    gone = (F.col("__e") >= F.col("end_ms")) & (F.col("__e") <= F.col("__start"))
    n = met.where(both & once).groupBy(*by, "state").agg(F.count_if(gone).alias("gone"), F.count_if(F.col("__e") > F.col("__start")).alias("stayed"))
    return spans.select(*by, "state", "previous").join(n, [*by, "state"], "left").na.fill(0, ["gone", "stayed"])


def mask(width: int, height: int, include: list, exclude: list, grow: int = 0) -> np.ndarray:
    """The cells that count: those that the included rectangles touch (all, if there are none) less those that the excluded ones, grown by
    some cells on every side, touch.  Rectangles are x0, y0, x1, y1 as shares of the grid."""
    inside = np.full((height, width), not len(include))
    for value, rects, more in ((True, include, 0), (False, exclude, grow)):
        for r in rects:
            x0, y0, x1, y1 = (r[c] for c in ("x0", "y0", "x1", "y1"))
            left, top = max(0, floor(x0 * width) - more), max(0, floor(y0 * height) - more)
            inside[top : max(top, ceil(y1 * height) + more), left : max(left, ceil(x1 * width) + more)] = value
    return inside


def regions(changed: np.ndarray, reach: int = 1) -> list[dict]:
    """Bounding rectangles of the connected regions of changed cells, with their cells; cells within reach of each other on both axes connect.

    Each cell takes the least label near it and then the label of that label, so a long region needs few rounds.
    """
    ys, xs = np.nonzero(changed)
    if not len(ys):
        return []
    h, w = changed.shape
    none = h * w
    label = np.where(changed, np.arange(none).reshape(h, w), none)
    while True:
        wide = np.pad(label, reach, constant_values=none)
        least = np.lib.stride_tricks.sliding_window_view(wide, (2 * reach + 1,) * 2).min(axis=(2, 3))
        new = np.where(changed, least, none)
        new = np.where(changed, np.append(new.ravel(), none)[new], none)
        if (new == label).all():
            break
        label = new
    names, which = np.unique(label[ys, xs], return_inverse=True)
    low = [np.full(len(names), none) for _ in range(2)]
    high = [np.zeros(len(names), int) for _ in range(2)]
    for axis, at in enumerate((xs, ys)):
        np.minimum.at(low[axis], which, at)
        np.maximum.at(high[axis], which, at + 1)
    size = np.bincount(which)
    return [{"cells": int(size[k]), "x0": int(low[0][k]), "y0": int(low[1][k]), "x1": int(high[0][k]), "y1": int(high[1][k])} for k in range(len(names))]


def masked_changes(frames: DataFrame, masks: DataFrame, by: list[str], width: int, height: int, least: int = 12, grow: int = 0, reach: int = 1) -> DataFrame:
    """by, tick, changed, regions of frames after the first of their group: cells under the layout's mask that differ from the frame before.

    frames: by, tick (unique in a group), layout, grid (a byte a cell, row by row).  masks: layout, include, exclude (RECTS, null: none), one row a
    layout; a layout without one counts whole.  A cell changed if its brightness differs by ``least`` or more.  regions: array of cells, x0, y0, x1,
    y1 in cells, ends exclusive, in the order of their first cell.  A grid of another size than width x height, or after one, changed wholly.
    """
    order = W.partitionBy(*by).orderBy("tick")
    pairs = frames.select(*by, "tick", "layout", "grid", F.lag("grid").over(order).alias("__before"), F.row_number().over(order).alias("__n")).where("__n > 1")
    pairs = pairs.join(masks.select("layout", F.col("include").cast(RECTS), F.col("exclude").cast(RECTS)), "layout", "left").drop("__n")
    cells = width * height

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n, found = [], []
            for a, b, include, exclude in zip(batch["grid"], batch["__before"], batch["include"], batch["exclude"], strict=True):
                include, exclude = ([] if x is None else list(x) for x in (include, exclude))
                key = tuple(tuple(tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in x) for x in (include, exclude))
                if key not in known:
                    known = {} if len(known) > 256 else known  # a table of some layouts; more are made anew
                    known[key] = mask(width, height, include, exclude, grow)
                if a is None or b is None or len(a) != cells or len(b) != cells:
                    odd = known[key]
                else:
                    odd = (np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)) >= least).reshape(height, width) & known[key]
                n.append(int(odd.sum()))
                found.append(regions(odd, reach))
            yield batch[[*by, "tick"]].assign(changed=n, regions=found)

    kinds = dict(frames.dtypes)
    shape = "regions array<struct<cells:bigint,x0:bigint,y0:bigint,x1:bigint,y1:bigint>>"
    return pairs.mapInPandas(count, ", ".join(f"{c} {kinds[c]}" for c in (*by, "tick")) + f", changed bigint, {shape}")
