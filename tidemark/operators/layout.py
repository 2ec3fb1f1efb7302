"""Boxes on a page or frame: reading order and rows followed from frame to frame."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import in_order, real
from tidemark.functions.text import similar

#: Texts, and pairs of them, whose comparison a task remembers.
LATELY = 50_000

Box = tuple[str, float, float, float, float]  # text, left, top, right, bottom


def widest_gap(boxes: list[Box], low: int, high: int) -> tuple[float, float]:
    """Width and place of the widest stretch between boxes along one axis, on which they are in order."""
    best, at, reach = 0.0, 0.0, None
    for b in boxes:
        start, end = b[low], b[high]
        if reach is None:
            reach = end
            continue
        if start - reach > best:
            best, at = start - reach, (start + reach) / 2
        if end > reach:
            reach = end
    return best, at


def blocks(boxes: list[Box], height: float) -> list[list[Box]]:
    """Blocks in reading order, cut again and again at the widest stretch: columns need one and a half line heights of
    white, paragraphs one; short texts that line up across columns stay rows.  Boxes are sorted once along each axis."""
    todo, out = [(sorted(boxes, key=itemgetter(1, 3)), sorted(boxes, key=itemgetter(2, 4)))], []
    while todo:
        part, down = todo.pop()
        if len(part) < 2:
            out.append(part)
            continue
        gap_x, at_x = widest_gap(part, 1, 3)
        gap_y, at_y = widest_gap(down, 2, 4)
        x, y = gap_x / (1.5 * height), gap_y / height
        if max(x, y) < 1:
            out.append(part)
            continue
        across = x > y and not table_like(part, at_x, height)
        if x > y and not across and y < 1:
            out.append(part)
            continue
        low, cut = (1, at_x) if across else (2, at_y)
        todo.append(([b for b in part if b[low] >= cut], [b for b in down if b[low] >= cut]))
        todo.append(([b for b in part if b[low] < cut], [b for b in down if b[low] < cut]))
    return out


def table_like(boxes: list[Box], cut: float, height: float) -> bool:
    lengths = sorted(len(b[0]) for b in boxes)
    if lengths[len(lengths) // 2] >= 25:
        return False
    left, right = [b[2] + b[4] for b in boxes if b[1] < cut], sorted(b[2] + b[4] for b in boxes if b[1] >= cut)
    if not left or not right:
        return False
    lined = 0
    for a in left:
        k = bisect_left(right, a)
        lined += any(abs(a - m) <= height for m in right[max(k - 1, 0) : k + 1])  # the nearest on either side
    return lined >= 0.6 * len(left)


def rows(boxes: list[Box]) -> list[str]:
    """Texts of a block's rows, top to bottom, cells left to right."""
    if len(boxes) == 1:
        return [boxes[0][0]]
    out: list[list[Box]] = []
    for b in sorted(boxes, key=itemgetter(2, 1, 4, 3, 0)):
        middle, high = b[2] + b[4], b[4] - b[2]
        near = [r for r in out if abs(middle - (r[0][2] + r[0][4])) <= min(high, r[0][4] - r[0][2]) and not any(over(b, m) for m in r)]
        if near:
            min(near, key=lambda r: abs(middle - (r[0][2] + r[0][4]))).append(b)
        else:
            out.append([b])
    return [" ".join(b[0] for b in sorted(r, key=itemgetter(1))) for r in sorted(out, key=lambda r: (r[0][2] + r[0][4], r[0][1]))]


def over(a: Box, b: Box) -> bool:
    return min(a[3], b[3]) - max(a[1], b[1]) > 0.25 * min(a[3] - a[1], b[3] - b[1])


def reading_order(lines: DataFrame, by: str) -> DataFrame:
    """by, place, text of recognised lines (by, text, confidence, x, y, w, h), in reading order, blank between blocks.

    Very short lines that were read with little confidence are noise.  Pages stream; a task holds one at a time.
    """

    def read(lines: Iterator[tuple]) -> Iterator[tuple]:
        for page, group in groupby(lines, itemgetter(0)):
            kept = [(" ".join(t.split()), x, y, x + w, y + h) for _, t, sure, x, y, w, h in group if (bare := t.strip()) and not (len(bare) <= 2 and sure < 0.35)]
            if not kept:
                continue
            heights = sorted(b[4] - b[2] for b in kept)
            place = 0
            for block in blocks(kept, max(heights[len(heights) // 2], 1e-9)):
                for text in ([""] if place else []) + rows(block):
                    yield page, place, text
                    place += 1

    page = lines.select(by, F.coalesce("text", F.lit("")).alias("text"), *map(real, ("confidence", "x", "y", "w", "h")))
    return in_order(page, [by], [], read, {"place": "bigint", "text": "string"})


def row_tracks(reads: DataFrame, by: str) -> DataFrame:
    """by, frame, row, track: rows (by, frame, row, text, y, h) that go on from the frame before.

    In row order each takes the free row at its place that is alike, an equal text first, then the nearest; then a text
    that one row alone has on either side is the same row wherever it moved.  Frames stream in order; two are held at once.
    """

    def follow(rows: Iterator[tuple]) -> Iterator[tuple]:
        plain = lru_cache(LATELY)(lambda t: re.sub(r"[\W_]", "", t.lower()))
        alike = lru_cache(LATELY)(lambda a, b: similar(a, b))
        for key, recording in groupby(rows, itemgetter(0)):
            before, tracks = [], 0
            for frame, part in groupby(recording, itemgetter(1)):
                now = [[text, y, h, None, row, plain(text)] for _, _, row, text, y, h in part]
                free = dict(enumerate(before))
                for r in now:
                    text, y, h, _, _, bare = r
                    fits = [(p[5] == bare, -abs(p[1] - y), -i) for i, p in free.items() if abs(p[1] - y) <= min(p[2], h) and (p[5] == bare or alike(p[0], text))]
                    if fits:
                        r[3] = free.pop(-max(fits)[2])[3]
                lost = [r for r in now if r[3] is None and r[5]] if free else []
                if lost:
                    left, here = Counter(p[5] for p in free.values()), Counter(r[5] for r in now)
                    moved = {p[5]: p[3] for p in free.values()}
                    for r in lost:
                        if left[r[5]] == 1 and here[r[5]] == 1:
                            r[3] = moved[r[5]]
                for r in now:
                    if r[3] is None:
                        r[3], tracks = tracks, tracks + 1
                    yield key, frame, r[4], r[3]
                before = now

    rows = reads.where("frame is not null").select(by, F.col("frame").cast("bigint").alias("frame"), F.col("row").cast("bigint").alias("row"), F.coalesce("text", F.lit("")).alias("text"), real("y"), real("h"))
    return in_order(rows, [by], ["frame", F.col("row").asc_nulls_last(), "text", "y", "h"], follow, {"frame": "bigint", "row": "bigint", "track": "bigint"})
