"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit.  Documents and gaps are kept sorted by size; a successor sweep over the sorted order pairs
every gap with the largest waiting document that fits; documents that want the same gap are told apart by their rank
among equals; gaps shrink; the round repeats until no gap takes a document, and then new sequences are opened.

Sizes are whole numbers up to the capacity, so the range-sorted documents and gaps are exchanged as runs of equal size:
a pre-aggregated ``(size, count)`` table with at most ``capacity`` rows, whatever the corpus.  A sweep matches runs with
runs, splitting them where the counts differ.  What it yields is a plan of rank intervals, ``(size, first rank, last
rank) -> (first sequence, offset)``, bounded by runs and rounds and not by documents.  Each piece then finds its place
from its own rank: its ordinal within its partition and size, numbered when it was tokenised, plus the number of pieces
of that size in earlier partitions.  No key is ever gathered into one task, whatever share of the rows has one size.

Steps: tokenise in a map (ids are never shuffled; length and checksum are), write the pieces to the shared folder, count
by (partition, size), sweep, place by a join on (partition, size) whose one side has a row for each such pair.

Defined results: null text is the empty text, whose document is the lone end token; repeated rows are packed as often as
they occur; a null doc_id is packed and stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.runtime import materialize, small_batches

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ordinal long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``part`` and ``ordinal`` number the pieces of one length within a task's output."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part, seen = tokens.encoder(tokenizer).ids, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                begins = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])) + ((ids[a:b].astype(np.int64),) if with_ids else ()))
                    seen[b - a] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInPandas(cut, PIECES + ", ids array<long>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals (size, first rank, rank after the last, first sequence, offset) for ``counts`` pieces by size."""
    waiting = {s: [0, n] for s, n in counts.items() if n}  # size -> next rank, rank after the last
    intervals: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, how many)
    opened = 0

    def take(size: int, count: int, sequence: int, gap: int, into: dict[int, list[tuple[int, int]]]) -> None:
        rank, stop = waiting[size]
        intervals.append((size, rank, rank + count, sequence, capacity - gap))
        if gap > size:
            into.setdefault(gap - size, []).append((sequence, count))
        waiting[size][0] = rank + count
        if rank + count == stop:
            del waiting[size]

    def sweep() -> bool:
        """One round: every gap gets one document at most; the last waiting size at or under a gap is its match."""
        nonlocal gaps
        left, free, placed = {}, {s: stop - rank for s, (rank, stop) in waiting.items()}, False
        sizes, stack, at = sorted(waiting), [], 0
        for gap in sorted(gaps):
            while at < len(sizes) and sizes[at] <= gap:
                stack.append(sizes[at])
                at += 1
            for sequence, count in gaps[gap]:
                while count and stack:
                    size = stack[-1]
                    n = min(count, free[size])
                    take(size, n, sequence, gap, left)
                    free[size] -= n
                    sequence, count, placed = sequence + n, count - n, True
                    if not free[size]:
                        stack.pop()
                if count:
                    left.setdefault(gap, []).append((sequence, count))
        gaps = merged(left)
        return placed

    def merged(runs: dict[int, list[tuple[int, int]]]) -> dict[int, list[tuple[int, int]]]:
        """Adjoining runs of one gap become one, so that rounds don't multiply runs."""
        out = {}
        for gap, parts in runs.items():
            parts.sort()
            joined = [parts[0]]
            for sequence, count in parts[1:]:
                if joined[-1][0] + joined[-1][1] == sequence:
                    joined[-1] = (joined[-1][0], joined[-1][1] + count)
                else:
                    joined.append((sequence, count))
            out[gap] = joined
        return out

    for size in sorted((s for s in waiting if 2 * s > capacity), reverse=True):  # no two of these share a sequence
        count = waiting[size][1] - waiting[size][0]
        take(size, count, opened, capacity, gaps)
        opened += count
    while waiting:
        while waiting and gaps and sweep():
            pass
        if not waiting:
            break
        need = -(-sum(s * (stop - rank) for s, (rank, stop) in waiting.items()) // capacity)
        for size in sorted(waiting, reverse=True):
            count = min(need, waiting[size][1] - waiting[size][0])
            take(size, count, opened, capacity, gaps)
            opened, need = opened + count, need - count
            if not need:
                break
    return intervals


def place(pieces: DataFrame, intervals: list[tuple[int, int, int, int, int]], keep: list[str]) -> DataFrame:
    """sequence_id and offset of every piece, found from its size and its rank among the pieces of that size."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select(
        F.col("part").alias("p"),
        F.col("length").alias("l"),
        (F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("ahead"),
    )
    ranked = pieces.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")), "left").withColumn("rank", F.col("ahead") + F.col("ordinal"))
    table = np.array(sorted(intervals), np.int64).reshape(-1, 5)
    shift = np.int64(1 << 48)
    keys = table[:, 0] * shift + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def find(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(keys, size * shift + rank, "right") - 1
        return pd.DataFrame({"sequence_id": table[i, 3] + rank - table[i, 1], "offset": table[i, 4]})

    return ranked.withColumn("spot", find("length", "rank")).select(*keep, "spot.sequence_id", "spot.offset")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and its ids, if asked for)."""
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    pieces = materialize(tokenized_pieces(docs, tokenizer or tokens.default_path(), capacity, end, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    return place(pieces, plan(counts, capacity), keep)
