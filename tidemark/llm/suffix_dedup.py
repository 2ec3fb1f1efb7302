"""Repeated byte strings: a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, at a smaller doc_id or earlier in the same
document.  Sorting a suffix for every byte of a corpus would move a hundred times its size, so suffixes start at anchors:
the least hash of ``GRAM`` bytes in each window of ``length - GRAM + 1``.  Equal strings of ``length`` bytes hold an anchor
at the same place, so each repeat is seen at one, and nothing is lost.

1. Anchors (a map): hash of the gram at the anchor, digest of its whole context (the bytes from which any string of
   ``length`` around the anchor is made), document, place.
   Repeats of a context among the anchors that a task holds at a time are seen there, so they are dealt evenly and not by their gram.
2. One shuffle by gram hash, sorted, to tasks whose number follows the bytes of the texts.  A stream over each partition
   drops grams that occur once, one row at a time, whatever the size of a group of copies.  Hashes and digests only tell
   what can't be a repeat, and how many contexts a gram has; what goes is decided by bytes.
3. Suffix sort of what is left.  Each task sorts its suffixes into runs; equal contexts of a run, byte for byte, are one
   suffix from then on, the earliest, and the others go, dealt evenly.  Runs are front-coded (length of the prefix shared
   with the one before, and the rest) and dealt to ranges of the gram hash; each range merges its runs by a loser tree that
   knows for each contender how much it shares with the last winner and compares bytes beyond that only.  A range holds
   about ``RANGE`` suffixes before copies fall together; a gram with more than ``HOT`` contexts leaves the merge, and the
   strings around its anchors are dealt by their own digests.
4. In the merged order, suffixes that share enough to the right are neighbours, and their left contexts, sorted the same
   way, give those that share enough to the left.  For each split of ``length`` between left and right the earliest of a
   class stays and the strings of the others go.
5. Removed stretches meet the texts by document: one shuffle of the texts, as in step 3.

Defined results: null text is empty; a text under ``length`` bytes loses nothing; a null doc_id comes after all others;
rows with one doc_id are separate texts in the order of their content's MD5, equal rows being one text whose result each
of them gets; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import MIXED_ROWS, keyed, materialize, small_batches

LENGTH, GRAM, RANGE, HOT, BUFFER, COLLAPSE, SLICE = 100, 24, 60_000, 240_000, 1 << 18, 500_000, 50_000
#: Bytes of text for each task of the shuffle by gram, so that a task's share stays as it is when the input grows.
TASK_BYTES = 32 << 20
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def tables(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the base to the powers k and -k modulo 2^64 for k < n at least."""
    size = 1 << max(16, int(n - 1).bit_length())
    if base not in _TABLES or len(_TABLES[base][1]) < size:
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _TABLES[base] = (np.random.default_rng(base & 1023).integers(0, 1 << 64, 256, np.uint64), np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _TABLES[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold of each window of that width, by doubling."""
    have, m = 1, x
    while 2 * have <= width:
        m = fold(m[:-have], m[have:])
        have *= 2
    return fold(m[: len(x) - width + 1], m[width - have : width - have + len(x) - width + 1])


def anchors(buffer: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end: place in the buffer, gram hash, context digest, bytes of context left and right."""
    n = len(buffer)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    of_byte, up, down = tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(of_byte[buffer] * up[:n], out=total[1:])
    h = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    low = (h >> np.uint64(33)).astype(np.uint32) | np.uint32(1)
    width = length - gram + 1
    least = sliding(low, width, np.minimum)  # of the string that starts at each place
    ends = np.cumsum(lengths)
    end_of = np.repeat(ends, lengths)
    starts = np.arange(len(least))
    least[end_of[: len(least)] - starts < length] = 0  # it would leave its text
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(len(low) - len(least), np.uint32)])
    at = np.flatnonzero(sliding(padded, width, np.maximum) == low)
    begin_of = np.repeat(ends - lengths, lengths)
    left = np.minimum(length - gram, at - begin_of[at])
    right = np.minimum(length, end_of[at] - at)
    of_byte, up, down = tables(n + 1, OTHER_BASE)  # numbers of its own, so that gram hash and digest are independent
    total[0] = 0
    np.cumsum(of_byte[buffer] * up[:n], out=total[1:])
    context = (total[at + right] - total[at - left]) * down[at - left]
    digest = mixed(context + (left.astype(np.uint64) << np.uint64(8)) + right.astype(np.uint64))
    return at, h[at], digest, left, right


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, context, doc and spot (place, left and right context packed into one number) of every anchor."""

    margin = length - gram

    def emit(group: list[tuple[int, bytes, int, int, int]]) -> pd.DataFrame:
        """group: document, bytes, where they begin in it, and between which places its anchors are asked for."""
        lengths = np.array([len(g[1]) for g in group], np.int64)
        at, h, digest, left, right = anchors(np.frombuffer(b"".join(g[1] for g in group), np.uint8), lengths, length, gram)
        of = np.searchsorted(np.cumsum(lengths), at, "right")
        doc, shift, low, high = (np.array([g[k] for g in group], np.int64)[of] for k in (0, 2, 3, 4))
        place = at - (np.cumsum(lengths) - lengths)[of] + shift
        mine = (place >= low) & (place < high)
        h = mixed(h)  # an anchor is a least hash: mixed again, its bits are even
        out = pd.DataFrame({"gram": h.view(np.int64), "context": digest.view(np.int64), "doc": doc, "spot": place << 16 | left << 8 | right})
        return out[mine]

    def repeats_marked(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """again: a repeat of a context among the anchors at hand; more: one that has or is a repeat, so its gram occurs again."""
        rows = pd.concat(parts, ignore_index=True)
        key = rows["gram"].to_numpy().view(np.uint64) * np.uint64(BASE) + rows["context"].to_numpy().view(np.uint64)
        order = np.lexsort((rows["spot"].to_numpy(), rows["doc"].to_numpy()))
        order = order[np.argsort(key[order], kind="stable")]
        again, more = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        more[order[:-1]] = again[order[1:]]
        deal = np.where(again, mixed(rows["spot"].to_numpy().view(np.uint64) + rows["doc"].to_numpy().view(np.uint64) * np.uint64(BASE)).view(np.int64), rows["gram"])
        rows = rows.assign(again=again, more=more | again, deal=deal)
        for k in range(0, len(rows), SLICE):
            yield rows.iloc[k : k + SLICE]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, size, parts, held = [], 0, [], 0
        for batch in batches:
            for doc, text in zip(batch["doc"].to_numpy(), batch["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                for a in range(0, len(data), BUFFER):  # long texts in parts that overlap by all that an anchor depends on
                    begin, stop = max(0, a - margin), min(len(data), a + BUFFER)
                    part = data[begin : stop + length]
                    group.append((doc, part, begin, a, stop))
                    size += len(part)
                    if size >= BUFFER:
                        parts.append(emit(group))
                        held += len(parts[-1])
                        group, size = [], 0
                        if held >= COLLAPSE:
                            yield from repeats_marked(parts)
                            parts, held = [], 0
        if group:
            parts.append(emit(group))
        if parts:
            yield from repeats_marked(parts)

    return texts.select("doc", "text").mapInPandas(scan, "gram long, context long, doc long, spot long, again boolean, more boolean, deal long")


def recurring(found: DataFrame) -> DataFrame:
    """gram, doc, spot and new (the first of its context here) of the anchors whose gram occurs more than once."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("gram", "context", "doc", "spot", "more")
        held = None  # the last row, and whether it is new and its gram was there before
        for batch in batches:
            known = batch["again"].to_numpy(bool)
            if known.any():
                yield batch.loc[known, ["gram", "doc", "spot"]].assign(new=False)
                batch = batch[~known]
            g, c, d, s, more = (batch[k].to_numpy() for k in columns)
            if not len(g):
                continue
            if held is not None:
                g, c, d, s, more = (np.concatenate([[x], y]) for x, y in zip(held[0], (g, c, d, s, more), strict=True))
            as_before = np.concatenate([[False], g[1:] == g[:-1]])
            new = ~(as_before & np.concatenate([[False], c[1:] == c[:-1]]))
            if held is not None:
                new[0], as_before[0] = held[1]
            keep = as_before | more.astype(bool)
            keep[:-1] |= as_before[1:]
            yield pd.DataFrame({"gram": g[:-1], "doc": d[:-1], "spot": s[:-1], "new": new[:-1]})[keep[:-1]]
            held = (g[-1], c[-1], d[-1], s[-1], more[-1]), (bool(new[-1]), bool(as_before[-1]))
        if held is not None and (held[1][1] or held[0][4]):
            yield pd.DataFrame({"gram": [held[0][0]], "doc": [held[0][2]], "spot": [held[0][3]], "new": [held[1][0]]})

    return found.mapInPandas(stream, "gram long, doc long, spot long, new boolean")


def common(a: bytes, b: bytes, known: int) -> int:
    """How long a prefix a and b share, given that they share ``known`` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(sorted_keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, rest lengths and rests of sorted byte strings under 256 bytes."""
    shared, rest, last = [], [], b""
    for key in sorted_keys:
        k = common(last, key, 0)
        shared.append(k)
        rest.append(key[k:])
        last = key
    return bytes(shared), bytes(map(len, rest)), b"".join(rest)


class Run:
    """A front-coded run, read one string at a time."""

    def __init__(self, shared: bytes, sizes: bytes, rests: bytes):
        self.shared, self.sizes, self.rests, self.next, self.at, self.key = shared, sizes, rests, 0, 0, b""

    def advance(self) -> tuple[bytes | None, int]:
        """The next string and how much it shares with the one before; None at the end."""
        if self.next == len(self.shared):
            return None, 0
        k, n = self.shared[self.next], self.sizes[self.next]
        self.key = self.key[:k] + self.rests[self.at : self.at + n]
        self.at += n
        self.next += 1
        return self.key, k


def loser_tree_merge(runs: list[Run]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, prefix shared with the string before) in sorted order.

    Each contender carries the prefix it shares with the last winner.  The one that shares more is smaller and nothing is
    compared; at equal lengths bytes are compared from there on, and the loser keeps what it shares with its winner.
    """
    n = 1
    while n < len(runs):
        n *= 2
    heads = [run.advance() for run in runs] + [(None, 0)] * (n - len(runs))
    keys, known = [h[0] for h in heads], [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k = common(x, y, known[a])
        if k == len(x) or k < len(y) and x[k] <= y[k]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    losers, level = [0] * n, list(range(n))
    width = n
    while width > 1:
        winners = []
        for j in range(0, width, 2):
            w, lost = play(level[j], level[j + 1])
            winners.append(w)
            losers[(width + j) // 2] = lost
        level, width = winners, width // 2
    top = level[0]
    while keys[top] is not None:
        yield top, keys[top], known[top]
        keys[top], known[top] = runs[top].advance() if top < len(runs) else (None, 0)
        node, now = (top + n) // 2, top
        while node:
            now, losers[node] = play(now, losers[node])
            node //= 2
        top = now


def collapsed(keys: list[bytes], lefts: list[bytes], docs: list[int], spots: list[int]) -> tuple[list[int], list[list[int]]]:
    """Places in sorted order of keys, once for each context (suffix and what stands left of it), the earliest; and beside
    each the places of its repeats."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    firsts, repeats, at = [], [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and keys[order[end]] == keys[order[at]]:
            end += 1
        if end == at + 1:
            firsts.append(order[at])
            repeats.append([])
        else:
            same: dict[tuple[bytes, int], list[int]] = {}
            for i in sorted(order[at:end], key=lambda i: (docs[i], spots[i])):
                same.setdefault((lefts[i], int(spots[i]) >> 8 & 255), []).append(i)
            firsts += [group[0] for group in same.values()]
            repeats += [group[1:] for group in same.values()]
        at = end
    return firsts, repeats


def sorted_runs(texts: DataFrame, firsts: DataFrame, length: int, gram: int, ranges: int) -> DataFrame:
    """One row per task batch and range: a front-coded run of the suffixes, with what each needs for step 4; and one row per
    batch, under a range of its own (below 0), for the repeats.  part deals the rows to as many tasks as there are ranges."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = -1 - (TaskContext.get().partitionId() << 20)
        keys, docs, spots, lefts = [], [], [], []
        longs = lambda values: np.array(values, np.int64).tobytes()

        def flush() -> pd.DataFrame:
            order, repeats = collapsed(keys, lefts, docs, spots)
            top = [int.from_bytes(keys[i][:8], "big") * ranges >> 64 for i in order]
            cuts = [0, *(i for i in range(1, len(order)) if top[i] != top[i - 1]), len(order)]
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = order[a:b]
                rows.append((top[a], *front_coded([keys[i] for i in part]), longs([docs[i] for i in part]), longs([spots[i] for i in part]), b"".join(lefts[i] for i in part)))
            if gone := [i for some in repeats for i in some]:
                rows.append((own, b"", b"", b"", longs([docs[i] for i in gone]), longs([spots[i] for i in gone]), b""))
            out = pd.DataFrame(rows, columns=["range", "shared", "sizes", "rests", "docs", "spots", "lefts"])
            return out.assign(part=(out["range"] % ranges).astype("int32"))

        for batch in batches:
            for doc, text, gs, ss in zip(batch["doc"], batch["text"], batch["grams"], batch["spots"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for g, s in zip(gs, ss, strict=True):
                    at = int(s) >> 16
                    keys.append((int(g) & (1 << 64) - 1).to_bytes(8, "big") + data[at : at + length])
                    docs.append(doc)
                    spots.append(s)
                    lefts.append(data[max(0, at - length + gram) : at][::-1].ljust(length - gram, b"\0"))
                if len(keys) >= 200_000:
                    yield flush()
                    keys, docs, spots, lefts = [], [], [], []
                    own -= 1
        if keys:
            yield flush()

    return anchored_texts(texts, firsts).mapInPandas(build, "range long, shared binary, sizes binary, rests binary, docs binary, spots binary, lefts binary, part int")


def judged(rows: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """Stretches to remove (doc, spot) among the suffixes of one range, or of repeats: all that their contexts hold."""
    if rows["range"].iloc[0] < 0:
        doc, at = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[k]]) for k in ("docs", "spots"))
        back, ahead = at >> 8 & 255, at & 255
        whole = back + ahead >= length
        return pd.DataFrame({"doc": doc[whole], "spot": (((at >> 16) - back) << 32 | ((at >> 16) + ahead))[whole]})
    runs = [Run(a, b, c) for a, b, c in zip(rows["shared"], rows["sizes"], rows["rests"], strict=True)]
    docs = [np.frombuffer(x, np.int64) for x in rows["docs"]]
    spots = [np.frombuffer(x, np.int64) for x in rows["spots"]]
    lefts = [np.frombuffer(x, np.uint8).reshape(-1, length - gram) for x in rows["lefts"]]
    merged = [(run, runs[run].next - 1, shared) for run, _, shared in loser_tree_merge(runs)]
    run, i, shared = (np.array(x, np.int64) for x in zip(*merged, strict=True))
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])[run] + i
    doc, spot, left = np.concatenate(docs)[base], np.concatenate(spots)[base], np.concatenate(lefts)[base]
    shared = np.maximum(shared - 8, 0)  # the gram hash stands before the suffix
    place, have_left, have_right = spot >> 16, spot >> 8 & 255, spot & 255
    order = np.lexsort(tuple(left.T[::-1]))
    apart = left[order[1:]] != left[order[:-1]]
    left_shared = np.where(apart.any(1), apart.argmax(1), length - gram)
    earliest = np.lexsort((place, doc))
    low, high = np.full(len(doc), 1 << 30), np.full(len(doc), -1)
    for back in range(length - gram + 1):
        ahead = length - back
        ok = earliest[(have_left[earliest] >= back) & (have_right[earliest] >= ahead)]
        if len(ok) < 2:
            continue
        right_class = np.cumsum(np.concatenate([[0], shared[1:] < ahead]))
        left_class = np.empty(len(doc), np.int64)
        left_class[order] = np.cumsum(np.concatenate([[0], left_shared < back]))
        _, first = np.unique(right_class[ok] * len(doc) + left_class[ok], return_index=True)
        later = np.ones(len(ok), bool)
        later[first] = False
        gone = ok[later]
        low[gone] = np.minimum(low[gone], back)
        high[gone] = np.maximum(high[gone], back)
    hit = high >= 0
    return pd.DataFrame({"doc": doc[hit], "spot": (place[hit] - high[hit]) << 32 | (place[hit] + length - low[hit])})


def anchored_texts(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc, text, grams and spots of the texts that hold anchors."""
    wanted = firsts.groupBy("doc").agg(F.collect_list(F.struct("gram", "spot")).alias("a"))  # anchors of one text
    wanted = wanted.select(F.col("doc").alias("of"), F.transform("a", lambda x: x["gram"]).alias("grams"), F.transform("a", lambda x: x["spot"]).alias("spots"))
    return texts.select("doc", "text").join(wanted, F.col("doc") == F.col("of")).select("doc", "text", "grams", "spots")


def repeated_windows(texts: DataFrame, firsts: DataFrame, length: int, gram: int) -> DataFrame:
    """doc and spot of the strings around anchors of very common grams that stand earlier.

    A gram with more contexts than a range should hold is not merged in one task: its strings are dealt by their own
    digest, and a digest is reduced to its earliest place before the join back.
    """

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text, spots in zip(batch["doc"], batch["text"], batch["spots"], strict=True):
                data, rows = text.encode("utf-8", "surrogatepass"), []
                for s in spots:
                    place, left, right = int(s) >> 16, int(s) >> 8 & 255, int(s) & 255
                    for begin in range(place - left, place + right - length + 1):
                        d = hashlib.blake2b(data[begin : begin + length], digest_size=16).digest()
                        rows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc, begin))
                yield pd.DataFrame(rows, columns=["d1", "d2", "doc", "begin"])

    each = materialize(anchored_texts(texts, firsts).mapInPandas(strings, "d1 long, d2 long, doc long, begin long").distinct(), "strings")
    least = each.groupBy("d1", "d2").agg(F.min(F.struct("doc", "begin")).alias("least"), F.count("*").alias("n")).where("n > 1")
    later = each.join(least, ["d1", "d2"]).where(F.struct("doc", "begin") > F.col("least"))
    return later.select("doc", (F.shiftleft("begin", 32) + F.col("begin") + length).alias("spot"))


def removed_runs(spots: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the packed stretches."""
    if not len(spots):
        return []
    spots = np.sort(spots)
    begin, end = spots >> 32, np.maximum.accumulate(spots & (1 << 32) - 1)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return list(zip(begin[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist(), strict=True))


def stretches(texts: DataFrame, n_bytes: int, length: int, gram: int) -> DataFrame:
    """doc and spot (begin and end packed into one number) of stretches that go; they may overlap.  One row a doc comes in."""
    spark = texts.sparkSession
    found = anchored(texts, length, gram)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    dealt = found.repartition(n, "deal").sortWithinPartitions("again", "gram", "context", "doc", "spot")
    known = materialize(recurring(dealt), "recurring")
    firsts = known.select("gram", "doc", "spot")
    hot = known.where("new").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram")
    hot = materialize(hot, "hot")  # at most one gram for HOT contexts
    if hot.limit(1).count():
        wide = firsts.join(hot, "gram", "left_semi")
        firsts = firsts.join(hot, "gram", "left_anti")
        by_window = materialize(repeated_windows(texts, wide, length, gram), "windows")
    else:
        by_window = None
    ranges = max(1, -(-firsts.count() // RANGE))
    runs = sorted_runs(texts, firsts, length, gram, ranges)
    merged = runs.repartitionById(ranges, F.col("part")).groupBy("part", "range").applyInPandas(lambda rows: judged(rows, length, gram), "doc long, spot long")
    out = materialize(merged, "merged")
    return out if by_window is None else out.unionByName(by_window)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the removed runs (begin and end in turn), the digest of the bytes kept and, if
    asked for, those bytes, for every row."""
    picked = small_batches(docs, MIXED_ROWS, tidy=True).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts, single = keyed(picked, "doc")
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    gone = stretches(texts if single else texts.dropDuplicates(["doc"]), n_bytes, length, gram).groupBy(F.col("doc").alias("of")).agg(F.collect_set("spot").alias("spots"))  # those of one text
    joined = texts.join(gone, F.col("doc") == F.col("of"), "left").select("doc_id", "text", "spots")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spots in zip(batch["doc_id"], batch["text"], batch["spots"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = removed_runs(np.asarray(spots, np.int64)) if spots is not None else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]]) if runs else data
                rows.append((doc, len(data), len(data) - len(kept), len(runs), [x for r in runs for x in r], hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "runs", "kept_sha256", *["kept"] * with_bytes])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, runs array<long>, kept_sha256 string" + ", kept binary" * with_bytes)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
