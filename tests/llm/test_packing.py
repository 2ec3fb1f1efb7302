"""Packing: exact round trip of tokens, legal sequences, few of them."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import documents
from tidemark.llm import packing, tokens


def legal(intervals, counts, capacity):
    """Every piece once, no sequence over capacity, offsets gapless; the number of sequences."""
    used, seen = {}, {}
    for size, a, b, sequence, offset in intervals:
        assert a < b
        for k in range(b - a):
            used.setdefault(sequence + k, []).append((offset, size))
        seen.setdefault(size, []).append((a, b))
    for size, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == counts[size] and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    assert set(seen) == {s for s, n in counts.items() if n}
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_legal_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 2048])
    counts = {}
    for _ in range(rng.randint(0, 3000)):
        size = min(capacity, max(1, int(rng.lognormvariate(np.log(capacity / 4), 0.9))))
        counts[size] = counts.get(size, 0) + 1
    n = legal(packing.plan(counts, capacity), counts, capacity)
    total = sum(s * k for s, k in counts.items())
    large = sum(k for s, k in counts.items() if 2 * s > capacity)
    assert n <= max(large, -(-total // capacity)) * 1.05 + 2


def test_plan_of_one_hot_size():
    assert legal(packing.plan({1: 10_000, 2047: 3}, 2048), {1: 10_000, 2047: 3}, 2048) <= 3 + 6
    assert packing.plan({}) == []


def test_pack_round_trip(spark):
    path = tokens.default_path()
    rng = random.Random(1)
    texts = [None, "", "a", "word " * 5000, "é" * 300, "x" * 9000, " \n\t ", "<|endoftext|> inside", "\U0001f600 emoji", *(" ".join(rng.choice(["the", "of", "reon", "12", "!"]) for _ in range(rng.randint(1, 900))) for _ in range(60))]
    rows = [*enumerate(texts), (None, "no id"), (3, "again"), (3, "again")]
    got = packing.pack(documents(spark, rows, ["piece", "start", "part", "length", "rank"]).repartition(3), with_ids=True).collect()
    plain = tokens.Encoder(path).plain
    want = {}
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = want.get(i, []) + ids
    for i in {r[0] for r in rows} - {3}:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == want[i]
        assert [r.piece for r in mine] == list(range(len(mine))) and all(len(r.ids) == 2048 for r in mine[1:])
        assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1])
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(len(v) for v in want.values()) == sum(r.length for r in got)
    assert packing.pack(documents(spark, [])).count() == 0


def test_rank_encoder_is_in_use_and_equal():
    e = tokens.Encoder(tokens.default_path())
    assert e.ranked is not None
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(chr(rng.choice([32, 10, 9, 39, 65, 97, 115, 233, 0x4E2D, 0x1F600, 48, 33, 0x300])) for _ in range(rng.randint(0, 60)))
        assert e.ids(t).tolist() == e.plain.encode(t, add_special_tokens=False).ids


def fewest(sizes, capacity):
    """The least number of sequences, by trying all ways."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_plans_beside_the_fewest_sequences():
    rng = random.Random(12)
    over = 0
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = {s: sizes.count(s) for s in set(sizes)}
        n, least = legal(packing.plan(counts, 20), counts, 20), fewest(sizes, 20)
        assert least <= n <= least + 1
        over += n - least
    assert over <= 15


def test_ids_of_whole_documents(spark):
    encoder = tokens.encoder(tokens.default_path())
    assert encoder.ranked is not None
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect():
        assert encoder.ids(text).tolist() == encoder.plain.encode(text, add_special_tokens=False).ids
