"""Repeated byte strings against a plain dictionary of all strings; the merge against sorting."""

import hashlib
import random

import numpy as np

from tests.llm.helpers import documents
from tidemark.llm import suffix_dedup as sd


def brute(rows, length):
    """rows: (id, text) in the order that decides which copy is earlier."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        runs = int(gone[:1].sum()) + int(((gone[1:]) & (~gone[:-1])).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["the", "of", "and", "reon", "thble", "é", "über", "ñ", "in", "x" * 30]
    para = [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = "\n".join(rng.choice(para) if rng.random() < 0.6 else " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(30)) for _ in range(rng.randint(0, 5)))
        if t and rng.random() < 0.3:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "Q", "é"]) + t[i + 1 :]
        out.append(t)
    return out + out[3:6] + ["a" * 500, "ab" * 300, "a" * 99, "a" * 100, "abc" * 33 + "a", "abc" * 80]


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digest(df).collect())


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = list(enumerate(corpus(seed)))
        df = documents(spark, rows, ["doc", "spot", "gram", "range"]).repartition(3)
        assert got(sd.deduplicate(df)) == brute(rows, 100)


def test_common_grams_leave_the_merge(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 2)
    rows = list(enumerate(corpus(6)))
    assert got(sd.deduplicate(documents(spark, rows))) == brute(rows, 100)


def test_other_lengths_and_long_parts(spark, monkeypatch):
    rows = list(enumerate(corpus(3, 20)))
    monkeypatch.setattr(sd, "BUFFER", 300)
    assert got(sd.deduplicate(documents(spark, rows), length=60, gram=16)) == brute(rows, 60)


def test_parts_of_long_texts_give_the_same_anchors():
    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    whole = sd.anchors(data, np.array([len(data)]), 100, 24)
    cut = []
    for a in range(0, len(data), 700):
        begin, stop = max(0, a - 76), min(len(data), a + 700)
        part = data[begin : stop + 100]
        at, h, c, left, right = sd.anchors(part, np.array([len(part)]), 100, 24)
        cut += [(p + begin, x, y, lo, hi) for p, x, y, lo, hi in zip(at, h, c, left, right, strict=True) if a <= p + begin < stop]
    assert cut == list(zip(*whole, strict=True))


def test_odd_rows(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(None, t), (5, t), (5, t), (5, t + "!"), (2, None), (3, ""), (9, "x" * 20)]
    out = got(sd.deduplicate(documents(spark, [r for r in rows if r[0] is not None])))
    assert [(d, n, r) for d, n, r, _, _ in out] == [(2, 0, 0), (3, 0, 0), *sorted([(5, 150, out[2][2])] * 2 + [(5, 151, out[4][2])]), (9, 20, 0)]
    assert sorted({out[2][2], out[4][2]}) == [0, 150]
    every = sd.digest(sd.deduplicate(documents(spark, rows))).collect()
    assert [(r.n_bytes, r.n_removed) for r in every if r.doc_id is None] == [(150, 150)]
    assert sd.deduplicate(documents(spark, [])).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(4)
    for runs in (1, 2, 3, 7):
        lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40))) for _ in range(runs)]
        out = list(sd.loser_tree_merge([sd.Run(*sd.front_coded(x)) for x in lists]))
        keys = [k for _, k, _ in out]
        assert keys == sorted(k for x in lists for k in x)
        assert [s for _, _, s in out][1:] == [sd.common(a, b, 0) for a, b in zip(keys, keys[1:])]
