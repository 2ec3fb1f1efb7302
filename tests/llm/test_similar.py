"""Near-duplicate groups by shingle sets, the pipeline's stage and MinHash, against all pairs of sets."""

import random
import re

import numpy as np

from tests.llm.helpers import documents
from tidemark.llm import jaccard, minhash, simhash


def some_texts(seed):
    rng = random.Random(seed)
    said = lambda n: [rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3) for _ in range(n)]
    texts = [said(rng.choice([3, 5, 9, 60, 200])) for _ in range(40)]
    for t in list(texts):
        for share in (0.005, 0.015, 0.03, 0.05):
            texts.append(["new" if rng.random() < share else x for x in t])
        texts.append(t + said(max(1, len(t) // 5)))
    hub = said(80)
    texts += [[*hub[:k], "odd", *hub[k + 1 :]] for k in range(0, 80, 2)]
    rng.shuffle(texts)
    return texts


def plain_groups(texts, words):
    """The first text of each group, for lists of words."""
    sets = [{tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} if t else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, [len(s) for s in sets]


def test_copies_at_a_similarity_of_080_go(spark):
    texts = some_texts(21)
    root, _ = plain_groups(texts, 5)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for tile, tile_hashes in ((1 << 15, 200_000), (7, 500)):
        got = simhash.similar_groups(documents(spark, rows), "doc_id", 5, tile, tile_hashes).collect()
        assert {r.doc_id: r.first for r in got} == dict(enumerate(root))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows, ["__gone_id"])).collect()}
    assert kept == set(root) and len(kept) < len(texts) - 60
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def test_rows_that_share_or_lack_an_id_are_judged_by_their_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    kept = lambda rows: sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(documents(spark, rows)).collect())
    assert kept([(3, a), (5, a), (5, b), (7, c)]) == [(3, a), (5, b), (7, c)]
    assert kept([(5, a), (5, b), (7, c)]) == [(5, a), (5, b), (7, c)]
    assert kept([(None, a), (None, a), (None, b), (8, c), (8, c), (9, f"{c} d")]) == [(0, a), (0, b), (8, c)]


def test_minhash_equals_all_pairs(spark, monkeypatch):
    texts = some_texts(22)
    long = [f"w{k % 7000}" for k in range(30_000)]
    texts += [[], long, [*long, "more"], ["one"], ["One"], ["one", "two"], []]
    root, sizes = plain_groups([[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in t] for t in texts], 2)
    rows = [(i, "\t ".join(t)) for i, t in enumerate(texts)]
    rows[len(texts) - 1] = (len(texts) - 1, None)
    want = {i: (n, c, i == c) for i, (n, c) in enumerate(zip(sizes, root, strict=True))}
    found = lambda docs: {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert found(documents(spark, rows, ["__row", "node", "kept"])) == want
    monkeypatch.setattr(jaccard, "MEMBERS", 3)
    monkeypatch.setattr(minhash, "exact_components", lambda *a: jaccard.exact_components(*a, 500))  # many tiles
    assert found(documents(spark, rows)) == want
    odd = [(4, "a b c d"), (4, "x y z"), (2, "a b c d"), (None, "x y z"), (None, "lone"), (None, None), (9, "A b C d"), (9, "A b C d")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, odd)).collect()), key=str)
    assert got == sorted([(4, 3, 2, False), (4, 2, 4, True), (2, 3, 2, True), (None, 2, 4, False), (None, 1, None, True), (None, 0, None, True), (9, 3, 2, False), (9, 3, 2, False)], key=str)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_sketches_fill_and_tell_the_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [pool[:n] for n in (1, 2, 30, 1000)] + [pool[:900], pool[100:1000]]
    made = minhash.sketches(sets, 1024)
    assert (made != minhash.UNFILLED).all()
    assert (made[0] == made[1]).mean() > 0.4 and abs((made[4] == made[5]).mean() - 0.8) < 0.06 and abs((made[3] == made[4]).mean() - 0.9) < 0.05
    assert (minhash.sketches(sets[::-1], 1024)[::-1] == made).all()
    assert (minhash.bands(made[:, :160]) == minhash.bands(made[:, :160].copy())).all() and minhash.bands(made).shape == (6, 256)
