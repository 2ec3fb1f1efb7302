"""Decontamination against all alignments tried one by one."""

import random

import duckdb

from tests.llm.helpers import documents
from tidemark.llm import decontamination


def plain_overlaps(docs, items):
    """(doc_id, item_id): start, matched, item_words of the best alignment; nothing is seeded."""
    out = {}
    for d, text in docs:
        t = text.split()
        for i, item in items:
            w, found = item.split(), []
            for start in range(1 - len(w), len(t)):
                same = "".join("01"[0 <= start + j < len(t) and t[start + j] == x] for j, x in enumerate(w))
                if 5 * same.count("1") >= 4 * len(w) or "1" * 13 in same:
                    found.append((same.count("1"), -start))
            if found:
                out[d, i] = (-max(found)[1], max(found)[0], len(w))
    return out


def test_every_pattern_at_the_threshold_is_found(spark):
    rng = random.Random(17)
    items = [(n, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for n in range(1, 31)] + [(n, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for n in (35, 61, 100)]
    docs = []
    for n, text in items:
        w, k = text.split(), n // 5
        places = [set(range(k)), set(range(n - k, n)), *[set(rng.sample(range(n), k)) for _ in range(6)], set(rng.sample(range(n), k + 1))]
        places += [{p} for p in range(n)] if n <= 12 else []
        for off in places:
            body = ["other" if j in off else x for j, x in enumerate(w)]
            docs.append((len(docs), " ".join([*["before"] * rng.randrange(3), *body, *["after"] * rng.randrange(3)])))
        docs += [(len(docs), "" if n == 1 else " ".join(w[k:])), (len(docs) + 1, " ".join(w[: n - k])), (len(docs) + 2, " ".join(w[k + 1 :]))]
        for a in range(0, n - 12, 5):
            docs.append((len(docs), " ".join(["before", *w[a : a + 13], "after"])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.matched, r.item_words) for r in decontamination.overlaps(documents(spark, docs), bench).collect()}
    want = plain_overlaps(docs, items)
    assert {n for _, n in want} == {n for n, _ in items} and got == want
    by_shuffle = decontamination.overlaps(documents(spark, docs), bench, limit=0).collect()
    assert {(r.doc_id, r.item_id): (r.start, r.matched, r.item_words) for r in by_shuffle} == want


def test_equals_its_sql_twin(spark, tmp_path):
    rng = random.Random(19)
    items = [(n, " ".join(f"w{rng.randrange(60)}" for _ in range(n % 40))) for n in range(60)] + [(100, None), (101, " . ")]
    docs = [(k, " ".join(x for x in items[rng.randrange(60)][1].split() if rng.random() > 0.1)) for k in range(80)] + [(80, None), (81, ""), (None, items[30][1]), (None, items[31][1]), (5, items[20][1])]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    want = c.execute(f"SELECT doc_id, item_id, start, matched, item_words, overlap FROM ({decontamination.ORACLE_SQL})").fetchall()
    for limit in (1 << 25, 0):
        got = decontamination.overlaps(documents(spark, docs), bench, limit=limit).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 60


def test_other_thresholds(spark):
    item = " ".join(f"w{k}" for k in range(20))
    w = item.split()
    docs = [(k, " ".join("other" if j % 20 < k else x for j, x in enumerate(w))) for k in range(12)] + [(20, " ".join("other" if j % 2 else x for j, x in enumerate(w)))]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    for threshold, most in ((1.0, 0), (0.95, 1), (0.5, 10)):
        got = {r.doc_id for r in decontamination.overlaps(documents(spark, docs), bench, threshold).collect()}
        assert got == {k for k in range(12) if k <= max(most, 7)} | ({20} if threshold == 0.5 else set())


def test_a_long_text_of_passages_under_many_ids(spark):
    rng = random.Random(23)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    text = " ".join(["before", *passage * 500, *passage[:20]])  # no row of a place or of a hit may carry it
    bench = spark.createDataFrame([(k, " ".join(passage)) for k in range(60)] + [(0, "absent words"), (7, " ".join(passage[5:]))], "item_id bigint, text string")
    for limit in (1 << 25, 0):
        got = sorted(map(tuple, decontamination.overlaps(documents(spark, [(1, text), (2, "no passage")]), bench, limit=limit).collect()))
        assert got == [(1, k, 1, 40, 40, 1.0) for k in range(60)]
    assert [r.doc_id for r in decontamination.drop_contaminated(documents(spark, [(1, text), (2, "no passage")]), bench).collect()] == [2]


def test_alignments_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 5)
    rng = random.Random(29)
    items = [(n, " ".join(f"w{rng.randrange(300)}" for _ in range(n))) for n in (1, 2, 6, 14, 17, 33)]
    docs = [(k, " ".join([f"w{rng.randrange(300)}" for _ in range(k % 19)] + items[k % 6][1].split()[k % 4 :] + ["after"] * (k % 7))) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (1 << 25, 0):
        got = {(r.doc_id, r.item_id): (r.start, r.matched, r.item_words) for r in decontamination.overlaps(documents(spark, docs), bench, limit=limit).collect()}
        assert got == plain_overlaps(docs, items) and len(got) > 40
