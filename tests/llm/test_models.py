"""Language ID, quality and nearest neighbours: defined cases, held-out accuracy and recall."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidemark.llm import language_id, neighbours, quality
from tidemark.llm.runtime import table


def test_language_of_held_out_rows(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs.withColumn("score", F.lit(1))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_rejection_parts_languages_from_shuffled_letters(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right, scores = np.array([r.lang == r.lang_pred for r in rows]), np.array([r.score for r in rows])
    bins = np.minimum((scores * 10).astype(int), 9)
    error = sum(abs(right[bins == b].mean() - scores[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    assert error < 0.12  # shuffled rows take part in the calibration, so real ones are a little better than their scores
    assert np.mean([r.accepted for r in rows]) > 0.99
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    odd = documents(spark, [(i, language_id.shuffled(x)) for i, (x, _) in texts.items() if len(x) > 200])
    assert np.mean([r.accepted for r in language_id.identify(odd, model).collect()]) < 0.2
    ids = sorted(texts)
    both = [(i, texts[i][0][:400] + " " + texts[j][0][:400]) for i, j in zip(ids, ids[7:], strict=False) if texts[i][1] != texts[j][1] and min(len(texts[i][0]), len(texts[j][0])) > 400]
    assert np.mean([r.accepted for r in language_id.identify(documents(spark, both), model).collect()]) > 0.97


def test_language_never_reads_other_columns_or_held_out_labels(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 300")
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    b = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))).collect()}
    assert a == b


def test_language_odd_rows(spark):
    rows = [(i, f"the of and {i}" if i % 2 else f"der die und {i}", "en" if i % 2 else "de") for i in range(80)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "x", None), (904, "the " * 400_000, "en"), (None, "der die", "de"), (905, "the of", "en"), (905, "the of", "en")]
    docs = documents(spark, rows, ["p", "y", "k"])
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[904].lang_pred == "en" and got[None].held_out is True and got[None].lang_pred == "de"
    kept = {r.doc_id for r in language_id.reject(docs).collect()}
    assert not kept & {900, 901, 902} and {1, 2, 3, 904} <= kept
    bare = documents(spark, [(1, "a b", None), (2, "c d", None)])
    assert [r.lang_pred for r in language_id.identify(bare).collect()] == ["und", "und"]
    assert language_id.identify(documents(spark, [])).count() == 0


def test_language_windows_add_up(monkeypatch):
    text = "the quick brown fox, jumps over; the lazy dog " * 50
    whole = language_id.gram_counts(text, 4096)
    monkeypatch.setattr(language_id, "WINDOW", 200)
    parts = language_id.gram_counts(text, 4096)
    assert abs(whole.sum() - parts.sum()) < 0.1 * whole.sum()


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    rows = quality.classify(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good[:300] for b in bad]) > 0.98
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_odd_rows(spark):
    rows = [(i, f"good clean words here {i}" if i % 2 else f"### $$$ {i} !!") for i in range(120)]
    docs = documents(spark, [*rows, (900, None), (901, ""), (902, "ok " * 500_000), (None, "fine"), (903, "x"), (903, "x")], ["score", "q", "id"])
    label = [(i, i % 2, 0) for i in range(120)] + [(5, 0, 0), (None, 1, 0), (7, None, 0), (8, 0, 0)]
    labels = spark.createDataFrame(label, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1 and got[None].held_out
    assert got[1].score > got[2].score and got[902].score is not None
    one = labels.where("quality = 1")
    assert {r.score for r in quality.classify(docs, one).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0


def test_dual_coordinate_descent_finds_the_margin():
    rng = np.random.default_rng(0)
    rows = [np.array([0, 2 + int(rng.integers(5))]) if k % 2 else np.array([1, 2 + int(rng.integers(5))]) for k in range(60)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(60)])
    w, b = quality.dual_coordinate_descent(rows, [np.ones(2)] * 60, y, 1.0, 200, rng)
    margins = np.array([w[r].sum() + b for r in rows]) * y
    assert margins.min() > 0.95 and abs(margins.min() - 1) < 0.1  # support vectors sit on the margin


def exact(ids, vectors, queries, top):
    out = {}
    norm = np.sqrt((vectors * vectors).sum(1))
    for q in queries:
        s = (vectors * vectors[q]).sum(1) / (norm * norm[q])
        s[ids == ids[q]] = -np.inf
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:top]]
    return out


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 40)
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    sf = "/root/testdata/sf0.1"
    df = table(spark, sf, "embeddings")
    rows = df.orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = exact(ids, v, np.flatnonzero(ids % 50 == 0), 5)
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({x for x, _ in want[q]} & {x for _, x, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [(-s, x) for _, x, s in found] == sorted((-s, x) for _, x, s in found)


def test_neighbours_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    rng = np.random.default_rng(2)
    hot = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, hot) for i in range(0, 60)] + [(i, rng.normal(size=4).tolist()) for i in range(60, 150)]
    bad = [(200, None), (250, [0.0] * 4), (300, [1.0, None, 1.0, 1.0]), (350, [float("nan")] * 4), (400, [float("inf"), 1.0, 1.0, 1.0]), (450, [1.0, 2.0]), (None, hot), (500, []), (50, hot)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("list", "v", "q", "score")})
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 50, 100}
    assert [x for _, x, _ in sorted(got[0])] == [1, 2, 3, 4, 5] and [x for _, x, _ in sorted(got[50])] == [0, 1, 2, 3, 4]
    few = df.where("vec_id in (100, 101, 102)")
    assert [x for _, x, _ in sorted((r.rank, r.vec_id, r.score) for r in neighbours.search(few).collect())].__len__() == 2
    assert neighbours.search(df.limit(0)).count() == 0 and neighbours.search(df.where("vec_id = 100")).count() == 0


def test_router_finds_near_centroids():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    router = neighbours.build_router(x, 30_000, 5)
    q = neighbours.unit(rng.normal(size=(200, 16)))
    ids, dist = router.search(q, 16)
    best = np.argmax(q @ router.centroids.T, axis=1)
    assert np.mean(ids[:, 0] == best) > 0.95 and (np.diff(dist, axis=1) >= 0).all()
