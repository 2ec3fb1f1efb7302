"""The pipeline's stages on a small corpus with known copies, leaks and repeated lines."""

import random

from tests.llm.helpers import documents

import corpus_pipeline
from tidemark.llm import queries


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = {"en": ["the", "of", "and", "then", "there", "with", "which", "shall"], "de": ["der", "die", "und", "nicht", "über", "sich", "auch", "schön"]}
    said = lambda k, n: " ".join(rng.choice(vocabulary[k]) + rng.choice(["", "er", "en", "ing"]) for _ in range(n))
    rows = [(i, said("en" if i % 2 else "de", 60) + f"\n{said('en' if i % 2 else 'de', 40)}", "en" if i % 2 else "de") for i in range(120)]
    leak = " ".join(f"leaked{k}" for k in range(30))
    rows += [(200, said("en", 30) + "\n" + leak, "en"), (201, None, "en"), (202, "12345 67890", "en"), (203, rows[3][1], "en"), (204, said("en", 50) + "\n" + rows[5][1].split("\n")[0], "en")]
    near = rows[7][1].replace("\n", " ")
    rows += [(205, near, "en")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in at.collect()}
    assert not {201, 202} & set(seen["language_id"]) and set(range(120)) <= set(seen["language_id"])
    assert 203 not in seen["line_dedup"] and rows[5][1].split("\n")[0] not in seen["line_dedup"][204]
    assert 205 in seen["line_dedup"] and 205 not in seen["simhash"] and 7 in seen["simhash"]
    assert 200 in seen["simhash"] and 200 not in seen["decontamination"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(seen["decontamination"])


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "of", "and", "then", "there", "with", "which", "shall"]
    said = lambda n: " ".join(rng.choice(words) + rng.choice(["", "er", "en", "ing"]) for _ in range(n))
    other = lambda n: " ".join(rng.choice(["der", "die", "und", "nicht", "sich"]) + rng.choice(["", "en", "ung"]) for _ in range(n))
    rows = [(i, said(50) if i % 2 else other(50), "en" if i % 2 else "de") for i in range(100)]
    odd = [(None, said(50), "en"), (None, said(50), "en"), (7, said(50), "en"), (7, rows[7][1], "en"), (300, None, None), (301, "", "en"), (302, "?!", "de"), (303, said(30_000), "en")]
    docs = documents(spark, rows + odd, ["__row", "__gone", "__gone_id", "__n_removed", "__lang_prediction", "score"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never met " * 5), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.columns == docs.columns
    kept = at.collect()
    assert sum(r.doc_id is None for r in kept) == 2 and {303} | set(range(100)) <= {r.doc_id for r in kept} and not {300, 301, 302} & {r.doc_id for r in kept}
    assert sum(r.doc_id == 7 for r in kept) == 2  # two texts, of which one also repeats
    bare = at.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, bare, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_a_long_text_of_passages_leaves_at_decontamination(spark, tmp_path):
    passage = [f"word{k}" for k in range(40)]
    docs = documents(spark, [(1, " ".join(passage * 500)), (2, "no passage"), (None, " ".join(passage)), (3, None)])
    spark.createDataFrame([(k, " ".join(passage)) for k in range(60)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs.columns
