"""Histories without removed commits, forests in reading order, work in pieces: against plain versions."""

import random
import sys

from pyspark.sql import functions as F

from tidemark.operators import graph, pieces
from tidemark.sources.versions import VersionedStore


def test_survivors_keep_their_ancestry(spark):
    rng = random.Random(9)
    parents = {0: []}
    for c in range(1, 120):
        parents[c] = rng.sample(range(max(0, c - 12), c), min(c, rng.choice([1, 1, 1, 2, 3]))) if c % 17 else []
    gone = {c for c in parents if rng.random() < 0.6} | set(range(40, 70))
    rows = [(c, p, k) for c, ps in parents.items() for k, p in enumerate(ps)] + [(c, None, 0) for c, ps in parents.items() if not ps]
    got = graph.compacted(spark.createDataFrame(rows, "commit bigint, parent bigint, place int"), spark.createDataFrame([(c,) for c in gone], "commit bigint")).collect()
    new = {}
    for r in sorted(got, key=lambda r: (r.commit, r.place)):
        new.setdefault(r.commit, []).extend([] if r.parent is None else [r.parent])

    def above(of, c):
        seen, todo = set(), list(of[c])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += of[x]
        return seen

    def nearest(c):
        seen, out, todo = set(), set(), list(parents[c])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += parents[x] if x in gone else []
                out |= {x} - gone
        return out

    assert set(new) == set(parents) - gone
    for c in new:
        assert above(new, c) == above(parents, c) - gone and set(new[c]) == nearest(c) and len(new[c]) == len(set(new[c]))


def depth_first(nodes):
    """nodes: id -> (parent, order).  Roots in order, then trees with a cycle from their least node; each node once."""
    sys.setrecursionlimit(20_000)
    kids = {}
    for i, (p, _) in nodes.items():
        kids.setdefault(p, []).append(i)
    by = lambda ids: sorted(ids, key=lambda i: (nodes[i][1], i))
    out, seen = [], set()

    def walk(i):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                out.append(x)
                todo += reversed([k for k in by(kids.get(x, [])) if k not in seen])

    for i in by([i for i, (p, _) in nodes.items() if p not in nodes]):
        walk(i)
    heads = set()
    for i in nodes:
        if i not in seen:
            x, path = i, []
            while x not in path:
                path.append(x)
                x = nodes[x][0]
            heads.add(min(path[path.index(x) :]))
    for i in by(heads):
        walk(i)
    return out


def test_forests_in_reading_order(spark):
    rng = random.Random(6)
    nodes = {i: (rng.choice([None, 10_000, *range(max(0, i - 9), i)]) if i % 3 else (rng.randrange(i) if i else None), rng.randrange(5)) for i in range(150)}
    nodes |= {200: (202, 1), 201: (200, 0), 202: (201, 3), 203: (201, 2), 204: (203, 0), 210: (210, 0)}
    df = spark.createDataFrame([(i, p, o) for i, (p, o) in nodes.items()], "id bigint, parent bigint, at int")
    got = graph.preorder(df, ["at"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == depth_first(nodes) and sorted(r.place for r in got) == list(range(1, len(nodes) + 1))


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds, write = 10_000, [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, tag: rounds.append(tag) or write(df, tag))
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert graph.rooted(chain).where("root <> 0").count() == 0 and len(rounds) <= 16
    last = graph.preorder(chain, ["id"]).where("place <> id + 1").count()
    assert last == 0 and rounds.count("steps") <= 17


def test_three_boxed_runs_finish_a_job_and_do_each_piece_once(spark, tmp_path):
    store = pieces.PieceStore(VersionedStore(spark, f"file://{tmp_path}"))
    jobs = lambda key="k1": spark.createDataFrame([("a", key, 5), ("b", "kb", 2)], "job string, key string, pieces int")
    cost = spark.createDataFrame([("a", 10), ("b", 10)], "job string, seconds int")
    done, made = [], []
    for run in (1, 3, 5):
        mine = store.claim(run, jobs(), cost, 25)
        work = [(r.job, r.piece, r.key, f"{r.job}{r.piece}") for r in mine.collect()]
        done += [w[:2] for w in work]
        made = store.finish(run + 1, run, spark.createDataFrame(work, "job string, piece bigint, key string, result string")).collect()
    assert sorted(done) == [("a", k) for k in range(5)] + [("b", k) for k in range(2)] and len(set(done)) == 7
    assert {r.job: r.result for r in made} == {"a": "\n".join(f"a{k}" for k in range(5)), "b": "b0\nb1"}
    assert store.claim(7, jobs(), cost, 25).count() == 0
    # other bytes: the job begins anew; a run that dies leaves its claims to the next, a late result of the old key is not taken
    assert store.claim(8, jobs("k2"), cost, 15).count() == 2
    late = spark.createDataFrame([("a", 0, "k1", "old")], "job string, piece bigint, key string, result string")
    assert [r.job for r in store.finish(9, 8, late).collect()] == ["b"]
    assert [r.piece for r in store.claim(10, jobs("k2"), cost, 15).orderBy("piece").collect()] == [0, 1]
    assert {r.job: (r.done, r.of) for r in pieces.progress(store.pieces()).collect()} == {"a": (0, 5), "b": (2, 2)}
