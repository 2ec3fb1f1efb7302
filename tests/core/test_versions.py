"""State as base and changes: equal to full copies, nothing written without change, compaction, races, and a crash at every write."""

import os
import random

import pytest

from tidemark.sources import versions
from tidemark.sources.versions import Conflict, VersionedStore

ROW = "k string, v bigint, extra map<string,string>"
KEYS = {"t": ("k",), "cursors": ("source_id",)}
CURSOR = "source_id string, current_token string, pending_token string, resume_link string, pending_run bigint"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, {"of": str(v)}) for k, v in rows.items()], ROW)


def content(df):
    return {r.k: r.v for r in df.collect()}


def data_files(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part-"))


def run_with(store, run, rows, **more):
    store.begin(run)
    n = store.replace("t", run, frame(store.spark, rows))
    for table, df in more.items():
        store.replace(table, run, df)
    store.commit(run)
    return n


def test_ten_runs_equal_full_copies(spark, tmp_path):
    store, rng, rows, copies = VersionedStore(spark, f"file://{tmp_path}", KEYS), random.Random(4), {f"k{i}": i for i in range(30)}, {}
    for run in range(1, 11):
        if run > 1 and run != 5:
            for k in rng.sample(sorted(rows), 3):
                rows[k] += 100
            rows.pop(rng.choice(sorted(rows)))
            rows[f"n{run}"] = run
        before = data_files(tmp_path)
        n = run_with(store, run, rows)
        copies[run] = dict(rows)
        if run == 5:
            assert n == 0 and data_files(tmp_path) == before  # no change, no data file
        if run == 7:
            assert store.compact() == ["t"] and store.manifest()["tables"]["t"]["changes"] == []
    fresh = VersionedStore(spark, f"file://{tmp_path}", KEYS)
    assert fresh.published() == 10 and fresh.published(4) == 4
    for run, want in copies.items():
        assert content(fresh.read("t", run)) == want
    for a, b in ((2, 4), (6, 9)):  # the second has the compaction between
        wrote = {r.k: None if r["__gone"] else r.v for r in fresh.changes("t", a, b).collect()}
        assert {k: wrote.get(k, v) for k, v in copies[a].items() if wrote.get(k, v) is not None} | {k: v for k, v in wrote.items() if v is not None} == copies[b]
        assert all(copies[a].get(k) != v for k, v in wrote.items() if v is not None)
    assert {r.k for r in fresh.history("t").collect()} == {k for c in copies.values() for k in c}
    assert fresh.vacuum([9, 10]) and content(fresh.read("t", 9)) == copies[9] and content(fresh.read("t")) == copies[10]
    with pytest.raises(KeyError):
        VersionedStore(spark, f"file://{tmp_path}", KEYS).read("t", 3)


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = (VersionedStore(spark, f"file://{tmp_path}", KEYS) for _ in "ab")
    run_with(a, 1, {"x": 1})
    a.begin(2)
    b.begin(3)
    a.replace("t", 2, frame(spark, {"x": 2}))
    b.replace("t", 3, frame(spark, {"x": 3}))
    b.commit(3)
    with pytest.raises(Conflict):
        a.commit(2)
    with pytest.raises(Conflict):
        b.begin(3)
    assert content(a.read("t")) == {"x": 3} and a.recover() == {2: "discard"}
    assert a.tags.move("curated", 0, {"run": 3}) == 1
    with pytest.raises(Conflict):
        b.tags.move("curated", 0, {"run": 1})
    assert b.tags.get("curated") == (1, {"run": 3})


class Crash(Exception):
    pass


def crashing(monkeypatch, at):
    """Every small file and every data file counts as a write; the one numbered ``at`` is not made, or only begun."""
    count, create, change = [0], versions.SmallFiles.create, VersionedStore.change

    def tick():
        count[0] += 1
        if count[0] == at:
            raise Crash

    def new_create(self, name, text):
        try:
            tick()
        except Crash:
            if at % 2:
                create(self, name, "")  # begun, never finished
            raise
        return create(self, name, text)

    def new_change(self, *a, **k):
        tick()
        out = change(self, *a, **k)
        tick()
        return out

    monkeypatch.setattr(versions.SmallFiles, "create", new_create)
    monkeypatch.setattr(VersionedStore, "change", new_change)
    return count


def test_a_crash_between_any_two_writes_is_adopted_or_discarded(spark, tmp_path, monkeypatch):
    waiting = lambda run, old: spark.createDataFrame([("s", old, f"T{run}", None, run)], CURSOR)
    at, seen = 0, set()
    while True:
        at += 1
        root = f"file://{tmp_path}/{at}"
        store = VersionedStore(spark, root, KEYS)
        run_with(store, 1, {"x": 1, "y": 1}, cursors=waiting(1, None))
        with monkeypatch.context() as patch:
            count = crashing(patch, at)
            try:
                run_with(store, 2, {"x": 2}, cursors=waiting(2, "T1"))
            except Crash:
                pass
            crashed = count[0] == at
        after = VersionedStore(spark, root, KEYS)
        found = after.recover()
        token = {r.source_id: (r.current_token, r.pending_token) for r in after.read("cursors").collect()}
        assert (content(after.read("t")), token) in (({"x": 1, "y": 1}, {"s": ("T1", None)}), ({"x": 2}, {"s": ("T2", None)})), at
        seen |= set(found.values())
        assert after.recover() == {} and not [s for s in after._staged]
        if found.get(2) == "discard" or after.published() == 1:
            run_with(after, 2, {"x": 2}, cursors=waiting(2, "T1"))
        assert content(after.read("t")) == {"x": 2} and {tuple(r)[:3] for r in after.read("cursors").collect()} == {("s", "T2", None)}
        if not crashed:
            break
    assert at > 8 and seen == {"adopt", "discard"}


def test_a_crash_in_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, f"file://{tmp_path}", KEYS)
    for run in (1, 2, 3):
        run_with(store, run, {"x": run, f"y{run}": run})
    assert store.due("t")
    with monkeypatch.context() as patch:
        patch.setattr(versions.Tags, "move", lambda *a: (_ for _ in ()).throw(Crash))
        with pytest.raises(Crash):
            store.compact()
    assert content(store.read("t")) == {"x": 3, "y3": 3}
    left = store.vacuum()
    assert len(left) == 1 and "/base-" in left[0]
    assert store.compact() == ["t"] and not store.due("t") and content(store.read("t")) == {"x": 3, "y3": 3} and content(store.read("t", 1)) == {"x": 1, "y1": 1}


def test_a_rewrite_reaches_every_retained_file(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}", KEYS)
    for run in (1, 2):
        run_with(store, run, {"x": run, "secret": run})
    without = lambda df: df.where("k <> 'secret'") if "k" in df.columns else df
    assert store.rewrite(lambda df: df, lambda t, df: df.where("k = 'secret'").count()) == {"t": 2} and store.generation() == 0
    assert store.rewrite(without, lambda t, df: df.where("k = 'secret'").count()) == {} and store.generation() == 1
    assert content(store.read("t", 1)) == {"x": 1} and content(store.read("t")) == {"x": 2} and store.history("t").where("k = 'secret'").count() == 0
    assert not os.path.exists(f"{tmp_path}/generation=0")
