"""Change detection: the ordered tests by table, then against a plain version over random rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, state
from tidemark.schemas import ITEM, OBSERVATION

BASE = {"source_id": "s", "stable_id": "1", "seq": 0, "rel_path": "a/x", "name": "x", "parent_id": "p", "is_dir": False, "size": 1, "mtime_ns": 10, "ctime_ns": 10, "ino": 1, "mode": 1, "gen_count": 3, "dataless": False, "deleted": False}
ROW = {k: v for k, v in BASE.items() if k not in ("seq", "deleted")} | {"state": "live", "last_verdict": "unchanged", "content_sha256": "c", "first_seen_run": 1, "last_seen_run": 2}
AT = 100


def frames(spark, observed, stored):
    return spark.createDataFrame([tuple(r.get(f.name) for f in OBSERVATION) for r in observed], OBSERVATION), spark.createDataFrame([tuple(r.get(f.name) for f in ITEM) for r in stored], ITEM)


CASES = [
    ({}, {}, "unchanged", "stat-equal"),
    ({"dataless": True, "size": 9}, {}, "dataless", "dataless"),
    ({"quickxor": "a"}, {"quickxor": "a", "size": 9}, "unchanged", "quickxor-equal"),
    ({"quickxor": "a", "sha1": "s"}, {"quickxor": "b", "sha1": "s"}, "maybe_changed", "quickxor-differs"),
    ({"quickxor": "a"}, {}, "unchanged", "stat-equal"),
    ({"sha1": "a", "ctag": "c"}, {"sha1": "a", "ctag": "d"}, "unchanged", "sha1-equal"),
    ({"ctag": "c", "etag": "e"}, {"ctag": "c", "etag": "f"}, "metadata_only", "ctag-equal+etag-moved"),
    ({"etag": "e"}, {"etag": "f"}, "metadata_only", "etag-moved"),
    ({"etag": "e", "size": 2}, {"etag": "f"}, "maybe_changed", "etag-moved+size-or-mtime-differs"),
    ({"etag": "e", "size": 2}, {"etag": "e"}, "maybe_changed", "stat-differs:size"),
    ({"ino": None}, {}, "maybe_changed", "stat-differs:ino"),
    ({"ino": None}, {"ino": None}, "unchanged", "stat-equal"),
    ({"gen_count": 0}, {}, "maybe_changed", "gen-count-unknown"),
    ({"gen_count": None}, {}, "maybe_changed", "gen-count-unknown"),
    ({"gen_count": 2}, {}, "maybe_changed", "gen-count-decreased"),
    ({"gen_count": 4}, {}, "maybe_changed", "gen-count-differs"),
    ({"mtime_ns": 100}, {"mtime_ns": 100}, "maybe_changed", "racily-clean"),
    ({}, {"last_verdict": "created"}, "created", "pending:created"),
    ({}, {"last_verdict": "error"}, "maybe_changed", "pending:error"),
    ({}, {"content_sha256": None}, "maybe_changed", "never-materialised"),
    ({"dataless": True}, {"content_sha256": None}, "dataless", "dataless"),
    ({"rel_path": "b/x"}, {}, "metadata_only", "stat-equal+renamed"),
    ({"is_dir": True}, {"is_dir": True}, "unchanged", "dir"),
    ({"is_dir": True, "parent_id": "q"}, {"is_dir": True}, "metadata_only", "moved"),
    ({"is_dir": True}, {"is_dir": True, "state": "tombstone"}, "metadata_only", "reappeared"),
    ({}, {"state": "tombstone"}, "maybe_changed", "reappeared"),
    ({"deleted": True}, {}, "deleted", "provider-tombstone"),
    ({"deleted": True}, {"state": "tombstone"}, "deleted", "already-tombstoned"),
]


def test_each_rung(spark):
    observed = [BASE | {"stable_id": f"{i:03d}"} | o for i, (o, _, _, _) in enumerate(CASES)]
    stored = [ROW | {"stable_id": f"{i:03d}"} | s for i, (_, s, _, _) in enumerate(CASES)]
    observed += [BASE | {"stable_id": "new"}, BASE | {"stable_id": "gone", "deleted": True}]
    o, s = frames(spark, observed, stored)
    got = {r.stable_id: (r.verdict, r.reason) for r in classify.classify_observed(o, s, AT).collect()}
    for i, (a, b, verdict, reason) in enumerate(CASES):
        assert got[f"{i:03d}"] == (verdict, reason), (a, b)
    assert got["new"] == ("created", "new-id") and got["gone"] == ("deleted", "deleted-unseen")


def test_fast_path_only_skips_what_would_not_be_written(spark):
    rng = random.Random(2)
    observed, stored = [], []
    for i in range(600):
        change = {k: rng.choice([BASE.get(k), v]) for k, v in rng.sample([("size", 2), ("etag", "e"), ("rel_path", "b"), ("gen_count", None), ("dataless", True), ("quickxor", "q"), ("mtime_ns", 200), ("deleted", True)], 2)}
        observed.append(BASE | {"stable_id": str(i)} | change)
        stored.append(ROW | {"stable_id": str(i)} | rng.choice([{}, {"state": "tombstone"}, {"last_verdict": "changed"}, {"content_sha256": None}, {"quickxor": "q"}, {"etag": "e"}]))
    o, s = frames(spark, observed, stored)
    full = {r.stable_id: r for r in classify.classify_observed(o, s, AT).collect()}
    fast = [r.stable_id for r in classify.both_sides(o, s).where(classify.h0_equal(AT)).select(classify.o("stable_id").alias("stable_id")).collect()]
    assert fast and all(full[i].verdict == "unchanged" and full[i].prev_path is None for i in fast)


def test_last_record_wins_and_safe_saves(spark):
    o, s = frames(
        spark,
        [BASE | {"stable_id": "n1", "rel_path": "p1"}, BASE | {"stable_id": "n2", "rel_path": "p2"}, BASE | {"stable_id": "n3", "rel_path": "p3"}, BASE | {"stable_id": "n3b", "rel_path": "p3"}, BASE | {"stable_id": "n4", "rel_path": "p4"}, BASE | {"stable_id": "d", "seq": 1, "size": 5}, BASE | {"stable_id": "d", "seq": 2, "size": 1}],
        [ROW | {"stable_id": "o1", "rel_path": "p1"}, ROW | {"stable_id": "o2", "rel_path": "p2", "last_seen_run": 5}, ROW | {"stable_id": "o2b", "rel_path": "p2", "last_seen_run": 4}, ROW | {"stable_id": "o3", "rel_path": "p3"}, ROW | {"stable_id": "o4", "rel_path": "p4"}, ROW | {"stable_id": "o4b", "rel_path": "p4"}, ROW | {"stable_id": "d"}],
    )
    verdicts, gone, breaker = classify.classify_pass(o, s, AT, True, True, "0.20", 25)
    got = {r.stable_id: (r.verdict, r.reason, r.replaces_id) for r in verdicts.collect()}
    assert got["n1"] == ("maybe_changed", "safe-save", "o1") and got["n2"] == ("maybe_changed", "safe-save", "o2")
    assert got["n3"][0] == got["n3b"][0] == got["n4"][0] == "created" and got["d"][1] == "h0-equal"
    assert {r.stable_id for r in gone.collect()} == {"o2b", "o3", "o4", "o4b"}
    assert not breaker.first().tripped
    assert classify.classify_pass(o, s, AT, True, False)[1].count() == 0
    assert classify.classify_pass(o, s, AT, False, True)[0].where("verdict = 'maybe_changed'").count() == 0


@pytest.mark.parametrize(("candidates", "live", "trips"), [(29, 100, False), (30, 100, True), (25, 3, False), (26, 3, True)])
def test_breaker_is_exact(spark, candidates, live, trips):
    row = spark.range(1).select(classify.breaker_trips(F.lit(candidates), F.lit(live), "0.29", 25).alias("t")).first()
    assert row.t is trips


def test_upsert_keeps_what_it_must(spark):
    o, s = frames(
        spark,
        [BASE | {"stable_id": "1", "dataless": True, "size": 99, "name": "y"}, BASE | {"stable_id": "2", "deleted": True, "size": 99}, BASE | {"stable_id": "3"}, BASE | {"stable_id": "4", "rel_path": "z"}, BASE | {"stable_id": "5"}, BASE | {"stable_id": "6", "deleted": True}],
        [ROW | {"stable_id": "1"}, ROW | {"stable_id": "2"}, ROW | {"stable_id": "3", "state": "tombstone"}, ROW | {"stable_id": "4", "state": "quarantined", "state_reason": "why"}, ROW | {"stable_id": "9"}],
    )
    v = classify.classify_observed(o, s, AT)
    got = {r.stable_id: r for r in state.upsert(s, o, v, 7).collect()}
    assert (got["1"].size, got["1"].name, got["1"].state) == (1, "y", "dataless")
    assert (got["2"].size, got["2"].state, got["2"].last_verdict) == (1, "tombstone", "deleted")
    assert got["3"].state == "live" and got["3"].content_sha256 is None
    assert (got["4"].prev_path, got["4"].rel_path, got["4"].state_reason) == ("a/x", "z", "why")
    assert got["5"].first_seen_run == 7 and "6" not in got and got["9"].last_seen_run == 2


def test_confirmation_and_outputs(spark):
    _, s = frames(spark, [], [ROW | {"stable_id": "1"}, ROW | {"stable_id": "2", "absent_since_run": 3}])
    marked = state.mark_absent(s, s, 4)
    assert {r.stable_id: r.absent_since_run for r in marked.collect()} == {"1": 4, "2": 3}
    assert [r.stable_id for r in state.confirmed_absent(marked, s, 4, F.lit(True)).collect()] == ["2"]
    assert state.mark_absent(marked, s.limit(0), 5).where("absent_since_run is not null").count() == 0
    out = spark.createDataFrame([("s", "1", u, u) for u in "abc"] + [("s", "2", "a", "a")], "source_id string, stable_id string, unit_id string, h string")
    new = spark.createDataFrame([("s", "1", "a", "z")], out.schema)
    kept, vanished = state.replace_outputs(out, new)
    assert sorted((r.stable_id, r.unit_id, r.h) for r in kept.collect()) == [("1", "a", "z"), ("2", "a", "a")]
    assert sorted(r.unit_id for r in vanished.collect()) == ["b", "c"]


def test_every_combination_has_a_verdict(spark):
    values = list(itertools.product([None, "a", "b"], repeat=2))
    observed = [BASE | {"stable_id": f"{i}-{j}", "etag": x[0], "ctag": y[0]} for i, x in enumerate(values) for j, y in enumerate(values)]
    stored = [ROW | {"stable_id": f"{i}-{j}", "etag": x[1], "ctag": y[1]} for i, x in enumerate(values) for j, y in enumerate(values)]
    o, s = frames(spark, observed, stored)
    assert classify.classify_observed(o, s, AT).where("verdict is null or reason is null").count() == 0
