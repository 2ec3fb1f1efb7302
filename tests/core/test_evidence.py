"""Citation chains, screens and masks, and trees with refused folders, against plain versions."""

import random

import numpy as np
import pytest

from tidemark.operators import classify, evidence, screens
from tidemark.sources import trees

CITE = "id bigint, page string, recording int, second bigint, channel string, quote string"


def test_each_miss_of_a_citation_has_its_reason(spark):
    cites = [
        (1, "p", 1, 10, "heard", "hello"),
        (2, "p", 9, 10, "heard", "hello"),
        (3, "p", None, 10, "heard", "from notes"),
        (4, "q", None, 10, "heard", "only here"),
        (5, "q", None, 10, "seen", "only here"),
        (6, "p", 1, 400, "seen", "x"),
        (7, "p", 1, 15, "seen", "hello"),
        (8, "p", 1, 15, "heard", "hello"),
        (9, "p", 1, 10, "heard", "later"),
        (10, "p", 1, 10, "heard", "nowhere"),
        (11, "p", 1, 10, "heard", "--"),
        (12, "p", 1, 10, "heard", None),
        (13, "p", 1, 299, "heard", "across"),
        (14, "p", 1, 14, "heard", "twice"),
        (15, "p", 1, 10, "heard", "he ... world"),
    ]
    lines = [("p", 1, 1, 10, "heard", "hello world"), ("p", 1, 1, 18, "heard", "later"), ("p", 1, 1, 12, "heard", "twice"), ("p", 1, 1, 16, "heard", "twice"), ("p", 1, 2, 301, "heard", "across"), ("p", 1, 1, 299, "heard", "end")]
    transcript = [("p", 10, "from notes"), ("q", 10, "only here")]
    got = evidence.citation_chain(
        spark.createDataFrame(cites, CITE),
        spark.createDataFrame([("p", 1)], "page string, recording int"),
        spark.createDataFrame([("p", 1, 1)], "page string, recording int, window bigint"),
        spark.createDataFrame(lines, "page string, recording int, window bigint, second bigint, channel string, text string"),
        spark.createDataFrame(transcript, "page string, second bigint, text string"),
    )
    assert {r.id: (r.outcome, r.via, r.hint) for r in got.collect()} == {
        1: ("resolved", "window", None),
        2: ("no-recording", None, None),
        3: ("resolved", "transcript", None),
        4: ("resolved", "transcript", None),
        5: ("no-recording", None, None),
        6: ("no-window", None, None),
        7: ("no-line", None, None),
        8: ("no-line", None, 10),
        9: ("quote-elsewhere", "window", 18),
        10: ("quote-absent", "window", None),
        11: ("no-words", "window", None),
        12: ("resolved", "window", None),
        13: ("quote-elsewhere", "window", 301),
        14: ("no-line", None, 12),
        15: ("resolved", "window", None),
    }


def test_chains_of_empty_tables(spark):
    none = spark.createDataFrame([], "page string, recording int, window bigint, second bigint, channel string, text string")
    got = evidence.citation_chain(spark.createDataFrame([(1, "p", None, 3, "heard", "x")], CITE), none, none, none, none)
    assert [tuple(r) for r in got.collect()] == [(1, "no-window", None, None)]


def test_frames_by_state_and_moment(spark):
    cites = spark.createDataFrame([(1, "p", 1, 50), (2, "p", 1, 60), (3, "p", 1, 310), (4, "p", 1, 700), (5, "p", 1, 299), (6, "p", 1, 5)], "id bigint, page string, recording int, second bigint")
    states = spark.createDataFrame([("p", 1, 1, 1, 10, 60), ("p", 1, 1, 2, 60, 250), ("p", 1, 2, 2, 300, 400)], "page string, recording int, window bigint, state int, start_s bigint, end_s bigint")
    frames = spark.createDataFrame([("p", 1, 1, 52, "a"), ("p", 1, 2, 60, "b"), ("p", 1, 2, 200, "c"), ("p", 1, 2, 320, "d")], "page string, recording int, state int, second bigint, frame string")
    got = evidence.frame_chain(cites, states, states, frames, spark.createDataFrame([("p", "b"), ("z", "c")], "page string, frame string"))
    assert {r.id: (r.outcome, r.state, r.frame) for r in got.collect()} == {
        1: ("no-frame", 1, None),
        2: ("ok", 2, "b"),
        3: ("not-opened", 2, "c"),
        4: ("no-window", None, None),
        5: ("no-state", None, None),
        6: ("no-state", None, None),
    }


def test_rows_carried_over(spark):
    rng = random.Random(5)
    rows, states = [], []
    for g in range(6):
        cuts = sorted(rng.sample(range(0, 400), 6))
        states += [(g, k, a, b - rng.choice([0, 0, 3])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        for _ in range(40):
            a = rng.randrange(0, 400)
            rows.append((g, a, None if rng.random() < 0.1 else a + rng.choice([0, 1, 20, 150])))
    rows += [(0, states[1][2], states[1][2])]
    want = {}
    for g, k, start, _ in states:
        before = next((s for s in states if s[0] == g and s[1] == k - 1), None)
        held = [] if before is None else [(a, b if b is not None else 10**9) for h, a, b in rows if h == g and a < start and a < before[3] and (b is None or b > before[2])]
        want[g, k] = (None if before is None else k - 1, sum(before[3] <= b <= start for a, b in held), sum(b > start for a, b in held))
    got = screens.carried_over(spark.createDataFrame(states, "g int, state int, start_ms bigint, end_ms bigint"), spark.createDataFrame(rows, "g int, start_ms bigint, end_ms bigint"), ["g"], 50)
    assert {(r.g, r.state): (r.previous, r.gone, r.stayed) for r in got.collect()} == want


def test_row_diffs_are_of_multisets(spark):
    rows = [("a", 0, 5), ("a", 0, 5), ("a", 5, None), ("b", 5, 9), ("c", 2, 5)]
    got = screens.row_diffs(spark.createDataFrame([(1, *r) for r in rows], "g int, text string, start_ms bigint, end_ms bigint"), ["g"])
    assert sorted((r.at_ms, r.text, r.op, r.n) for r in got.collect()) == [(0, "a", "+", 2), (2, "c", "+", 1), (5, "a", "-", 1), (5, "b", "+", 1), (5, "c", "-", 1), (9, "b", "-", 1)]


def plain_regions(odd, reach):
    todo, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(odd), strict=True)}, []
    while todo:
        one, stack = [], [min(todo)]
        todo.discard(stack[0])
        while stack:
            y, x = stack.pop()
            one.append((y, x))
            near = [(y + a, x + b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (y + a, x + b) in todo]
            todo -= set(near)
            stack += near
        ys, xs = zip(*one, strict=True)
        out.append((len(one), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return out


@pytest.mark.parametrize("share,reach", [(0.02, 1), (0.3, 1), (0.1, 2), (1.0, 1), (0.0, 1)])
def test_regions_are_those_of_a_flood(share, reach):
    odd = np.random.default_rng(7).random((19, 23)) < share
    assert [tuple(r.values()) for r in screens.regions(odd, reach)] == plain_regions(odd, reach)


def test_a_winding_region_is_one():
    odd = np.zeros((41, 41), bool)
    odd[::2] = True
    odd[1::4, -1] = odd[3::4, 0] = True
    assert screens.regions(odd) == [{"cells": int(odd.sum()), "x0": 0, "y0": 0, "x1": 41, "y1": 41}]


def test_masked_changes_on_random_grids(spark):
    rng, w, h = np.random.default_rng(3), 16, 9
    share = {1: ([], [(0.1, 0.0, 0.3, 0.5)]), 2: ([(0.2, 0.2, 0.9, 0.95)], [(0.5, 0.5, 0.55, 0.6), (0.0, 0.9, 1.0, 1.2)]), 3: ([], [])}
    names = ("x0", "y0", "x1", "y1")
    masks = spark.createDataFrame([(k, *[[dict(zip(names, r, strict=True)) for r in x] or None for x in v]) for k, v in share.items()], f"layout int, include {screens.RECTS}, exclude {screens.RECTS}")
    frames = [(g, t, int(rng.integers(1, 5)), bytearray(rng.integers(0, 60, w * h, dtype=np.uint8).tobytes())) for g in range(4) for t in range(6)]
    frames.append((4, 0, 3, bytearray(b"short")))
    frames.append((4, 1, 3, bytearray(w * h)))
    got = screens.masked_changes(spark.createDataFrame(frames, "g int, tick int, layout int, grid binary"), masks, ["g"], w, h, least=20, grow=1).collect()
    want = {}
    for (g, _, _, a), (g2, t, layout, b) in zip(frames, frames[1:], strict=False):
        if g != g2:
            continue
        include, exclude = share.get(layout, ([], []))
        odd = np.zeros((h, w), bool)
        for y in range(h):
            for x in range(w):
                touch = lambda r, m=0, x=x, y=y: np.floor(r[0] * w) - m <= x < np.ceil(r[2] * w) + m and np.floor(r[1] * h) - m <= y < np.ceil(r[3] * h) + m
                counts = (not include or any(map(touch, include))) and not any(touch(r, 1) for r in exclude)
                odd[y, x] = counts and (len(a) != w * h or abs(a[y * w + x] - b[y * w + x]) >= 20)
        want[g, t] = (int(odd.sum()), plain_regions(odd, 1))
    assert {(r.g, r.tick): (r.changed, [tuple(x) for x in r.regions]) for r in got} == want


FS = {"/r": ["a/", "b/", "f"], "/r/a": ["x/", "g"], "/r/a/x": ["h"], "/r/b": None, "/r/c": ["never"]} | {f"/r/a/x{'/d' * k}": ["d/", "z"] for k in range(1, 40)}


def entries(path):
    if path.endswith("/d" * 40):
        raise FileNotFoundError(path)
    if path == "/r/b":
        raise PermissionError(path)
    inside = FS[path] + (["d/"] if path == "/r/a/x" else [])
    return [(n.rstrip("/"), "folder" if n.endswith("/") else "file", 1, 2) for n in inside]


@pytest.mark.parametrize("budget", [1, 7, 1000])
def test_a_walk_with_refusals_equals_a_plain_one(spark, budget):
    if budget == 1:
        budget = 3  # forty folders one below another take as many rounds as one task needs turns
    want, todo = {}, ["/r"]
    while todo:
        path = todo.pop()
        try:
            inside = entries(path)
        except PermissionError:
            want[path] = ("folder", "refused")
            continue
        except FileNotFoundError:
            want[path] = ("folder", "gone")
            continue
        want[path] = ("folder", "listed")
        for name, kind, _, _ in inside:
            if kind == "folder":
                todo.append(f"{path}/{name}")
            else:
                want[f"{path}/{name}"] = (kind, "listed")
    rows = trees.walk_tree(spark.createDataFrame([("/r",)], "path string"), entries, budget, 3).collect()
    assert {r.path: (r.kind, r.status) for r in rows} == want and len(rows) == len(want)


def test_a_walk_of_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f.txt").write_text("four")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    rows = trees.walk_tree(spark.createDataFrame([(str(tmp_path),), (f"{tmp_path}/lost",)], "path string")).collect()
    assert {r.path.removeprefix(str(tmp_path)): (r.kind, r.status) for r in rows} == {
        "": ("folder", "listed"), "/lost": ("folder", "gone"), "/a": ("folder", "listed"), "/a/b": ("folder", "listed"), "/a/b/f.txt": ("file", "listed"), "/a/up": ("link", "listed")
    }
    assert [r.size for r in rows if r.kind == "file"] == [4]


def test_nothing_under_an_unknown_folder_is_missing(spark):
    keys = "source_id string, stable_id string"
    stored = spark.createDataFrame([("s", "1", "f"), ("s", "2", "b/g"), ("s", "3", "b/c/h"), ("s", "4", "bc/i"), ("s", "5", "b/j"), ("t", "1", "b/g"), ("u", "1", "k"), ("u", "2", "a/l")], f"{keys}, rel_path string")
    listed = spark.createDataFrame([("s", "5")], keys)
    answers = spark.createDataFrame([("s", "b", "refused"), ("s", "b/c", "unread"), ("s", "", "listed"), ("t", "b", "gone"), ("u", "", "unread")], "source_id string, path string, status string")
    got = classify.absent_or_unknown(stored, listed, answers).collect()
    assert {(r.source_id, r.stable_id): (r.verdict, r.folder) for r in got} == {
        ("s", "1"): ("missing", None), ("s", "2"): ("unknown", "b"), ("s", "3"): ("unknown", "b/c"), ("s", "4"): ("missing", None), ("t", "1"): ("missing", None), ("u", "1"): ("unknown", ""), ("u", "2"): ("unknown", "")
    }


def test_quotes_in_moments_of_many_texts(spark, monkeypatch):
    from tidemark.functions.columns import quote_held

    rng = random.Random(5)
    words = ["alpha", "alphabet", "beta", "béta", "gam_ma", "x1", "- -", "…", "a...b"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [("p", 1, rng.choice([1, 1, 2]), rng.randrange(30), rng.choice(["heard", "seen"]), said(4) if rng.random() < 0.9 else None) for _ in range(60)]
    cites = [(k, "p", 1, rng.randrange(30), rng.choice(["heard", "seen"]), rng.choice(["pha", "alpha", "beta alpha", "beta...x1", "- -", "...", "éta", "zeta", None, "gam_ma x1"])) for k in range(200)]
    spoken = [("p", rng.randrange(30), said(2)) for _ in range(10)]
    frames = [
        spark.createDataFrame(cites, CITE), spark.createDataFrame([("p", 1)], "page string, recording int"), spark.createDataFrame([("p", 1, 1)], "page string, recording int, window bigint"),
        spark.createDataFrame(lines, "page string, recording int, window bigint, second bigint, channel string, text string"), spark.createDataFrame(spoken, "page string, second bigint, text string"),
    ]
    pairs = frames[0].join(spark.createDataFrame([(t,) for t in {x[-1] for x in lines + spoken if x[-1]}], "text string").hint("broadcast")).where(quote_held("text", "quote"))
    holds = {(r.quote, r.text) for r in pairs.select("quote", "text").distinct().collect()}
    want = {}
    for i, _, _, second, channel, quote in cites:
        near = [(s, w == 1, "window", (quote, t) in holds) for _, _, w, s, c, t in lines if c == channel] + [(s, True, "transcript", (quote, t) in holds) for _, s, t in spoken if channel == "heard"]
        here = [x for x in near if x[0] == second and x[1]]
        hint = min(((abs(s - second), s) for s, _, _, held in near if held and 0 < abs(s - second) <= 10), default=(0, None))[1]
        plain = quote is not None and any(ch.isalnum() for ch in quote)
        outcome = "no-line" if not here else "resolved" if quote is None else "no-words" if not plain else "resolved" if any(x[3] for x in here) else "quote-elsewhere" if hint is not None else "quote-absent"
        via = max((x[2] for x in here if x[3]), default=max((x[2] for x in here), default=None))
        want[i] = (outcome, via, hint if plain and outcome in ("no-line", "quote-elsewhere") else None)
    monkeypatch.setattr(evidence, "SLICE_BYTES", 20)
    got = evidence.citation_chain(*frames)
    assert {r.id: (r.outcome, r.via, r.hint) for r in got.collect()} == want and "MapInArrow" in got._jdf.queryExecution().toString()
