"""Intervals, sessions and layouts against plain folds."""

import random

from pyspark.sql import functions as F

from tidemark.operators import aggregates, graph, intervals, layout


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_said_lines_at_the_edges(spark):
    w = [("r", 0, 900, "a", 1), ("r", 1899, 2000, "b", 1), ("r", 3000, 3100, "c", 1), ("r", 3200, 3300, "d", 2), ("r", 3400, 8399, "e.", 2), ("r", 8400, 8401, "f.", 2), ("r", 8402, 8403, "g", 2), ("q", 0, 100, "x", 1), ("q", 500, 30_000, "y", 1), ("q", 30_001, 30_002, "z", 1)]
    got = [(r.rec, r.voice, r.start_ms, r.end_ms, r.text) for r in intervals.said_lines(frame(spark, w, "rec string, start_ms bigint, end_ms bigint, text string, voice bigint"), "rec").orderBy("rec", "start_ms").collect()]
    assert got == [("q", 1, 0, 30_000, "x y"), ("q", 1, 30_001, 30_002, "z"), ("r", 1, 0, 2000, "a b"), ("r", 1, 3000, 3100, "c"), ("r", 2, 3200, 8399, "d e."), ("r", 2, 8400, 8403, "f. g")]


def test_said_lines_match_a_plain_pass(spark):
    rng, words = random.Random(12), []
    for rec in ("a", "b"):
        t = 0
        for k in range(400):
            t += rng.choice([0, 0, 300, 950, 1100, 2500])
            words.append((rec, t, t + rng.choice([0, 200, 1400, 6000]), rng.choice(["yes", "no.", " so? ", "two  words", "end.\u00a0"]) + rng.choice(["", str(k)]), rng.choice([1, 1, 1, 2])))
    want = []
    for rec in ("a", "b"):
        lines = []
        for _, a, b, text, voice in sorted(w for w in words if w[0] == rec):
            now = lines[-1] if lines else None
            if not now or now["voice"] != voice or now["shut"] or a - now["last"] >= intervals.PAUSE_MS or b - now["first"] > intervals.LONGEST_MS:
                now = {"voice": voice, "first": a, "last": b, "said": [], "shut": False}
                lines.append(now)
            now["last"], now["said"] = max(now["last"], b), [*now["said"], text]
            now["shut"] = text.rstrip()[-1] in ".?!" and b - now["first"] >= intervals.SENTENCE_MS
        want += [(rec, x["voice"], x["first"], x["last"], " ".join(" ".join(x["said"]).split())) for x in lines]
    got = intervals.said_lines(frame(spark, words, "rec string, start_ms bigint, end_ms bigint, text string, voice bigint"), "rec").collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], r[1], r[2], r[3], r[4]) for r in want)


def test_merge_overlap_and_cover(spark):
    rng = random.Random(5)
    spans = [(g, i, a := rng.randint(0, 400), a + rng.choice([0, 1, 5, 30, 90])) for g in "ab" for i in range(60)]
    df = frame(spark, spans, "g string, id bigint, start_ms bigint, end_ms bigint")
    for g in "ab":
        want = []
        for a, b in sorted((s[2], s[3]) for s in spans if s[0] == g):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        got = sorted((r.start_ms, r.end_ms) for r in intervals.merged(df, ["g"]).where(F.col("g") == g).collect())
        assert got == [tuple(x) for x in want]
    pairs = {(r.left_id, r.right_id, r.overlap_ms) for r in intervals.overlaps(df.where("g = 'a'").drop("g").withColumn("k", F.lit(1)), df.where("g = 'b'").drop("g").withColumn("k", F.lit(1)), ["k"], 25).collect()}
    assert pairs == {(s[1], t[1], min(s[3], t[3]) - max(s[2], t[2])) for s in spans for t in spans if s[0] == "a" and t[0] == "b" and min(s[3], t[3]) > max(s[2], t[2])}
    points = [("a", k, k * 7) for k in range(70)]
    owners = df.where("g = 'a'").select("g", (F.col("id") % 3).alias("owner"), "start_ms", "end_ms")
    got = {(r.id, r.owner) for r in intervals.covering(frame(spark, points, "g string, id bigint, at_ms bigint"), owners, ["g"], 25).collect()}
    hold = lambda t: {s[1] % 3 for s in spans if s[0] == "a" and s[2] <= t < s[3]}
    assert got == {(k, min(hold(t))) for _, k, t in points if len(hold(t)) == 1}


def test_nearest_segment(spark):
    rng = random.Random(8)
    segs = [("r", a := rng.randint(0, 300), a + rng.choice([0, 3, 10, 80]), rng.choice("xyz")) for _ in range(40)]
    words = [("r", i, a := rng.randint(-20, 400), a + rng.randint(0, 9)) for i in range(200)]
    got = {r.id: r.speaker for r in intervals.nearest_segment(frame(spark, words, "rec string, id bigint, start_ms bigint, end_ms bigint"), frame(spark, segs, "rec string, start_ms bigint, end_ms bigint, speaker string"), ["rec"]).collect()}
    for _, i, a, b in words:
        m = a + b
        assert got[i] == min(segs, key=lambda s: (max(2 * s[1] - m, m - 2 * s[2], 0), s[1], s[2], s[3]))[3]


def test_turns_match_a_fold(spark):
    rng = random.Random(3)
    cues, t = [], 0
    for n in range(300):
        t += rng.choice([0, 100, 900, 1500])
        cues.append(("p", n, t, t + rng.choice([50, 400, 3000]), rng.choice(["A", "A", "B", ""]), f"w{n}"))
    want = []
    for _, n, a, b, who, said in sorted(cues, key=lambda c: (c[2], c[1])):
        if want and who and want[-1][0] == who and a - want[-1][2] < 1000:
            want[-1][2], want[-1][3] = max(want[-1][2], b), want[-1][3] + " " + said
        else:
            want.append([who, a, b, said])
    got = [[r.speaker, r.start_ms, r.end_ms, r.text] for r in intervals.turns(frame(spark, cues, "path string, seq bigint, start_ms bigint, end_ms bigint, speaker string, text string"), ["path"]).collect()]
    assert sorted(got) == sorted(want)


def test_states_fold_short_ones(spark):
    reads = [("r", 0, "share", ["aaaa"], 60_000), ("r", 5, "share", ["bbbb"], 60_000), ("r", 6, "share", ["aaaa"], 60_000), ("r", 10, "camera", ["x"], 60_000), ("r", 11, "share", ["cccc"], 60_000), ("r", 20, "share", ["cccc"], 60_000)]
    got = [(r.start_ms, r.end_ms) for r in intervals.screen_states(frame(spark, reads, "rec string, tick bigint, kind string, rows array<string>, end_ms bigint"), "rec").orderBy("state").collect()]
    assert got == [(0, 20_000), (20_000, 60_000)]  # one odd read is no state; the short camera state joins the next


def test_silence_holes_and_voices(spark):
    import numpy as np

    loud, quiet = np.full(16_000, 1000, "<i2"), np.zeros(16_000, "<i2")
    pcm = frame(spark, [("r", bytearray(np.concatenate([loud, quiet, loud]).tobytes()))], "recording string, pcm binary")
    assert [(r.start_ms, r.end_ms) for r in intervals.silent_runs(intervals.pcm_frames(pcm), ["recording"]).collect()] == [(1000, 2000)]
    words = frame(spark, [("r", 0, 1000, "a"), ("r", 9000, 9500, "b"), ("r", 17_499, 18_000, "c")], "rec string, start_ms bigint, end_ms bigint, text string")
    segs = frame(spark, [("r", 1000, 5000, "s"), ("r", 9500, 17_000, "s")], "rec string, start_ms bigint, end_ms bigint, speaker string")
    assert [(r.start_ms, r.end_ms, r.clip_start, r.clip_end) for r in intervals.holes(words, segs, ["rec"]).collect()] == [(1000, 9000, 0, 14_000)]
    counts = aggregates.contingency(frame(spark, [("A", 1)] * 8 + [("A", 2)] * 2 + [("B", 2)] * 2 + [("C", 3)], "label string, voice bigint"))
    assert {r.voice: r.form for r in intervals.named_voices(counts).collect()} == {1: "named", 2: "mixed", 3: "unidentified"}


def test_reading_order_columns_and_tables(spark):
    prose = [("p", f"left column line number {k}", 0.9, 0.05, 0.1 + k * 0.05, 0.35, 0.04) for k in range(4)] + [("p", f"right column line number {k}", 0.9, 0.55, 0.1 + k * 0.05, 0.35, 0.04) for k in range(4)]
    cells = [("t", f"{c}{k}", 0.9, 0.1 + 0.5 * j, 0.1 + k * 0.05, 0.1, 0.04) for k in range(3) for j, c in enumerate("ab")] + [("t", "x", 0.1, 0.9, 0.9, 0.01, 0.01)]
    got = layout.reading_order(frame(spark, prose + cells, "page string, text string, confidence double, x double, y double, w double, h double"), "page").orderBy("page", "place").collect()
    assert [r.text for r in got if r.page == "p" and r.text] == [f"{s} column line number {k}" for s in ("left", "right") for k in range(4)]
    assert [r.text for r in got if r.page == "t" and r.text] == ["a0 b0", "a1 b1", "a2 b2"]


def test_rows_are_followed(spark):
    rows = [("r", 0, 0, "Total 12", 10.0, 8.0), ("r", 0, 1, "Other line", 30.0, 8.0), ("r", 1, 0, "Totals 12", 11.0, 8.0), ("r", 1, 1, "Fresh", 50.0, 8.0), ("r", 2, 0, "Fresh", 200.0, 8.0), ("r", 2, 1, "Total 13", 11.0, 8.0)]
    got = {(r.frame, r.row): r.track for r in layout.row_tracks(frame(spark, rows, "rec string, frame bigint, row bigint, text string, y double, h double"), "rec").collect()}
    assert got[0, 0] == got[1, 0] and got[1, 1] == got[2, 0] and len(set(got.values())) == 4


def test_trees_with_cycles_and_orphans(spark):
    tree = frame(spark, [("s", "r", None, "root"), ("s", "a", "r", "A"), ("s", "b", "a", "B"), ("s", "c", "d", "C"), ("s", "d", "c", "D"), ("s", "o", "gone", "O"), ("s", "x", None, "X")], "source_id string, stable_id string, parent_id string, name string")
    root = frame(spark, [("s", "r")], "source_id string, stable_id string")
    assert {r.stable_id: r.rel_path for r in graph.derive_paths(tree, root).collect()} == {"a": "A", "b": "A/B"}
    assert {r.stable_id for r in graph.descendants(tree, frame(spark, [("s", "c")], "source_id string, stable_id string")).collect()} == {"c", "d"}
    assert {r.stable_id: r.scope for r in graph.scope_of(tree, root).collect()} == {"r": "inside", "a": "inside", "b": "inside", "c": "unknown", "d": "unknown", "o": "unknown", "x": "outside"}
    commits = frame(spark, [("c3", "c2"), ("c3", "m"), ("c2", "c1"), ("m", "c1"), ("c1", None), ("z", "c1")], "commit string, parent string")
    assert {r.commit for r in graph.ancestor_closure(commits, frame(spark, [("c2",)], "commit string")).collect()} == {"c1", "c2"}
    history = frame(spark, [("s", "1", "p"), ("s", "2", "p"), ("s", "2", "q"), ("s", "3", "q"), ("s", "4", "z"), ("t", "5", "p")], "source_id string, stable_id string, path string")
    ids = graph.erasure_fixpoint(history, frame(spark, [("s", "1")], "source_id string, stable_id string"))
    assert {tuple(r) for r in ids.collect()} == {("s", "1"), ("s", "2"), ("s", "3")}  # a path of another source doesn't spread


def test_rows_stream_from_frame_to_frame(spark):
    rows = [("r", k, 0, f"line {k // 50}" if k % 7 else None, 10.0, 8.0) for k in range(200)] + [("s", 0, 0, None, None, 8.0), ("s", 1, 0, "", None, 8.0)]
    tracks = layout.row_tracks(frame(spark, rows, "rec string, frame bigint, row bigint, text string, y double, h double"), "rec")
    got = {(r.rec, r.frame): r.track for r in tracks.collect()}
    want, last = {}, None
    for k in range(200):
        text = f"line {k // 50}" if k % 7 else ""
        want["r", k] = k if last is None else want["r", k - 1] if text == last else max(want.values()) + 1
        last = text
    assert got == want | {("s", 0): 0, ("s", 1): 1} and "MapInArrow" in tracks._jdf.queryExecution().toString()


def test_pages_stream_and_a_line_without_text_is_none(spark):
    boxes = [(p, f"word {k}" if k else None, 0.9, 0.1, 0.1 + k * 0.05, 0.2, 0.04) for p in range(50) for k in range(3)]
    pages = layout.reading_order(frame(spark, boxes, "page bigint, text string, confidence double, x double, y double, w double, h double"), "page")
    assert sorted(tuple(r) for r in pages.collect()) == [(p, k, f"word {k + 1}") for p in range(50) for k in range(2)] and "MapInArrow" in pages._jdf.queryExecution().toString()


def test_segments_at_once_count_together_or_each(spark):
    words = frame(spark, [("r", 0, 1000, "a"), ("r", 9000, 9500, "b")], "rec string, start_ms bigint, end_ms bigint, text string")
    segs = frame(spark, [("r", 1000, 3500, "s"), ("r", 1000, 3500, "t")], "rec string, start_ms bigint, end_ms bigint, speaker string")
    assert intervals.holes(words, segs, ["rec"]).count() == 0 and intervals.holes(words, segs, ["rec"], each=True).count() == 1


def test_vetoes_by_blocks_of_ticks_and_by_each_tick(spark):
    import random

    rng = random.Random(3)
    lit = [(rng.randrange(6000), rng.choice("ABC")) for _ in range(4000)]
    lines = [(i, i % 3, a := rng.randrange(-50, 9_000_000), a + rng.choice([-5, 0, 1, 1999, 2000, 60_000, 2_400_000, 40_000_000])) for i in range(400)]
    names = [(0, "A", "named"), (1, "B", "named"), (2, "C", "mixed")]
    at = {t: {x for u, x in lit if u == t} for t, _ in lit}
    at = {t: min(x) for t, x in at.items() if len(x) == 1}
    want = set()
    for i, voice, a, b in lines:
        seen = [at[t] for t in range(-(-a // 2000), -(-b // 2000)) if t in at]
        if voice < 2 and seen and min(set(seen), key=lambda x: (-seen.count(x), x)) != "AB"[voice]:
            want.add(i)
    got = intervals.vetoed(frame(spark, lines, "id bigint, voice bigint, start_ms bigint, end_ms bigint"), frame(spark, lit, "tick bigint, label string"), frame(spark, names, "voice bigint, label string, form string"))
    made = [x for x in got._jdf.queryExecution().toString().splitlines() if "Generate" in x]
    assert {r.id for r in got.collect()} == want and want and not any("explode(sequence" in x for x in made)


def test_budgets_stream_past_each_row(spark):
    rows = [("s", k, None if k == 3 else [5, 9, 2, 0, 7, 1][k % 6]) for k in range(60)] + [(None, 1, 4)]
    got = aggregates.greedy_budget(frame(spark, rows, "source string, id int, n bigint"), ["source"], ["id"], "n", 20, 6)
    want, used, files = {(None, 1): True}, 0, 0
    for s, k, n in rows[:-1]:
        want[s, k] = n is not None and used + n <= 20 and files < 6
        used, files = used + n * want[s, k] if n else used, files + want[s, k]
    assert {(r.source, r.id): r.taken for r in got.collect()} == want and "MapInArrow" in got._jdf.queryExecution().toString()
