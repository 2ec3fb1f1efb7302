"""Repaired conversations against a search that carries whole audit strings."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import conversation_repair

ROWS = "conv_id bigint, turn bigint, role string, text string"


def blank(text):
    return not re.sub("[ \t-\r]", "", text)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        pick, role, text = zlib.crc32(key.encode()) % 20, role if role is not None else " ", text if text is not None else " "
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(pick, text)
        out += [(conv, turn, "user" if pick == 4 else role, text)] * {0: 0, 3: 2}.get(pick, 1)
    return out


def order(row):
    _, turn, role, text = row
    import base64

    digest = hashlib.sha256(f"{base64.b64encode(role.encode()).decode()}\n{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, role, digest)


def after(state, role):
    """The pattern as an automaton: start, after a system turn, after a user, after an assistant."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role))


def plain(rows):
    """The least (cost, letters) and its text for the rows of one conversation, in order; and the faults."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        fault = "b" if blank(text) else "d" if (role, text) in seen else "t" if re.sub("[ \t-\r]+\\Z", "", text)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    known = {"": (0, "", [])}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, letters, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    to = after(state, role[0])
                    new = (cost + 2, letters + "I", [*lines, f"{role}:"])
                    if to and (to not in states or new[:2] < states[to][:2]):
                        states[to] = new
        return states

    # paths of one state are kept by (cost, letters); an insertion may come before any row, so all paths are kept apart
    paths = [("", 0, "", [])]
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        grown = {}
        for state, cost, letters, lines in paths:
            runs, at = [(state, cost, letters, lines)], (state, cost, letters, lines)
            for _ in range(3):
                who = "assistant" if at[0] == "u" else "user"
                at = (after(at[0], who[0]), at[1] + 2, at[2] + "I", [*at[3], f"{who}:"])
                runs.append(at)
            for s, c, le, li in runs:
                options = [(s, c + 3, le + "D", li)]
                if fault not in ("b", "d"):
                    cut = fault == "t"
                    to = after(s, role[:1])
                    if to:
                        options.append((to, c + cut, le + "K", [*li, f"{role}:{text}"]))
                    for who in ("user", "assistant"):
                        to = after(s, who[0])
                        if to:
                            options.append((to, c + 2 + cut, le + "R", [*li, f"{who}:{text}"]))
                for o in options:
                    if o[0] not in grown or o[1:3] < grown[o[0]][1:3]:
                        grown[o[0]] = o
        paths = list(grown.values())
    ends = inserted({s: (c, le, li) for s, c, le, li in paths})
    cost, letters, lines = min((v for s, v in ends.items() if s in ("", "a")), key=lambda v: v[:2])
    pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(rows, rows[1:], strict=False)]
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [sum(f == k for f in faults) for k in "bdt"]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    hurt, out = damage(rows), {}
    for conv in {r[0] for r in rows}:
        out[conv] = plain(sorted((r for r in hurt if r[0] == conv), key=order))
    return out


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def made_up(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            text = rng.choice(["yes.", "no!", "cut off", " \t", "", None, f"so {turn}?", f"then {turn} \n", "ends. \x0b"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "SYSTEM"]), text))
    return rows + rows[:7]


def test_equals_a_search_over_whole_strings(spark, monkeypatch):
    rows = made_up(1, 120)
    docs = spark.createDataFrame(rows, ROWS).withColumn("conv", F.lit("x")).withColumn("n", F.lit("y")).withColumn("code", F.lit(1))
    want = expected(rows)
    assert result(conversation_repair.digest(docs)) == want
    # conversations in many blocks, chained
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 2)
    assert result(conversation_repair.digest(docs.repartition(3))) == want


def test_a_long_conversation_in_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_BYTES", 600)
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"said {t}."])) for t in range(400)] + [(6, 0, "user", "long " * 50_000)]
    docs = spark.createDataFrame(rows, ROWS)
    assert result(conversation_repair.digest(docs)) == expected(rows)
    assert result(conversation_repair.digest(docs.limit(0))) == {}
    turns = conversation_repair.repair(conversation_repair.damaged(docs)).where("conv = '5'").orderBy("place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns))


def test_moves_follow_the_pattern():
    for code in range(16):
        for state in range(4):
            for m, macro in enumerate(conversation_repair.MACROS):
                cost = conversation_repair.COST[code, state, m]
                assert cost >= conversation_repair.FAR or cost >= 2 * (len(macro) - 1)
    assert conversation_repair.MACROS == tuple(sorted(conversation_repair.MACROS))
