"""SimHash, line dedup and decontamination against plain versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidemark.llm import decontamination, line_dedup, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    roots = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            roots[find(i)] = min(ids[i], roots.get(find(i), ids[i]))
    return [roots.get(find(i)) for i in range(len(ids))]


def test_fingerprints_match_the_engines_hash(spark):
    texts = ["one two three", "Ünï ÇODE", "a", "same same same same"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert [r.h & (1 << 64) - 1 for r in rows] == [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts]


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 5, 300]))) for _ in range(40)]
    texts = [None, "", "  \n", "\x0b\x0c", *base]
    for t in base[:25]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(["x", "y", w[0].upper()])
            texts.append(" ".join(w))
    rows = [*enumerate(texts), (7, texts[7]), (7, texts[7]), (None, texts[8]), (None, "quite alone here")]
    got = simhash.near_duplicates(documents(spark, rows, ["fp", "first", "root"])).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], prints), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_tiles_lose_no_link_and_leave_a_forest():
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(20)] + [seeds])
    near = np.unique(near)
    u, v = simhash.tile_forest(near, near, 3, buffer=50)
    assert len(u) <= 2 * len(near)
    label = {int(x): int(x) for x in near}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(u.view(np.uint64), v.view(np.uint64), strict=True):
        label[find(int(a))] = find(int(b))
    got = {}
    for x in near:
        got.setdefault(find(int(x)), set()).add(int(x))
    prints = [int(x) for x in near]
    want = {}
    for x, c in zip(prints, plain_components(prints, prints), strict=True):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[1000 + i] == 1000 for i in range(1, 100))


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "quite other words in this one"), (1, "alpha beta gamma delta"), (4, None), (5, ""), (None, "alpha beta gamma delta"), (None, "no id, no twin")]
    kept = simhash.drop_near_duplicates(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4] and sum(r.doc_id is None for r in kept) == 2 and kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def units(words):
    line = " ".join(words)
    return words if len(words) >= 8 else [f"\n{c}" for c in line] if len(line) >= 64 else None


def plain_lines(rows):
    order = lambda d, t: (d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest())
    lines = [((*order(d, t), n), re.split(r"[ \t\r\f\x0B]+", x.strip(" \t\r\f\x0b"))) for d, t in set(rows) if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [(p, w, units(w)) for p, w in lines if len(w) >= 3 or len(" ".join(w)) >= 16]
    gone = {p for p, w, a in lines for q, v, b in lines if q < p and (v == w or (a and b and within_one(a, b)))}
    out = []
    for d, t in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for n, x in enumerate(parts) if (*order(d, t), n) not in gone]
        out.append((str(d), len(parts), len(parts) - len(kept), t if len(kept) == len(parts) else "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(11)
    pool = [[rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.choice([2, 3, 7, 8, 9, 12, 20]))] for _ in range(25)]
    pool += [["".join(rng.choice("字符行文件") for _ in range(n))] for n in (15, 16, 63, 64, 65, 90)] + [["x" * 40, "y" * 40]]

    def line():
        w = list(rng.choice(pool))
        kind = rng.random()
        i = rng.randrange(len(w))
        if len(w) < 3 and kind < 0.5:
            j = rng.randrange(len(w[i]))
            w[i] = w[i][:j] + rng.choice(["", "新", w[i][j] * 2]) + w[i][j + 1 :]
        elif kind < 0.25:
            w[i] = "new"
        elif kind < 0.4:
            w.insert(i, "extra")
        elif kind < 0.55:
            del w[i]
        return rng.choice(["", "  "]) + rng.choice([" ", "\t", "  "]).join(w) + rng.choice(["", " \r"])

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[3][1] + "\nquite new words at the end of it all here now"), (103, " ".join(["long"] * 5000)), (104, " ".join(["long"] * 5001)), (105, rows[1][1])]
    return rows


def odd_line_rows():
    """Rows that share an id, or have none, with equal and with different texts."""
    rows = line_rows()
    return [*rows, rows[4], rows[4], (4, rows[5][1] + "\nthis line stands in one text of this id only"), (4, "and this one in another text of the same id"), (4, None), (None, "this line is wholly unique here"), (None, rows[3][1]), (None, rows[3][1]), (None, None), (None, "")]


def lines_found(docs):
    done, total, removed = line_dedup.deduplicate(docs)
    return sorted(((str(r.doc_id), r[total], r[removed], r.text) for r in done.collect()), key=str)


def test_lines(spark):
    rows = line_rows()
    assert lines_found(documents(spark, rows, ["line", "words", "first", "key", "doc", "i"])) == plain_lines(rows)
    assert lines_found(documents(spark, [])) == []


def test_lines_of_rows_that_share_or_lack_an_id(spark):
    rows = odd_line_rows()
    assert lines_found(documents(spark, rows, ["__row", "__gone", "__n_lines", "__N_REMOVED", "d", "c", "row"])) == plain_lines(rows)
    few = [(1, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "this line is wholly unique here"), (5, "one text of a shared id"), (5, "another text of a shared id")]
    kept = line_dedup.drop_duplicate_lines(documents(spark, few, ["__n_removed", "__gone"])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(d), t) for d, t in few if (d, t) != few[1])


def test_lines_equal_their_sql_twin(spark, tmp_path):
    documents(spark, odd_line_rows()).write.parquet(f"{tmp_path}/documents")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = c.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({line_dedup.ORACLE_SQL})").fetchall()
    got = line_dedup.digest(spark.read.parquet(f"{tmp_path}/documents")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_lines_of_heavy_keys_and_shuffled_sides(spark, monkeypatch):
    from tidemark.llm import runtime

    monkeypatch.setattr(runtime.side, "__defaults__", (0,))
    monkeypatch.setattr(runtime, "HEAVY_ROWS", 3)
    monkeypatch.setattr(runtime, "HEAVY_SHARE", 1000)
    rows = line_rows()
    names = [f"word{k}" for k in range(40)]
    rows += [(200 + k, f"all of these lines are the same but for {n} and no more\nthis one stands in all of them") for k, n in enumerate(names)]
    assert lines_found(documents(spark, rows)) == plain_lines(rows)


def test_many_lines_of_one_text(spark):
    lines = [" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[:6] for j in range(9)) for k in range(30_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines))]
    (text,) = [r.text for r in line_dedup.drop_duplicate_lines(documents(spark, rows)).collect() if r.doc_id == 2]
    assert text.split("\n") == lines[1::2]


def test_repeated_rows(spark):
    text = "one two three four five six seven eight\nshort line\nA B C"
    rows = [(5, text), (5, text), (6, "one two three four five six seven nine\nA B C\nkept at last"), (7, text)]
    assert set(lines_found(documents(spark, rows))) == {("5", 3, 0, text), ("6", 3, 2, "kept at last"), ("7", 3, 2, "short line")}
    assert sorted(r.doc_id for r in line_dedup.drop_duplicate_lines(documents(spark, [(1, "a b c"), (2, "a b c"), (3, None), (4, "")])).collect()) == [1, 3, 4]


def test_native_plans_have_no_python(spark):
    docs = documents(spark, [(1, "one two three four five six seven eight nine ten eleven twelve")])
    bench = docs.selectExpr("doc_id AS item_id", "text")
    for df in (line_dedup.digest(docs), decontamination.overlaps(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 40, 18, 12, 11, 10, 7, 5, 4, 50])] + [(90, None), (91, ""), (92, "the the the the the the the the the the the the the the the")]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for k, t in items[:10]:
        w = t.split()
        rows.append((100 + k, f"{filler(20)} {t.upper()}! {filler(9)}"))
        want.add((100 + k, k))
        rows.append((200 + k, f"{filler(3)}, {', '.join(w)}"))
        want.add((200 + k, k))
        if len(w) >= 18:
            few = list(w)
            for i in rng.sample(range(len(w)), len(w) // 10):
                few[i] = "other"
            rows.append((300 + k, f"{filler(20)} {' '.join(few)}"))
            want.add((300 + k, k))
            many = [x if i % 2 else "other" for i, x in enumerate(w)]
            rows.append((400 + k, " ".join(many)))
    rows += [(500, None), (501, ""), (502, filler(3000)), (None, items[0][1]), (503, items[1][1]), (503, items[1][1])]
    rows += [(600, filler(8) + " " + " ".join(items[1][1].split()[10:23])), (601, filler(8) + " " + " ".join(items[1][1].split()[10:22]))]
    want |= {(None, 0), (503, 1), (600, 1)}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.overlaps(documents(spark, rows, ["words", "seed", "at", "item_id", "start"]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.matched >= 0.8 * r.item_words for r in got if r.doc_id != 600)
    kept = {r.doc_id for r in decontamination.drop_contaminated(documents(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in want}
    odd = [*rows, (None, "clean and without an id"), (503, "clean under an id that another text has too")]
    clean = decontamination.drop_contaminated(documents(spark, odd, ["__row", "row", "item", "seed"]), bench).collect()
    assert {r.text for r in clean} == {t for i, t in rows if i in kept} | {t for _, t in odd[-2:]}
    assert decontamination.overlaps(documents(spark, []), bench).count() == 0
    assert decontamination.overlaps(documents(spark, rows), bench.limit(0)).count() == 0
