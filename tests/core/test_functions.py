"""Scalar functions against plain Python."""

import base64
import fnmatch
import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.functions import text as tx


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


GLOBS = [
    ("*.txt", "a/b/x.TXT", True), ("*.txt", "x.txt.md", False), ("a/*.txt", "a/x.txt", True), ("a/*.txt", "a/b/x.txt", False), ("a/**/x", "a/x", True), ("a/**/x", "a/b/c/x", True),
    ("build/", "build/x/y", True), ("build/", "a/build/x", True), ("/a/b", "a/b", True), ("**/tmp/*", "tmp/x", True), ("x?.md", "x1.md", True), ("x?.md", "x/.md", False),
    ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("[ab]c", "bc", True), ("a.b", "aXb", False), ("a+b(c)", "a+b(c)", True), ("é*", "été", True), ("[x", "[x", True),
]


@pytest.mark.parametrize(("glob", "path", "hit"), GLOBS)
def test_globs(spark, glob, path, hit):
    assert column(spark, [path], lambda c: fx.glob_match(c, glob)) == [hit]


def test_names(spark):
    assert column(spark, ["a.TXT", "x.teams.json", ".teams.json", ".hidden", "a.b/c", "a.tar.gz"], fx.suffix) == [".txt", ".teams.json", ".json", "", "", ".gz"]
    assert column(spark, ["Book (1).xlsx", "a - Copy.txt", "a - Copy (2) (1).txt", "(1).txt", "a-DESKTOP-AB12CD3.md", ".gitignore"], fx.fold_copy_suffix) == ["Book.xlsx", "a.txt", "a.txt", "(1).txt", "a.md", ".gitignore"]
    assert column(spark, ["claude.md", "Agents", "CLAUDE-notes.md", ".git", "readme"], fx.neutral_name) == ["claude-doc.md", "Agents-doc", "CLAUDE-notes.md", "dot-git", "readme"]
    assert column(spark, ["https://a.b/c?d=é"], fx.sharing_id) == ["u!" + base64.urlsafe_b64encode("https://a.b/c?d=é".encode()).decode().rstrip("=")]


def test_hashes(spark):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = spark.range(1).select(
        fx.action_key(F.lit("c"), F.lit("2"), F.lit("o"), F.lit("u"), F.lit("h")).alias("k"), fx.options_hash({"b": F.lit("2"), "a": F.lit('x"')}).alias("o"), fx.action_key(F.lit(None), F.lit("2"), F.lit("o"), F.lit("u"), F.lit("h")).alias("n"),
        fx.rollup_hash(F.array(F.struct(F.lit("b").alias("name"), F.lit("2").alias("digest")), F.struct(F.lit("a").alias("name"), F.lit("1").alias("digest"))), "m\n").alias("r"),
    ).first()
    assert row.k == digest("1|c|2|o|u|h") and row.n is None
    assert row.o == "sha256:" + digest(json.dumps({"b": "2", "a": 'x"'}, sort_keys=True, separators=(",", ":")))
    assert row.r == digest("m\na\x001\nb\x002\n")


def test_values(spark):
    assert column(spark, ["true", "12", "-3.0", "2.5", "1e3", "2024-01-02", "2024-01-02T03:04:05Z", "x1", None, "1."], fx.type_label) == ["bool", "int", "int", "float", "int", "date/time", "date/time", "text", None, "int"]
    assert column(spark, [1, 26, 27, 52, 53, 702, 703, 728, 16384, 0], fx.column_letters, "int") == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ", "XFD", ""]
    assert column(spark, ["500MB", "2 GiB", "10", "1.5kb", "x", "5 parsecs"], fx.parse_size) == [500_000_000, 2 << 30, 10, 1500, None, None]
    assert column(spark, ["{AB12CD34-0000-1111-2222-333344445555}", "nope"], fx.guid) == ["ab12cd34-0000-1111-2222-333344445555", None]
    assert column(spark, ["2024-01-02T03:04:05.123456789Z", "1970-01-01T00:00:01Z"], fx.iso_ns) == [1704164645123456789, 1_000_000_000]
    assert column(spark, [1704164645123456789], fx.ns_iso, "bigint") == ["2024-01-02T03:04:05.123Z"]
    assert column(spark, ["00:01.500", "01:02:03.004"], fx.cue_ms) == [1500, 3723004]
    assert column(spark, [3723999, 0, 360_000_000], fx.clock, "bigint") == ["01:02:03", "00:00:00", "100:00:00"]
    assert column(spark, ["a &amp;lt; &lt;b&gt;"], fx.decode_entities) == ["a &lt; <b>"]
    assert column(spark, ["abcd", "abcde", ""], fx.token_estimate) == [1, 2, 0]
    assert column(spark, ["a;b = c ; D=e"], fx.label_header)[0]["d"] == "e"


def test_text_forms(spark):
    assert column(spark, ["# A\n```\n# no\n```\n## B ##\ntext"], fx.headings) == [["A", "B"]]
    assert column(spark, ["---\ntitle: T\n---\n# H", "# H\nx", "\n  first\nx", "---\na: b\n---\nx"], fx.title) == ["T", "H", "first", "---"]
    assert column(spark, ["a ``` b", "no", "`````"], fx.fence_width) == [4, 3, 6]
    assert column(spark, ['a,"b"', "plain"], fx.csv_field) == ['"a,""b"""', "plain"]
    assert column(spark, [["aa", "bb", "cc"], ["aaaa"]], lambda c: fx.join_limited(c, 7), "array<string>") == ["aa; bb…", "aaaa"]
    assert column(spark, ["https://u:p@h/x?y=1#z", "/Users/jo/x"], lambda c: fx.home_to_tilde(fx.redact_url(c))) == ["https://h/x?…#z", "~/x"]
    held = spark.createDataFrame([("one two three four", "one ... four"), ("one two", "two ... one"), ("aXb", "a...b"), ("x", "...")], "t string, q string")
    assert [r[0] for r in held.select(fx.quote_held("t", "q")).collect()] == [True, False, True, True]
    assert column(spark, ["https://h/a", "https://h/a/b", "https://h/ab", "http://h/a", "https://x@h/a"], lambda c: fx.allowed_remote(c, "https://h/a")) == [True, True, False, False, False]


def test_slugs_are_fixed_points():
    rng = random.Random(1)
    alphabet = "aÀé ß.Ａ-–[]/:*?​\t\x00ConÑ\U0001f600_1Ø"
    for _ in range(500):
        s = tx.slug("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))))
        assert s and tx.slug(s) == s and not s.endswith((".", " ")) and not set(s) & tx.DROPPED and s == unicodedata.normalize("NFC", s)
    assert [tx.slug(x) for x in ("CON.txt", "", "…", "Été 2026", "a – b")] == ["con-doc.txt", "untitled", "untitled", "ete-2026", "a---b"]
    assert tx.mirror_path("s", "A/Über uns.md") == "mirror/s/a/uber-uns.md" and tx.mirror_path("s", "x.xlsx", "Sheet 1") == "mirror/s/x.xlsx.d/sheet-1.md"
    long = [tx.mirror_path("s", "/".join(["d" * 50] * 6) + f"/{k}.txt") for k in range(3)]
    assert len(set(long)) == 3 and all(len(p) <= 191 for p in long)


def test_orders_and_folds(spark):
    names = ["b10", "b2", "b 2", "B1", "é1", "e01", "a/x", "a", "...9", "... 8"]
    assert sorted(["b10", "b2", "b1"], key=tx.natural) == ["b1", "b2", "b10"] and sorted(["a/b", "a"], key=tx.natural) == ["a", "a/b"]
    assert column(spark, names, tx.natural_key) == [tx.natural(n) for n in names]
    assert column(spark, ["STRASSE", "straße", "É", None], tx.nfc_fold) == ["strasse", "strasse", "é", None]
    assert tx.decoded(b"\xef\xbb\xbfx\r\ny") == "x\ny" and tx.decoded("é".encode("utf-16")) == "é" and tx.decoded(b"\x93x\x94") == "“x”" and tx.decoded(b"a\0b") is None
    assert tx.similar("Total 12", "Totals 12") and not tx.similar("Total 12", "Total 13") and not tx.similar("abc", "xyz")
    assert tx.resolved("a/b/c.md", "../d.md") == "a/d.md" and tx.resolved("a.md", "../../x") is None
    assert fnmatch.fnmatch("a", "a")


@pytest.mark.parametrize("name", ["decoded_bytes", "body_forms", "converted_units", "mail_units"])
def test_whole_texts_come_in_small_batches(spark, sf_dir, name):
    from tidemark.plans.all_queries import QUERIES

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert int(QUERIES[name](spark, sf_dir).sparkSession.conf.get(key)) <= 1000 and spark.conf.get(key) == before
