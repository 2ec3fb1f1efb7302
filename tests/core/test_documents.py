"""Extraction, reading, publishing, policy and governance."""

import json

from pyspark.sql import functions as F

from tidemark.operators import converters, governance, joins, quality, state
from tidemark.plans.policy_queries import PLANTED
from tidemark.schemas import CURSOR, SOURCE, conform, domain_findings
from tidemark.sources import readers, sinks

VTT = """WEBVTT

STYLE
::cue { color: red }

NOTE a note

1
00:01.000 --> 00:02.000 align:start
<v Ann>Hello &amp; <b>good</b> day</v>

00:02.500 --> 00:03.000
<v Ann>again

01:00:05.000 --> 01:00:06.000
no tag &amp;lt; here

00:03.100 --> 00:04.000
<v.loud Bob>Yes</v> <v Ann>No
"""


def test_transcripts():
    said = converters.cues(VTT)
    assert [(a, who, t) for a, _, who, t in said] == [(1000, "Ann", "Hello & good day"), (2500, "Ann", "again"), (3100, "Bob", "Yes"), (3100, "Ann", "No"), (3605000, "", "no tag &lt; here")]
    assert converters.from_transcript("x.vtt", VTT)[0]["body"].split("\n")[0] == "[00:00:01] Ann: Hello & good day again"


def test_pages_and_mail():
    title, text = converters.html_text("<html><head><title> T </title><style>x{}</style></head><body><h2>Head</h2><p>a&nbsp;b<script>bad()</script></p><ul><li>one<li>two</ul></body></html>")
    assert title == "T" and text.split("\n") == ["## Head", "", "a b", "", "- one", "- two"] or "bad" not in text
    mail = "From: a@b.c\nSubject: Hi\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>body</p>\n--q\nContent-Type: text/csv\nContent-Disposition: attachment; filename=t.csv\n\na,b\n--q--\n"
    unit = converters.from_mail("m.eml", mail)[0]
    assert unit["title"] == "Hi" and "body" in unit["body"] and "| 1 | t.csv | text/csv |" in unit["body"]
    month = {"team_name": "T", "channel_name": "C", "month": "2026-09", "messages": [
        {"id": "2", "reply_to_id": "1", "created": "b", "from": "Y", "body_html": "re"}, {"id": "1", "reply_to_id": None, "created": "a", "from": "X", "body_html": "<p>top</p>", "last_modified": "z"},
        {"id": "4", "reply_to_id": "gone", "created": "c", "from": "Z", "body_html": "", "deleted": True}, {"id": "5", "reply_to_id": "2", "created": "d", "from": "W", "body_html": "lost"}]}
    body = converters.from_month("2026-09.teams.json", json.dumps(month))[0]["body"]
    assert "4 messages in 2 threads" in body and body.index("top") < body.index("> re") < body.index("[deleted]") and "lost" not in body and "(edited)" in body
    table = converters.from_table("x.csv", 'a,b\n"1,5",x|y\n\n')[0]["body"]
    assert table == "| a | b |\n| --- | --- |\n| 1,5 | x\\|y |\n"
    assert converters.from_markdown("x.md", "---\ntitle: Own\n---\n# Other\n")[0]["title"] == "Own"
    graph = '<mxfile><root><mxCell id="1" vertex="1" value="A"/><mxCell id="2" vertex="1" value="B"/><mxCell id="3" edge="1" source="1" target="2" value="to"/><mxCell id="4" edge="1"/></root></mxfile>'
    assert converters.from_diagram("d.drawio", graph)[0]["body"] == "- A\n- B\n- A -> B: to\n"


def test_convert_uses_the_cache_and_survives_bad_files(spark):
    rows = [("a.txt", b"hello"), ("b.txt", b"hello"), ("c.teams.json", b"{bad"), ("d.bin", b"x"), ("e.txt", b"a\0b"), ("f.txt", b""), ("g.txt", None)]
    files = spark.createDataFrame([(n, n, bytearray(c) if c is not None else None) for n, c in rows], "path string, name string, content binary")
    got = {r.path: r for r in converters.convert(files).collect()}
    assert [got[n].status for n in ("a.txt", "b.txt", "c.teams.json", "d.bin", "e.txt", "f.txt")] == ["ok", "ok", "failed", "refused", "unreadable", "unreadable"]
    assert got["a.txt"].action_key == got["b.txt"].action_key and got["a.txt"].body == "hello\n" and got["a.txt"].tokens == 2
    cache = converters.convert(files.where("path = 'a.txt'")).select("action_key", "status", "reason", "unit_id", "kind", "title", F.lit("cached\n").alias("body"))
    again = {r.path: r.body for r in converters.convert(files, cache).collect()}
    assert again["a.txt"] == again["b.txt"] == "cached\n" and len(again) == len(got)


def test_listing_reads_metadata_only(spark, tmp_path):
    for p in ("keep/a.txt", "keep/b.TMP", "skip/c.txt", "README.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x" * 5)
    df = readers.local_listing(spark, str(tmp_path), "s", [], ["*.tmp", "skip/"])
    assert sorted((r.rel_path, r.name, r.size) for r in df.collect()) == [("README.txt", "README.txt", 5), ("keep/a.txt", "a.txt", 5)]
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("Project")[-1].split("]")[0]
    assert readers.complete(df, "README.txt") and not readers.complete(df, "nothing")


def test_feeds(spark):
    records = spark.createDataFrame(
        [("1", 1, "old", 5, None, None, None), ("1", 2, "new", 6, None, None, None), ("2", 3, "dir", 0, (1,), None, None), ("3", 4, "x", 0, None, ("deleted",), None), ("4", 5, "y", 0, None, ("deleted",), None), ("5", 6, "z", 0, None, None, ("r",))],
        "id string, seq bigint, name string, size bigint, folder struct<childCount:bigint>, deleted struct<state:string>, remoteItem struct<id:string>",
    )
    full = records.select(
        "*", F.lit("c").alias("cTag"), F.lit("e").alias("eTag"), F.lit("2024-01-01T00:00:00.5Z").alias("lastModifiedDateTime"), F.lit(None).cast("struct<id:string,driveId:string>").alias("parentReference"),
        F.lit(None).cast("struct<hashes:struct<quickXorHash:string,sha1Hash:string,sha256Hash:string>,mimeType:string>").alias("file"), F.lit(None).cast("struct<x:string>").alias("root"),
    )
    known = spark.createDataFrame([("s", "3")], "source_id string, stable_id string")
    got = {r.stable_id: r for r in readers.drive_feed(full, known, "s", False).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].name == "new" and got["2"].ctag is None and got["2"].is_dir and got["3"].deleted
    assert got["1"].mtime_ns == 1704067200500000000
    assert {r.stable_id for r in readers.new_folders(readers.drive_feed(full, known, "s", False), known).collect()} == {"2"}


def test_paged_source(spark, tmp_path):
    pages = [({"value": [{"id": 1}, {"id": 2}], "@odata.nextLink": f"{tmp_path}/1"}), ({"value": [{"id": 3}], "@odata.nextLink": f"{tmp_path}/0"})]
    for k, p in enumerate(pages):
        (tmp_path / str(k)).write_text(json.dumps(p))
    got = readers.paged(spark, [f"{tmp_path}/0"]).collect()  # the second page links back: the walk ends
    assert [(r.seq, json.loads(r.record)["id"]) for r in sorted(got, key=lambda r: r.seq)] == [(0, 1), (1, 2), (2, 3)]


def test_config_edges_and_heads(spark, tmp_path):
    cfg = '[[source]]\nid="a"\nkind="local"\nroot="/x"\n[[source]]\nid="b"\nkind="inbox"\nstate="paused"\n'
    assert {r.source_id: r.config_state for r in readers.sources_from_config(spark, cfg).collect()} == {"a": "live", "b": "paused"}
    for bad in ('[[source]]\nid="a"\nkind="nope"\n', '[[source]]\nid="a"\nkind="local"\ntypo=1\n', cfg + '[[source]]\nid="a"\nkind="local"\n'):
        try:
            readers.sources_from_config(spark, bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    (tmp_path / "d.tsv").write_text("page\tsource\tpinned_sha\trole\np\ts\t\tr\nshort\tone\n")
    edges = readers.edge_table(spark, str(tmp_path / "d.tsv"))
    assert sorted((r.page, r.fields) for r in edges.collect()) == [("p", 4), ("short", 2)] and readers.usable_edges(spark, str(tmp_path / "d.tsv"))
    pages = spark.createDataFrame([("a.md", "---\nrendered_sha256: abc\nstatus: current\n---\nrendered_sha256: zzz\n"), ("b.md", "no front\n")], "path string, text string")
    assert [(r.source, r.sha, r.status) for r in readers.page_heads(pages).orderBy("source").collect()] == [("a.md", "abc", "current"), ("b.md", None, None)]
    topic = spark.createDataFrame([("t.md", "---\ntitle: x\nsources:\n  - path: m/a.md\n    sha: 12\n    role: main\n  - path: m/b.md\n---\nbody")], "path string, text string")
    assert [(s.path, s.sha, s.role) for s in readers.topic_pages(topic).first().sources] == [("m/a.md", "12", "main"), ("m/b.md", None, None)]


def test_snapshots_publish_last(spark, tmp_path):
    store = sinks.SnapshotStore(spark, str(tmp_path))
    assert store.published() is None
    store.write("t", 1, spark.range(1))
    store.publish(1)
    store.write("t", 2, spark.range(5))
    assert store.published() == 1 and store.read("t", store.published()).count() == 1
    store.write("t", 2, spark.range(3))
    store.publish(2)
    assert store.published() == 2 and store.published(1) == 1 and store.read("t", 2).count() == 3 and store.history("t").count() == 4
    pages = spark.createDataFrame([("p", "current", "B\n")], "path string, status string, body string")
    text = sinks.page_text(pages)
    assert text.first().text == "---\nstatus: current\n---\nB\n"
    assert sinks.changed_pages(text, text).count() == 0 and sinks.changed_pages(text, text.limit(0)).count() == 1
    lines = spark.createDataFrame([("s1", "2", "b"), ("s1", "1", "a"), ("s2", "1", "c")], "source_id string, id string, line string")
    sinks.write_shards(lines, str(tmp_path / "shards"))
    assert [r.value for r in spark.read.text(str(tmp_path / "shards/source_id=s1")).collect()] == ["a", "b"]


def test_each_secret_rule_and_its_look_alike(spark):
    clean = ["AKIA123", "BEGIN PUBLIC KEY", "AccountKey=short", "xoxq-1", "ghp_short", "password: required", "password: minimum 12 characters", "pwd = ********", "Password: <your password>", "https://h/p@x", "postgres://user:password@host", "https://joe:${PASS}@h"]
    pages = spark.createDataFrame([(f"hit{i}", t) for i, t in enumerate(PLANTED)] + [(f"no{i}", t) for i, t in enumerate(clean)] + [("null", None)], "path string, text string")
    got = {r.path: r.rule for r in quality.secret_hits(pages).collect()}
    assert got == {f"hit{i}": rule for i, rule in enumerate(["aws-access-key", "private-key", "azure-conn-string", "slack-token", "github-token", "generic-password", "url-credential"])}
    titled = pages.withColumn("title", F.when(F.col("path") == "hit1", F.lit(PLANTED[0])).otherwise(F.lit("t")))
    acts = {r.path: r.action for r in quality.screened(titled).collect()}
    assert acts["hit0"] == "stub" and acts["hit1"] == "redact" and acts["no0"] == "publish"
    leaks = spark.createDataFrame([("a", "x access_token=abcdefghijklmnop0"), ("b", "reset-token=short"), ("c", "has KNOWNSECRETVALUE1 in it")], "path string, text string")
    assert {r.path for r in quality.token_leaks(leaks, ["KNOWNSECRETVALUE1", "short"]).collect()} == {"a", "c"}


def test_holds_erasure_and_retention(spark):
    events = spark.createDataFrame([(1, "s1", "hold"), (2, "s1", "release"), (3, "s2", "hold")], "seq bigint, scope string, event string")
    holds = governance.active_holds(events)
    assert [r.scope for r in holds.collect()] == ["s2"]
    history = spark.createDataFrame([("s1", "1", "p"), ("s1", "2", "p"), ("s2", "3", "p"), ("s1", "4", "z")], "source_id string, stable_id string, path string")
    items = history.select("source_id", "stable_id").distinct()
    left, gone = governance.erase({"items": items}, history, spark.createDataFrame([("s1", "1")], "source_id string, stable_id string"), holds)
    assert {r.stable_id for r in gone.collect()} == {"1", "2"} and {r.stable_id for r in left["items"].collect()} == {"3", "4"}
    paths, others = history.where("source_id = 's1' and path = 'p'").select("source_id", "path").distinct(), history.where("stable_id in ('3', '4')").select("path")
    assert governance.survivors(left, gone, paths, others).count() == 0 and governance.survivors({"items": items}, gone, paths, others).first().n == 2
    snaps = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-10"), (3, "2024-02-20")], "run_id bigint, day string").withColumn("day", F.to_date("day"))
    kept = {r.run_id: (r.keep, r.state) for r in governance.retained(snaps, F.lit("2024-03-01").cast("date")).collect()}
    assert kept == {1: (False, "overdue"), 2: (True, "overdue"), 3: (True, "overdue")}
    assert governance.retained(snaps, F.lit("2024-03-01").cast("date"), holds=holds).where("not keep").count() == 0
    text = spark.createDataFrame([("i", "a x\nb\nc x")], "path string, text string")
    assert governance.scrubbed(text, ["x"]).first().text == "b"


def test_cursors_sources_and_breaker(spark):
    cursors = conform(spark.createDataFrame([("a", "t0"), ("b", "u0")], "source_id string, current_token string"), CURSOR)
    staged = state.stage_cursors(cursors, spark.createDataFrame([("a", "t1"), ("c", "v1")], "source_id string, token string"), 7)
    done = {r.source_id: (r.current_token, r.pending_token) for r in state.promote_cursors(staged, 7, True).collect()}
    assert done == {"a": ("t1", None), "b": ("u0", None), "c": ("v1", None)}
    assert {r.source_id: r.current_token for r in state.promote_cursors(staged, 7, False).collect()}["a"] == "t0"
    sources = conform(spark.createDataFrame([("a", "local", "live", "f1", True), ("b", "local", "live", "f2", True)], "source_id string, kind string, config_state string, config_fingerprint string, enumeration_complete boolean"), SOURCE)
    nxt, changed = state.upsert_sources(sources, spark.createDataFrame([("a", "local", "live", "f9"), ("c", "inbox", "live", "f3")], "source_id string, kind string, config_state string, config_fingerprint string"))
    assert [r.source_id for r in changed.collect()] == ["a"] and {r.source_id: r.enumeration_complete for r in nxt.collect()} == {"a": False, "b": True, "c": False}
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tripped = state.breaker_state(nxt, spark.createDataFrame([("a", 30, True), ("b", 0, False)], "source_id string, candidates bigint, tripped boolean"), now)
    assert [r.source_id for r in state.breaker_active(tripped, now).collect()] == ["a"]
    assert state.breaker_active(tripped, F.lit("2024-01-09 00:00:00").cast("timestamp")).count() == 0
    odd = spark.createDataFrame([("live",), ("nonsense",), (None,)], "state string")
    assert [(r.column, r.value, r.n) for r in domain_findings(odd).collect()] == [("state", "nonsense", 1)]


def test_removals_branches(spark):
    items = spark.createDataFrame([("s", "d", None, "live"), ("s", "d1", "d", "live"), ("s", "d2", "d1", "tombstone"), ("s", "x", None, "live"), ("s", "y", None, "live"), ("t", "z", None, "live")], "source_id string, stable_id string, parent_id string, state string")
    pick = lambda *ids: items.where(F.col("stable_id").isin(*ids)).select("source_id", "stable_id")
    breaker = spark.createDataFrame([("s", True), ("t", False)], "source_id string, tripped boolean")
    got = {r.stable_id: r.why for r in state.removals(items, pick("d"), pick("x", "z"), pick("y"), breaker).collect()}
    assert got == {"d": "provider", "d1": "below-deleted-folder", "y": "scope-change", "z": "absent"}
    assert "x" in {r.stable_id for r in state.removals(items, pick("d"), pick("x", "z"), pick("y"), breaker, accepted=True).collect()}
    ledger = spark.createDataFrame([("f", "add", 1), ("f", "remove", 2), ("g", "add", 3), ("h", "add", 1)], "fingerprint string, event string, at bigint")
    assert [r.fingerprint for r in joins.lost_records(ledger, spark.createDataFrame([("h",)], "fingerprint string")).collect()] == ["g"]
