"""Queries of functions, graphs, profiles, rollups and time, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import aggregates, graph, intervals
from tidemark.plans.registry import query, table

EDGES = """SELECT concat('topics/', CAST(doc_id % 60 AS STRING), '.md') AS page, CASE WHEN doc_id % 50 = 0 THEN '' ELSE concat('mirror/', CAST(doc_id AS STRING), '.md') END AS source,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'abc' WHEN doc_id % 3 = 0 THEN SHA(concat(text, 'old')) ELSE SHA(text) END AS pinned_sha,
  CAST(CASE WHEN doc_id % 23 = 0 THEN 2 ELSE 4 END AS INT) AS fields FROM documents"""
HEADS = "SELECT concat(CASE WHEN doc_id % 19 = 0 THEN 'gone/' ELSE 'mirror/' END, CAST(doc_id AS STRING), '.md') AS source, SHA(text) AS sha, CASE WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 17 = 0 THEN 'unreadable' ELSE 'current' END AS status FROM documents"


def duck(text: str) -> str:
    return text.replace("SHA(", "sha256(")


def spark_rows(spark, sf_dir, text, view="documents_rows"):
    table(spark, sf_dir, "documents").createOrReplaceTempView(view)
    import re

    return spark.sql(re.sub(r"SHA\(", "sha(", text).replace("sha(text)", "sha2(text, 256)").replace("sha(concat(text, 'old'))", "sha2(concat(text, 'old'), 256)").replace("FROM documents", f"FROM {view}"))


@query(
    f"""WITH e AS ({duck(EDGES)}), h AS ({duck(HEADS)}), v AS (SELECT e.page, CASE WHEN fields < 3 THEN '' ELSE e.source END AS source, CASE
    WHEN fields < 3 THEN 'MALFORMED' WHEN pinned_sha = '' THEN 'UNPINNED' WHEN NOT regexp_full_match(pinned_sha, '[0-9a-f]{{64}}') THEN 'BAD-PIN' WHEN e.source = '' THEN 'MISSING-OR-UNPARSEABLE'
    WHEN status = 'deleted' THEN 'SOURCE-DELETED' WHEN status IN ('unreadable', 'refused') THEN 'SOURCE-UNREADABLE' WHEN sha IS NULL THEN 'MISSING-OR-UNPARSEABLE' WHEN sha <> pinned_sha THEN 'STALE' END AS verdict
  FROM e LEFT JOIN h ON h.source = e.source) SELECT DISTINCT page, source, verdict FROM v WHERE verdict IS NOT NULL"""
)
def refresh_queue(spark, sf_dir):
    return graph.refresh_queue(spark_rows(spark, sf_dir, EDGES), spark_rows(spark, sf_dir, HEADS))


@query(f"WITH e AS ({duck(EDGES)}), h AS ({duck(HEADS)}) SELECT source AS page, status FROM h WHERE status NOT IN ('deleted', 'refused', 'unreadable') AND source NOT IN (SELECT source FROM e)")
def uncovered_pages(spark, sf_dir):
    heads = spark_rows(spark, sf_dir, HEADS).select(F.col("source").alias("page"), "status")
    return graph.uncovered_pages(heads, spark_rows(spark, sf_dir, EDGES))


@query(f"WITH e AS ({duck(EDGES)}) SELECT page FROM (SELECT DISTINCT concat('topics/', CAST(doc_id % 90 AS STRING), '.md') AS page FROM documents) WHERE page NOT IN (SELECT page FROM e)")
def unlisted_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").selectExpr("concat('topics/', doc_id % 90, '.md') AS page").distinct()
    return graph.unlisted_pages(pages, spark_rows(spark, sf_dir, EDGES))


TREE = """SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent, r_name AS name FROM region
  UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name FROM nation
  UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), c_name FROM customer
  UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), concat('c', CAST(o_custkey AS STRING)), CAST(o_orderkey AS STRING) FROM orders"""


def tree(spark, sf_dir):
    for t in ("region", "nation", "customer", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"{t}_tree")
    text = TREE
    for t in ("region", "nation", "customer", "orders"):
        text = text.replace(f"FROM {t}", f"FROM {t}_tree")
    return spark.sql(text).select(F.lit("s").alias("source_id"), F.col("id").alias("stable_id"), F.col("parent").alias("parent_id"), "name")


@query(
    f"""WITH RECURSIVE t AS ({TREE}), w(id, path) AS (SELECT id, name FROM t WHERE parent IN ('r1', 'r2')
  UNION ALL SELECT t.id, w.path || '/' || t.name FROM t JOIN w ON t.parent = w.id) SELECT 's' AS source_id, id AS stable_id, path AS rel_path FROM w"""
)
def rederive_paths(spark, sf_dir):
    roots = spark.createDataFrame([("s", "r1"), ("s", "r2")], "source_id string, stable_id string")
    return graph.derive_paths(tree(spark, sf_dir), roots)


@query(
    f"WITH RECURSIVE t AS ({TREE}), w(id) AS (SELECT id FROM t WHERE parent IN ('n3', 'n7') UNION SELECT t.id FROM t JOIN w ON t.parent = w.id) SELECT 's' AS source_id, id AS stable_id FROM w"
)
def descendants(spark, sf_dir):
    roots = spark.createDataFrame([("s", "n3"), ("s", "n7")], "source_id string, stable_id string")
    return graph.descendants(tree(spark, sf_dir), roots)


@query(
    f"""WITH RECURSIVE t AS ({TREE}), w(id, v) AS (SELECT id, id FROM t WHERE id IN ('r0', 'n4', 'c10') UNION ALL SELECT t.id, CASE WHEN t.id IN ('r0', 'n4', 'c10') THEN t.id ELSE w.v END FROM t JOIN w ON t.parent = w.id)
  SELECT 's' AS source_id, id AS stable_id, CASE WHEN id IN ('r0', 'n4', 'c10') THEN id ELSE max(v) END AS value FROM (SELECT id, v FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN v LIKE 'c%' THEN 0 WHEN v LIKE 'n%' THEN 1 ELSE 2 END) = 1) GROUP BY id"""
)
def inherited_values(spark, sf_dir):
    t = tree(spark, sf_dir)
    values = t.where(F.col("stable_id").isin("r0", "n4", "c10")).select("source_id", "stable_id", F.col("stable_id").alias("value"))
    return graph.nearest_ancestor_value(t, values)


@query(
    "SELECT doc_id, sha256(concat('1|text|', lang, '|', 'sha256:', sha256('{\"lang\":\"' || lang || '\",\"rows\":\"200\"}'), '|whole|', sha256(text))) AS action_key, "
    "'sha256:' || sha256('{\"lang\":\"' || lang || '\",\"rows\":\"200\"}') AS options_hash, substr(sha256(text), 1, 12) AS short FROM documents"
)
def action_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    options = fx.options_hash({"rows": F.lit("200"), "lang": F.col("lang")})
    key = fx.action_key(F.lit("text"), F.col("lang"), options, F.lit("whole"), fx.sha("text"))
    return d.select("doc_id", key.alias("action_key"), options.alias("options_hash"), fx.sha("text", 12).alias("short"))


@query(
    "SELECT source AS source_id, sha256('parts@1' || chr(10) || string_agg(concat(CAST(doc_id AS STRING), chr(0), sha256(text), chr(10)), '' ORDER BY CAST(doc_id AS STRING))) AS rollup FROM documents GROUP BY 1"
)
def rollup_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("name"), fx.sha("text").alias("digest"))).alias("parts"))
    return d.select("source_id", fx.rollup_hash(F.col("parts"), "parts@1\n").alias("rollup"))


NAMES = "CASE doc_id % 6 WHEN 0 THEN '.hidden' WHEN 1 THEN concat('Report ', CAST(doc_id AS STRING), '.DOCX') WHEN 2 THEN '2026-09.teams.json' WHEN 3 THEN concat('a.b/', CAST(doc_id AS STRING), '.md') WHEN 4 THEN 'plain' ELSE concat('x (1) - Copy (2)', '.html') END"


@query(
    f"""WITH n AS (SELECT doc_id, text, {NAMES} AS name FROM documents) SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
  CASE WHEN lower(name) LIKE '%_.teams.json' THEN '.teams.json' ELSE regexp_extract(lower(name), '^.+(\\.[^./]*)$', 1) END AS suffix,
  CASE doc_id % 6 WHEN 1 THEN 'document' WHEN 2 THEN 'month' WHEN 3 THEN 'markdown' WHEN 5 THEN 'html' ELSE 'none' END AS converter,
  CASE WHEN doc_id % 6 = 5 THEN 'x.html' ELSE name END AS bare FROM n"""
)
def names_and_tokens(spark, sf_dir):
    from tidemark.operators.converters import ROUTES

    d = table(spark, sf_dir, "documents").withColumn("name", F.expr(NAMES))
    return d.select(
        "doc_id", fx.token_estimate("text").alias("tokens"), fx.suffix("name").alias("suffix"), F.coalesce(fx.route("name", ROUTES), F.lit("none")).alias("converter"),
        fx.fold_copy_suffix("name").alias("bare"),
    )


PATHS = "concat(lang, CASE WHEN doc_id % 5 = 0 THEN '/Draft/' ELSE '/final/' END, 'sub', CAST(doc_id % 3 AS STRING), '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '.TMP' ELSE '.txt' END)"


@query(
    f"""WITH p AS (SELECT doc_id, {PATHS} AS path FROM documents) SELECT doc_id, path, (lower(path) LIKE 'en/%' OR regexp_matches(path, '^[^/]*/[^/]*/sub[12]/[^/]*$'))
  AND NOT (lower(path) LIKE '%.tmp' OR regexp_matches(lower(path), '^[^/]*/draft/')) AS included FROM p"""
)
def glob_scope(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATHS).alias("path"))
    return d.withColumn("included", fx.in_scope("path", ["en/", "*/*/sub[12]/*"], ["*.tmp", "*/draft/"]))


@query(
    "SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT CASE WHEN length(t) <= 80 THEN t END AS term FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents), LATERAL (SELECT trim(regexp_replace(l, '\\s+', ' ', 'g')) AS t) "
    "WHERE length(t) <= 80 AND regexp_matches(t, '\\p{L}') UNION ALL SELECT unnest(regexp_extract_all(t, '\\p{L}[\\p{L}\\p{N}_''’-]{2,}')) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents), LATERAL (SELECT trim(regexp_replace(l, '\\s+', ' ', 'g')) AS t) WHERE length(t) > 80) GROUP BY 1) ORDER BY n DESC, lower(term), term LIMIT 400"
)
def term_topk(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return aggregates.top_terms(aggregates.terms(lines, "line"))


CELLS = [("o_orderkey", "o_orderkey"), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "o_totalprice"), ("o_orderdate", "o_orderdate")]


@query(
    """SELECT * FROM (SELECT 'o_orderkey' AS "column", 'int' AS type, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', 'text', count(*) FROM orders
  UNION ALL SELECT 'o_totalprice', CASE WHEN o_totalprice = floor(o_totalprice) THEN 'int' ELSE 'float' END, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderdate', 'date/time', count(*) FROM orders) WHERE n > 0"""
)
def type_histogram(spark, sf_dir):
    return aggregates.type_histogram(table(spark, sf_dir, "orders"), [c for c, _ in CELLS], "o_orderkey").select("column", "type", "n")


@query(
    "SELECT l_suppkey AS sheet, CAST(min(l_linenumber) AS INT) AS \"left\", CAST(max(l_linenumber) AS INT) AS \"right\", min(l_orderkey) AS top, max(l_orderkey) AS bottom, count(DISTINCT l_orderkey) AS \"rows\", count(DISTINCT l_linenumber) AS cols FROM lineitem GROUP BY 1"
)
def used_range(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"))
    return aggregates.used_range(cells, ["sheet"])


@query("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 60000")
def budget_prefix(spark, sf_dir):
    return aggregates.budget_prefix(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 60_000).select("source", "doc_id", "used")


@query(
    """WITH RECURSIVE q AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
  w(source, k, doc_id, used, files, taken) AS (
    SELECT source, k, doc_id, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END, CASE WHEN n_chars <= 20000 THEN 1 ELSE 0 END, n_chars <= 20000 FROM q WHERE k = 1
    UNION ALL SELECT q.source, q.k, q.doc_id, w.used + CASE WHEN w.used + n_chars <= 20000 AND files < 9 THEN n_chars ELSE 0 END, files + CASE WHEN w.used + n_chars <= 20000 AND files < 9 THEN 1 ELSE 0 END,
      w.used + n_chars <= 20000 AND files < 9 FROM q JOIN w ON q.source = w.source AND q.k = w.k + 1)
  SELECT source, doc_id, taken FROM w"""
)
def greedy_budget(spark, sf_dir):
    return aggregates.greedy_budget(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 20_000, 9)


MESSAGES = """SELECT user_id AS channel, event_id AS id, CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE event_id - event_id % 4 END AS root_id, ts AS created, ts AS modified, event_id AS seq,
  event_id % 31 = 0 AS deleted, event_type AS body FROM events"""


def messages(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events_messages")
    rows = spark.sql(MESSAGES.replace("FROM events", "FROM events_messages").replace("user_id", "CAST(1 + event_id % 3 * 0 AS BIGINT)"))
    return rows.withColumn("created", F.col("created") + F.make_dt_interval(F.col("seq").cast("int") % 97))


FEED = f"SELECT * REPLACE (created + CAST(seq % 97 AS INT) * INTERVAL 1 DAY AS created) FROM ({MESSAGES.replace('user_id', 'CAST(1 AS BIGINT)')})"


@query(
    f"""WITH m AS ({FEED}), r AS (SELECT id AS root, date_trunc('month', created) AS month FROM m WHERE root_id IS NULL),
  p AS (SELECT m.*, r.month FROM m JOIN r ON r.root = coalesce(root_id, id))
  SELECT channel, CAST(month AS TIMESTAMP) AS month, count(*) AS n, min(created) AS oldest, max(modified) AS newest,
    sha256(string_agg(concat_ws('|', CAST(id AS STRING), CAST(epoch_us(modified) AS STRING), CASE WHEN deleted THEN '' ELSE body END), chr(10) ORDER BY created, id)) AS sha FROM p GROUP BY 1, 2"""
)
def month_rollup(spark, sf_dir):
    return aggregates.month_rollup(messages(spark, sf_dir))


@query("SELECT event_type AS source_id, max(ts) AS mark, max(ts) - INTERVAL 5 MINUTE AS resume FROM events GROUP BY 1")
def high_water_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("ts").alias("modified"), "event_id")
    marks = e.where("event_id % 3 = 0").groupBy("source_id").agg(F.max("modified").alias("mark"))
    return aggregates.high_water(marks, e)


@query(
    f"""WITH m AS ({FEED}), r AS (SELECT id AS root, date_trunc('month', created) AS month FROM m WHERE root_id IS NULL), p AS (SELECT m.*, r.month FROM m JOIN r ON r.root = coalesce(root_id, id)),
  a AS (SELECT month, count(*) AS n FROM p WHERE seq % 50 <> 1 GROUP BY 1), b AS (SELECT month, count(*) AS n FROM p WHERE month = (SELECT min(month) FROM p) OR month = (SELECT max(month) FROM p) GROUP BY 1)
  SELECT CAST(1 AS BIGINT) AS channel, CAST(coalesce(b.month, a.month) AS TIMESTAMP) AS month, coalesce(b.n, a.n) AS n, CASE WHEN a.month IS NULL THEN 'new' WHEN b.month IS NULL OR a.n = b.n THEN 'kept' ELSE 'rewritten' END AS action FROM a FULL JOIN b ON a.month = b.month"""
)
def late_merge(spark, sf_dir):
    m = messages(spark, sf_dir)
    before = aggregates.month_rollup(m.where("seq % 50 <> 1"))
    every = aggregates.month_rollup(m)
    ends = every.agg(F.min("month"), F.max("month")).first()
    late = every.where(F.col("month").isin(*ends))
    return aggregates.late_merge(before, late).select("channel", "month", "n", "action")


SPANS = "SELECT user_id, event_id AS id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(event_id % 40 AS BIGINT) * 600000 AS end_ms FROM events"


def spans(spark, sf_dir):
    start = F.floor(fx.micros("ts") / 1000)
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), start.alias("start_ms"), (start + F.col("event_id") % 40 * 600000).alias("end_ms"))


MERGED = f"""s AS ({SPANS}), f AS (SELECT *, max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  g AS (SELECT *, count_if(reach IS NULL OR start_ms > reach) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS run FROM f),
  m AS (SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY user_id, run)"""


@query(f"WITH {MERGED} SELECT * FROM m")
def interval_merge(spark, sf_dir):
    return intervals.merged(spans(spark, sf_dir).drop("id"), ["user_id"])


@query(
    f"""WITH {MERGED}, l AS (SELECT user_id, max(end_ms) + 7200000 AS limit_ms FROM s GROUP BY 1), q AS (SELECT user_id, end_ms AS start_ms, coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms), limit_ms) AS end_ms FROM m JOIN l USING (user_id)
  UNION ALL SELECT user_id, 0, min(start_ms) FROM m GROUP BY 1) SELECT user_id, start_ms, end_ms FROM q WHERE end_ms - start_ms >= 3600000"""
)
def quiet_gaps(spark, sf_dir):
    s = spans(spark, sf_dir)
    limits = s.groupBy("user_id").agg((F.max("end_ms") + 7_200_000).alias("limit_ms"))
    return intervals.quiet_gaps(s, limits, ["user_id"], 3_600_000)


@query(
    f"WITH s AS ({SPANS}) SELECT a.user_id, a.id AS left_id, b.id AS right_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms FROM s a JOIN s b ON a.user_id = b.user_id AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms AND a.end_ms > a.start_ms AND b.end_ms > b.start_ms"
)
def interval_overlap(spark, sf_dir):
    s = spans(spark, sf_dir).where("end_ms > start_ms")
    return intervals.overlaps(s.where("id % 2 = 0"), s.where("id % 2 = 1"), ["user_id"], 21_600_000)


@query(
    f"""WITH s AS ({SPANS}), w AS (SELECT user_id, id, start_ms - 3600000 AS start_ms, start_ms + 3600000 AS end_ms FROM s WHERE id % 5 = 0), {MERGED.replace('s AS', 's2 AS', 1).replace('FROM s)', 'FROM s2)', 1)}
  SELECT w.user_id, w.id, CAST(coalesce(sum(least(w.end_ms, m.end_ms) - greatest(w.start_ms, m.start_ms)), 0) AS BIGINT) AS overlap_ms FROM w LEFT JOIN m ON m.user_id = w.user_id AND m.start_ms < w.end_ms AND w.start_ms < m.end_ms GROUP BY 1, 2"""
)
def overlap_length(spark, sf_dir):
    s = spans(spark, sf_dir)
    windows = s.where("id % 5 = 0").select("user_id", "id", (F.col("start_ms") - 3_600_000).alias("start_ms"), (F.col("start_ms") + 3_600_000).alias("end_ms"))
    return intervals.overlap_length(s.drop("id"), windows, ["user_id"], 21_600_000)


@query(
    f"""WITH s AS ({SPANS}), p AS (SELECT user_id, id, start_ms AS t FROM s WHERE id % 3 = 0) SELECT p.user_id, p.id, min(o.id % 4) AS owner FROM p JOIN s o ON o.user_id = p.user_id AND o.start_ms <= t AND t < o.end_ms
  GROUP BY 1, 2 HAVING count(DISTINCT o.id % 4) = 1"""
)
def point_in_interval(spark, sf_dir):
    s = spans(spark, sf_dir)
    return intervals.covering(s.where("id % 3 = 0").select("user_id", "id", F.col("start_ms").alias("at_ms")), s.select("user_id", (F.col("id") % 4).alias("owner"), "start_ms", "end_ms"), ["user_id"], 21_600_000)


@query(
    "WITH t AS (SELECT user_id, epoch_us(ts) AS tick FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, epoch_us(ts) AS tick, event_type AS value FROM events WHERE event_id % 2 = 1) "
    "SELECT t.user_id, t.tick, r.value FROM t ASOF JOIN r ON t.user_id = r.user_id AND t.tick >= r.tick"
)
def asof_label(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("tick", fx.micros("ts"))
    return intervals.as_of(e.where("event_id % 2 = 0").select("user_id", "tick"), e.where("event_id % 2 = 1").select("user_id", "tick", F.col("event_type").alias("value")), ["user_id"])


@query(
    f"""WITH s AS ({SPANS}), w AS (SELECT user_id, id, start_ms + end_ms AS m FROM s WHERE id % 3 = 0), g AS (SELECT user_id, start_ms, end_ms, concat('v', CAST(id % 7 AS STRING)) AS speaker FROM s WHERE id % 3 <> 0)
  SELECT w.user_id, w.id, arg_min(g.speaker, (greatest(2 * g.start_ms - m, m - 2 * g.end_ms, 0), g.start_ms, g.end_ms, g.speaker)) AS speaker FROM w JOIN g USING (user_id) GROUP BY 1, 2"""
)
def nearest_interval(spark, sf_dir):
    s = spans(spark, sf_dir)
    segments = s.where("id % 3 <> 0").select("user_id", "start_ms", "end_ms", F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("speaker"))
    return intervals.nearest_segment(s.where("id % 3 = 0"), segments, ["user_id"], 21_600_000)


CUES = "SELECT user_id, event_id AS seq, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 60000 AS end_ms, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS speaker, event_type AS text FROM events"


@query(
    f"""WITH c AS ({CUES}), a AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w < 28800000 THEN 0 ELSE 1 END AS brk FROM c WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, seq)),
  b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY start_ms, seq) AS turn FROM a)
  SELECT user_id, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues, string_agg(text, ' ' ORDER BY start_ms, seq) AS text FROM b GROUP BY user_id, turn"""
)
def turns(spark, sf_dir):
    start = F.floor(fx.micros("ts") / 1000)
    cues = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("seq"), start.alias("start_ms"), (start + 60_000).alias("end_ms"), F.when(F.col("event_type") == "click", "a").otherwise("b").alias("speaker"), F.col("event_type").alias("text")
    )
    return intervals.turns(cues, ["user_id"], 28_800_000)


@query(
    "WITH p AS (SELECT user_id % 9 AS voice, event_type AS label FROM events), n AS (SELECT label, voice, count(*) AS n FROM p GROUP BY 1, 2) SELECT label, voice, n, CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS label_total, CAST(sum(n) OVER (PARTITION BY voice) AS BIGINT) AS voice_total FROM n"
)
def contingency(spark, sf_dir):
    return aggregates.contingency(table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("voice"), F.col("event_type").alias("label")))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, max(value) AS best, min(event_id) AS first FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, best DESC, first) = 1")
def contingency_mode(spark, sf_dir):
    return aggregates.mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "event_id")


@query("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1")
def upper_median(spark, sf_dir):
    return aggregates.upper_median(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(
    f"WITH s AS ({SPANS}) SELECT id, w AS \"window\", w > start_ms // 86400000 AS carried FROM (SELECT *, unnest(range(start_ms // 86400000, greatest(start_ms, end_ms - 1) // 86400000 + 1)) AS w FROM s)"
)
def tumbling_windows(spark, sf_dir):
    return intervals.tumbling(spans(spark, sf_dir), ["user_id"], 86_400_000).select("id", "window", "carried")


@query(
    "WITH e AS (SELECT date_trunc('minute', ts) AS tick, event_type AS label FROM events), s AS (SELECT tick, min(label) AS label FROM e GROUP BY 1 HAVING count(*) = 1) SELECT CAST(tick AS TIMESTAMP) AS tick, label FROM s QUALIFY lag(label) OVER (ORDER BY tick) IS DISTINCT FROM label"
)
def speaking_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit(1).alias("rec"), F.date_trunc("minute", "ts").alias("tick"), F.col("event_type").alias("label"))
    return intervals.speaking_changes(e, ["rec"]).select("tick", "label")


@query(
    "WITH w AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type AS speaker, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f) AS INT) AS number FROM w"
)
def speaker_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("speaker"), F.col("ts").alias("start_ms"), F.col("event_id").alias("end_ms"), F.lit("").alias("text"))
    return intervals.numbered(e, ["user_id"])


@query(
    f"""WITH s AS ({SPANS}), r AS (SELECT id % 50 AS page, start_ms, end_ms FROM s), x AS (SELECT page, start_ms AS at_ms, 1 AS a, 0 AS b FROM r UNION ALL SELECT page, end_ms, 0, 1 FROM r) SELECT page, at_ms, CAST(sum(a) AS BIGINT) AS added, CAST(sum(b) AS BIGINT) AS removed FROM x GROUP BY 1, 2"""
)
def screen_changes(spark, sf_dir):
    rows = spans(spark, sf_dir).select((F.col("id") % 50).alias("page"), "start_ms", "end_ms")
    return intervals.screen_changes(rows, ["page"])


@query(
    "WITH k AS (SELECT doc_id AS question, CAST(quality AS STRING) AS expected, doc_id % 60 AS second, CAST(toxic AS STRING) AS category FROM labels), a AS (SELECT doc_id AS question, CASE WHEN doc_id % 5 = 0 THEN '0' ELSE '1' END AS given, (doc_id * 7) % 60 AS cited, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM documents) "
    "SELECT category, count(*) AS asked, CAST(count_if(given = expected) AS BIGINT) AS correct, CAST(count_if(cited = second) AS BIGINT) AS strict, CAST(count_if(abs(cited - second) <= 10) AS BIGINT) AS lenient, CAST(count_if(given <> expected AND confidence = 'high') AS BIGINT) AS wrong_and_sure FROM k LEFT JOIN a USING (question) GROUP BY 1"
)
def eval_scores(spark, sf_dir):
    key = table(spark, sf_dir, "labels").selectExpr("doc_id AS question", "CAST(quality AS STRING) AS expected", "doc_id % 60 AS second", "CAST(toxic AS STRING) AS category")
    answers = table(spark, sf_dir, "documents").selectExpr("doc_id AS question", "CASE WHEN doc_id % 5 = 0 THEN '0' ELSE '1' END AS given", "(doc_id * 7) % 60 AS cited", "CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence")
    return aggregates.eval_scores(answers, key)


@query(
    "WITH t AS (SELECT event_type AS platform, event_id AS tick, event_id // 5 % 3 AS truth, CASE WHEN event_id % 11 = 0 THEN 9 ELSE event_id // 5 % 3 END AS read FROM events), e AS (SELECT *, lag(truth) OVER w AS b, lead(truth) OVER w AS a FROM t WINDOW w AS (PARTITION BY platform ORDER BY tick)) "
    "SELECT platform, count(*) AS scored, CAST(count_if(truth = read) AS BIGINT) AS agreed FROM e WHERE coalesce(b = truth, true) AND coalesce(a = truth, true) GROUP BY 1"
)
def layout_agreement(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("event_type AS platform", "1 AS recording", "event_id AS tick", "event_id div 5 % 3 AS truth", "CASE WHEN event_id % 11 = 0 THEN 9 ELSE event_id div 5 % 3 END AS read")
    return aggregates.layout_agreement(t)
