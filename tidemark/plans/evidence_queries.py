"""Queries of evidence tags, screens and listings with refused folders, each with a plain SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import classify, evidence, screens
from tidemark.plans import standin
from tidemark.plans.analysis_queries import SPANS, spans
from tidemark.plans.registry import query, table
from tidemark.sources import trees

#: Every document is a line, a line of a transcript and a citation; some citations look a little beside their line.
LINES = """SELECT lang AS page, doc_id % 3 + 1 AS recording, doc_id * 7 % 3600 // 300 + 1 AS "window", doc_id * 7 % 3600 AS second,
  CASE WHEN doc_id % 2 = 0 THEN 'heard' ELSE 'seen' END AS channel, text FROM documents"""
TRANSCRIPT = "SELECT lang AS page, doc_id * 7 % 3600 + 4 AS second, lower(text) AS text FROM documents"
CITES = """SELECT doc_id AS id, lang AS page, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 9 ELSE doc_id % 3 + 1 END AS recording,
  doc_id * 7 % 3600 + CASE WHEN doc_id % 4 = 0 THEN 4 WHEN doc_id % 7 = 0 THEN 6 ELSE 0 END AS second,
  CASE WHEN doc_id % 2 = 0 THEN 'heard' ELSE 'seen' END AS channel,
  CASE WHEN doc_id % 17 = 0 THEN '- -' WHEN doc_id % 6 = 0 THEN 'no page says so' WHEN doc_id % 9 <> 0 THEN regexp_extract(text, '[A-Za-z]{5,}', 0) END AS quote FROM documents"""


@query(
    f"""WITH l AS ({LINES}), r AS (SELECT DISTINCT page, recording FROM l), w AS (SELECT DISTINCT page, recording, "window" FROM l WHERE "window" % 5 <> 0),
  c AS (SELECT id, page, recording IS NULL AS bare, coalesce(recording, 1) AS recording, second, channel, quote, second // 300 + 1 AS "window" FROM ({CITES})),
  b AS (SELECT c.*, r.page IS NULL AND NOT (bare AND channel = 'heard') AS blocked, w.page IS NOT NULL AS readable FROM c LEFT JOIN r USING (page, recording) LEFT JOIN w USING (page, recording, "window")),
  f AS (SELECT b.*, 'window' AS via, l.second AS moment, l."window" = b."window" AND l.second = b.second AS here, coalesce(contains(l.text, quote), false) AS held FROM b JOIN l ON l.page = b.page AND l.recording = b.recording AND l.channel = b.channel AND abs(l.second - b.second) <= 10
    UNION ALL SELECT b.*, 'transcript', t.second, t.second = b.second, coalesce(contains(t.text, quote), false) FROM b JOIN ({TRANSCRIPT}) t ON t.page = b.page AND b.channel = 'heard' AND abs(t.second - b.second) <= 10),
  g AS (SELECT id, bool_or(here) AS lined, bool_or(here AND via = 'window') AS in_window, bool_or(here AND held) AS quoted, bool_or(here AND held AND via = 'window') AS quoted_in_window,
    arg_min(moment, (abs(moment - second), moment)) FILTER (WHERE held AND moment <> second) AS hint FROM f GROUP BY id),
  o AS (SELECT b.id, quote, g.*, CASE WHEN blocked THEN 'no-recording' WHEN NOT coalesce(lined, false) AND NOT readable THEN 'no-window' WHEN NOT coalesce(lined, false) THEN 'no-line' WHEN quote IS NULL THEN 'resolved'
    WHEN NOT regexp_matches(quote, '[a-zA-Z0-9]') THEN 'no-words' WHEN quoted THEN 'resolved' WHEN hint IS NOT NULL THEN 'quote-elsewhere' ELSE 'quote-absent' END AS outcome FROM b LEFT JOIN g ON b.id = g.id)
  SELECT id, outcome, CASE WHEN outcome = 'no-recording' OR NOT coalesce(lined, false) THEN NULL WHEN quoted_in_window THEN 'window' WHEN quoted THEN 'transcript' WHEN in_window THEN 'window' ELSE 'transcript' END AS via,
    CASE WHEN outcome IN ('no-line', 'quote-elsewhere') AND regexp_matches(quote, '[a-zA-Z0-9]') THEN hint END AS hint FROM o"""
)
def citation_chain(spark, sf_dir):
    """Every kind of miss has a row; the twin compares each citation with all lines within reach."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("cited_documents")
    rows = lambda text: spark.sql(text.replace("//", "div").replace('"window"', "window").replace("FROM documents", "FROM cited_documents"))
    lines = rows(LINES)
    windows = lines.where("window % 5 <> 0").select("page", "recording", "window")
    return evidence.citation_chain(rows(CITES), lines.select("page", "recording"), windows, lines, rows(TRANSCRIPT))


#: Every event is a citation, a state and, under other arithmetic, a keyframe.
STATES = """SELECT event_type AS page, user_id AS recording, event_id % 12 + 1 AS "window", event_id // 12 AS state, event_id % 12 * 300 + event_id // 12 % 7 * 40 AS start_s,
  event_id % 12 * 300 + event_id // 12 % 7 * 40 + 60 + event_id % 100 AS end_s FROM events"""
KEYFRAMES = "SELECT event_type AS page, user_id AS recording, event_id // 12 AS state, event_id % 12 * 300 + event_id // 12 % 7 * 40 + event_id % 5 * 9 AS second, concat('t', CAST(event_id AS STRING)) AS frame FROM events"
TAGS = "SELECT event_id AS id, event_type AS page, user_id AS recording, event_id % 12 * 300 + event_id // 12 % 7 * 40 + event_id % 3 * 20 + CASE WHEN event_id % 8 = 0 THEN 3600 WHEN event_id % 10 = 1 THEN 170 ELSE 0 END AS second FROM events"


@query(
    f"""WITH s AS ({STATES}), k AS ({KEYFRAMES}), t AS (SELECT *, second // 300 + 1 AS "window" FROM ({TAGS})), w AS (SELECT DISTINCT page, recording, "window" FROM s),
  a AS (SELECT t.*, w.page IS NOT NULL AS readable, (SELECT max((start_s, state)) FROM s WHERE s.page = t.page AND s.recording = t.recording AND s."window" = t."window" AND t.second BETWEEN start_s AND end_s)[2] AS state FROM t LEFT JOIN w USING (page, recording, "window")),
  f AS (SELECT a.*, (SELECT max((k.second, frame)) FROM k WHERE k.page = a.page AND k.recording = a.recording AND k.state = a.state AND k.second <= a.second)[2] AS frame FROM a)
  SELECT id, CASE WHEN NOT readable THEN 'no-window' WHEN state IS NULL THEN 'no-state' WHEN frame IS NULL THEN 'no-frame' WHEN CAST(substr(frame, 2) AS BIGINT) % 4 = 0 THEN 'not-opened' ELSE 'ok' END AS outcome, state, frame FROM f"""
)
def frame_chain(spark, sf_dir):
    """The state that holds a second, its last keyframe up to it, and whether that was opened; pages hold their own names of pictures."""
    table(spark, sf_dir, "events").createOrReplaceTempView("cited_events")
    rows = lambda text: spark.sql(text.replace("//", "div").replace('"window"', "window").replace("FROM events", "FROM cited_events"))
    states, keyframes = rows(STATES), rows(KEYFRAMES)
    opened = keyframes.where("CAST(substr(frame, 2) AS BIGINT) % 4 <> 0").select("page", "frame")
    return evidence.frame_chain(rows(TAGS), states.select("page", "recording", "window"), states, keyframes, opened)


@query(
    f"""WITH r AS (SELECT user_id, CAST(id % 7 AS STRING) AS text, start_ms // 600000 * 600000 AS start_ms, CASE WHEN id % 13 <> 0 THEN end_ms // 600000 * 600000 END AS end_ms FROM ({SPANS})),
  x AS (SELECT user_id, start_ms AS at_ms, text, 1 AS d FROM r UNION ALL SELECT user_id, end_ms, text, -1 FROM r WHERE end_ms IS NOT NULL)
  SELECT user_id, at_ms, text, CASE WHEN sum(d) > 0 THEN '+' ELSE '-' END AS op, CAST(abs(sum(d)) AS BIGINT) AS n FROM x GROUP BY ALL HAVING sum(d) <> 0"""
)
def row_diffs(spark, sf_dir):
    ten = lambda c: F.floor(F.col(c) / 600_000) * 600_000
    rows = spans(spark, sf_dir).select("user_id", (F.col("id") % 7).cast("string").alias("text"), ten("start_ms").alias("start_ms"), F.when(F.col("id") % 13 != 0, ten("end_ms")).alias("end_ms"))
    return screens.row_diffs(rows, ["user_id"])


@query(
    f"""WITH r AS (SELECT user_id, start_ms, CASE WHEN id % 13 <> 0 THEN end_ms END AS end_ms FROM ({SPANS})), s AS (SELECT DISTINCT user_id, start_ms // 43200000 AS state, start_ms // 43200000 * 43200000 AS start_ms, start_ms // 43200000 * 43200000 + 43200000 AS end_ms FROM r),
  p AS (SELECT *, lag(state) OVER w AS previous, lag(start_ms) OVER w AS f, lag(end_ms) OVER w AS t FROM s WINDOW w AS (PARTITION BY user_id ORDER BY start_ms))
  SELECT p.user_id, state, previous, CAST(count_if(coalesce(r.end_ms >= p.t AND r.end_ms <= p.start_ms, false)) AS BIGINT) AS gone, CAST(count_if(r.start_ms IS NOT NULL AND (r.end_ms IS NULL OR r.end_ms > p.start_ms)) AS BIGINT) AS stayed
  FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.start_ms < p.t AND coalesce(r.end_ms > p.f, true) AND r.start_ms < p.start_ms GROUP BY ALL"""
)
def carried_over(spark, sf_dir):
    rows = spans(spark, sf_dir).select("user_id", "start_ms", F.when(F.col("id") % 13 != 0, F.col("end_ms")).alias("end_ms"))
    half = F.floor(F.col("start_ms") / 43_200_000)
    states = rows.select("user_id", half.alias("state"), (half * 43_200_000).alias("start_ms"), (half * 43_200_000 + 43_200_000).alias("end_ms")).distinct()
    return screens.carried_over(states, rows, ["user_id"], 43_200_000)


@query(
    """WITH f AS (SELECT source, doc_id % 200 AS recording, doc_id AS tick, doc_id % 3 AS layout, sha256(text) AS g, lag(sha256(text)) OVER (PARTITION BY source, doc_id % 200 ORDER BY doc_id) AS p FROM documents),
  c AS (SELECT source, recording, tick, layout, k, k % 8 AS x, k // 8 AS y, abs(ascii(substr(g, k + 1, 1)) - ascii(substr(p, k + 1, 1))) >= 12 AND CASE layout WHEN 0 THEN true WHEN 1 THEN NOT (k % 8 BETWEEN 1 AND 4 AND k // 8 BETWEEN 0 AND 2) ELSE k % 8 >= 4 AND NOT (k % 8 >= 5 AND k // 8 >= 5) END AS odd
    FROM (SELECT *, CAST(unnest(range(64)) AS BIGINT) AS k FROM f WHERE p IS NOT NULL))
  SELECT source, recording, tick, CAST(count_if(coalesce(odd, false)) AS BIGINT) AS changed, CAST(min(x) FILTER (WHERE odd) AS BIGINT) AS x0, CAST(min(y) FILTER (WHERE odd) AS BIGINT) AS y0, CAST(max(x) FILTER (WHERE odd) + 1 AS BIGINT) AS x1, CAST(max(y) FILTER (WHERE odd) + 1 AS BIGINT) AS y1
  FROM c GROUP BY ALL"""
)
def masked_changes(spark, sf_dir):
    """Digests of texts as grids of 8 x 8; layout 1 leaves out a rectangle grown by a cell, layout 2 counts half the grid less a corner."""
    masks = spark.sql(
        """SELECT CAST(1 AS BIGINT) AS layout, CAST(NULL AS array<struct<x0:double,y0:double,x1:double,y1:double>>) AS include, array(struct(0.25D AS x0, 0D AS y0, 0.5D AS x1, 0.2D AS y1)) AS exclude
        UNION ALL SELECT 2, array(struct(0.5D AS x0, 0D AS y0, 1D AS x1, 1D AS y1)), array(struct(0.8D AS x0, 0.75D AS y0, 1D AS x1, 1D AS y1))"""
    )
    frames = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 200).alias("recording"), F.col("doc_id").alias("tick"), (F.col("doc_id") % 3).alias("layout"), F.encode(F.sha2("text", 256), "us-ascii").alias("grid"))
    found = screens.masked_changes(frames, masks, ["source", "recording"], 8, 8, grow=1)
    low, high = [F.array_min(f"regions.{c}").alias(c) for c in ("x0", "y0")], [F.array_max(f"regions.{c}").alias(c) for c in ("x1", "y1")]
    return found.select("source", "recording", "tick", "changed", *low, *high)


@query(
    f"""{standin.CTES}, a AS (SELECT DISTINCT source_id, regexp_replace(rel_path, '/[^/]*$', '') AS path FROM stored),
  b AS (SELECT source_id, path, length(path) AS n FROM a WHERE path LIKE '%/f3' OR path LIKE 'fr/f_' UNION ALL SELECT DISTINCT source_id, 'de', 2 FROM a UNION ALL SELECT max(source_id), '', 0 FROM a),
  m AS (SELECT s.source_id, s.stable_id, s.rel_path FROM stored s WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.source_id = s.source_id AND o.stable_id = s.stable_id)),
  h AS (SELECT m.source_id, m.stable_id, arg_max(b.path, b.n) AS folder FROM m JOIN b ON b.source_id = m.source_id AND (b.path = '' OR starts_with(m.rel_path, b.path || '/')) GROUP BY 1, 2)
  SELECT m.*, CASE WHEN h.folder IS NULL THEN 'missing' ELSE 'unknown' END AS verdict, h.folder FROM m LEFT JOIN h USING (source_id, stable_id)"""
)
def absent_or_unknown(spark, sf_dir):
    """Rows that were not listed, under folders that were refused or left unread at three depths (one source's root among them)."""
    docs = table(spark, sf_dir, "documents")
    stored = standin.stored(docs).select("source_id", "stable_id", "rel_path")
    folders = stored.select("source_id", F.regexp_replace("rel_path", "/[^/]*$", "").alias("path")).distinct()
    status = F.when(F.col("path").rlike("/f3$"), "refused").when(F.col("path").rlike("^fr/f.$"), "unread").otherwise("listed")
    tops = folders.select("source_id", F.lit("de").alias("path"), F.lit("volume").alias("status")).distinct()
    root = folders.agg(F.max("source_id").alias("source_id")).select("source_id", F.lit("").alias("path"), F.lit("unknown").alias("status"))
    return classify.absent_or_unknown(stored, standin.observed(docs), folders.withColumn("status", status).unionByName(tops).unionByName(root))


@query(
    """WITH RECURSIVE d AS (SELECT DISTINCT source, lang, doc_id % 40 AS f, doc_id FROM documents), e AS (SELECT '/' || source AS path, '' AS up FROM d UNION SELECT '/' || source || '/' || lang, '/' || source FROM d UNION SELECT '/' || source || '/' || lang || '/' || f, '/' || source || '/' || lang FROM d),
  t AS (SELECT path FROM e WHERE up = '' UNION ALL SELECT e.path FROM e JOIN t ON e.up = t.path WHERE NOT (e.up LIKE '%/fr')),
  x AS (SELECT path, 'folder' AS kind, CASE WHEN path LIKE '%/fr' THEN 'refused' WHEN path LIKE '%/7' THEN 'gone' ELSE 'listed' END AS status FROM t)
  SELECT path, kind, status FROM x UNION ALL SELECT x.path || '/' || doc_id || '.txt', 'file', 'listed' FROM x JOIN d ON x.path = '/' || d.source || '/' || d.lang || '/' || d.f WHERE status = 'listed'"""
)
def walked_tree(spark, sf_dir):
    """A tree of documents by folder; what a refused or vanished folder holds is not reached."""
    docs = table(spark, sf_dir, "documents")
    steps = [("concat('/', source)", "lang", "folder"), ("concat('/', source, '/', lang)", "CAST(doc_id % 40 AS STRING)", "folder"), ("concat('/', source, '/', lang, '/', doc_id % 40)", "concat(doc_id, '.txt')", "file")]
    first, second, last = [docs.selectExpr(f"{up} AS parent", f"{name} AS name", f"'{kind}' AS kind").distinct() for up, name, kind in steps]
    folders = first.unionByName(second).select(F.concat("parent", F.lit("/"), "name").alias("path")).distinct()
    answers = folders.select("path", F.when(F.col("path").endswith("/fr"), "refused").when(F.col("path").endswith("/7"), "gone").otherwise("listed").alias("status"))
    return trees.walk_listed(first.select(F.col("parent").alias("path")).distinct(), first.unionByName(second).unionByName(last), answers)
