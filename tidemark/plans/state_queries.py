"""Queries of state algebra, the cycle's decisions, governance and the parts of files, over stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import nfc_fold
from tidemark.operators import aggregates, classify, cycle, governance, graph, intervals, joins, parts, quality, state
from tidemark.plans import standin, verbs
from tidemark.plans.analysis_queries import SPANS, spans
from tidemark.plans.change_queries import OUTPUTS, derived, sides
from tidemark.plans.registry import query, table
from tidemark.sources import readers, sinks

CTES = standin.CTES
KEYS = list(classify.KEYS)


def rows(spark, sf_dir, name, *exprs):
    return table(spark, sf_dir, name).selectExpr(*exprs)


@query(f"{CTES} SELECT source_id, stable_id FROM stored WHERE last_seen_run >= 6 AND lower(rel_path) LIKE 'en/%' AND NOT lower(rel_path) LIKE '%3.txt'")
def work_rows(spark, sf_dir):
    return cycle.work_rows(sides(spark, sf_dir)[1], 6, True, ["en/"], ["*3.txt"]).select(*KEYS)


@query(f"{CTES} SELECT source_id, stable_id FROM stored WHERE coalesce(CASE WHEN CAST(substr(stable_id, 2) AS BIGINT) % 4 = 0 THEN CAST(substr(stable_id, 2) AS BIGINT) % 5 END, 0) <= 2 OR content_sha256 IS NULL")
def retried_rows(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    n = F.substr("stable_id", F.lit(2)).cast("bigint")
    return cycle.retried(s, s.where(n % 4 == 0).select(*KEYS, "content_sha256", (n % 5).alias("failures"))).select(*KEYS)


@query("SELECT list_sort(list(DISTINCT x)) AS excluded, bool_or(r) AS refuse_unlabelled FROM (SELECT unnest([concat('l', CAST(n_nationkey % 7 AS STRING)), n_name]) AS x, n_nationkey = 11 AS r FROM nation)")
def merged_policies(spark, sf_dir):
    return cycle.merged_policies(rows(spark, sf_dir, "nation", "array(concat('l', n_nationkey % 7), n_name) AS excluded", "n_nationkey = 11 AS refuse_unlabelled"))


@query(f"{CTES} SELECT stable_id, CASE WHEN state = 'quarantined' AND NOT is_dir AND NOT dataless AND starts_with(state_reason, 'sec') AND CAST(substr(stable_id, 2) AS BIGINT) % 2 = 1 THEN 'error' ELSE last_verdict END AS last_verdict FROM stored")
def failures_reopened(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    return cycle.failures_reopened(s, s.where("CAST(substr(stable_id, 2) AS BIGINT) % 2 = 0"), "sec", False).select("stable_id", "last_verdict")


@query("SELECT concat('/c', CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/one' WHEN 2 THEN '/two/x' ELSE '/two/../one' END) AS path, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'listed' WHEN doc_id % 4 = 2 THEN 'empty' ELSE 'unknown' END AS answer FROM documents")
def folder_answers(spark, sf_dir):
    f = rows(spark, sf_dir, "documents", "doc_id", "concat('/c', CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/one' WHEN 2 THEN '/two/x' ELSE '/two/../one' END) AS path", "CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS children")
    answers = cycle.folder_answers(f.select("path", "children").distinct(), ["/c"], ["/c/one"])
    return f.join(answers.select("path", "answer").join(f.select("path", "children").distinct(), "path").where("(children > 0) = (answer = 'listed')"), ["path", "children"]).select("path", "doc_id", "answer")


@query(
    "WITH r AS (SELECT doc_id, source, doc_id % 4 = 0 AS online, CASE WHEN doc_id % 4 = 1 THEN doc_id % 50 END AS started, n_chars AS m, doc_id % 7 = 0 AS stub FROM documents), k AS (SELECT *, CASE WHEN NOT online AND started IS NOT NULL THEN 0 WHEN online THEN 2 WHEN stub THEN 3 ELSE 1 END AS g FROM r) "
    "SELECT CAST(row_number() OVER (ORDER BY g, CASE g WHEN 0 THEN started WHEN 2 THEN -m ELSE 0 END, length(source), concat('d', CAST(doc_id AS STRING))) AS INTEGER) AS place, source AS source_id, concat('d', CAST(doc_id AS STRING)) AS stable_id FROM k"
)
def recording_order(spark, sf_dir):
    r = rows(spark, sf_dir, "documents", "source AS source_id", "concat('d', doc_id) AS stable_id", "doc_id % 4 = 0 AS online", "CASE WHEN doc_id % 4 = 1 THEN doc_id % 50 END AS started_run", "n_chars AS mtime_ns", "doc_id % 7 = 0 AS stub", "length(source) AS source_place")
    return cycle.recording_order(r, True)


@query("SELECT user_id, event_id FROM (SELECT *, sum(event_id % 40) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE coalesce(b, 0) < 120")
def time_boxed(spark, sf_dir):
    return cycle.time_boxed(rows(spark, sf_dir, "events", "user_id", "event_id", "event_id % 40 AS s"), ["user_id"], ["event_id"], "s", 120).select("user_id", "event_id")


@query("SELECT user_id AS source_id, event_id AS chain FROM events WHERE event_id % 17 = 0 OR user_id % 3 = 0 OR event_id * 1000000000 >= user_id * 10000000000 - 300000000000")
def newest_first(spark, sf_dir):
    c = rows(spark, sf_dir, "events", "user_id AS source_id", "event_id AS chain", "CASE WHEN event_id % 17 <> 0 THEN event_id * 1000000000 END AS changed_ns")
    marks = c.select("source_id").distinct().where("source_id % 3 <> 0").selectExpr("source_id", "source_id * 10000000000 AS mark_ns")
    return cycle.newest_first(c, marks).select("source_id", "chain")


@query("WITH r AS (SELECT o_custkey AS source_id, o_orderkey AS run_id, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS newest_full, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS place FROM orders) SELECT * FROM r WHERE place <= 3")
def newest_runs(spark, sf_dir):
    r = rows(spark, sf_dir, "orders", "o_custkey AS source_id", "o_orderkey AS run_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'full_enumeration' ELSE 'delta' END AS pass_kind")
    return cycle.newest_runs(r, 3).select("source_id", "run_id", "newest_full", "place")


@query(f"{CTES}, o AS ({OUTPUTS}) SELECT output_path FROM o JOIN stored s USING (source_id, stable_id) WHERE o.status = 'tombstone' AND s.state = 'live'")
def restored_pages(spark, sf_dir):
    (o,) = derived(spark, sf_dir, OUTPUTS)
    return cycle.restored(o.where("status = 'tombstone'"), sides(spark, sf_dir)[1].where("state = 'live'"))[0].select("output_path")


@query("SELECT user_id AS source_id, CAST(event_id AS STRING) AS stable_id, event_type AS reason FROM events WHERE NOT (user_id = 13 AND event_id % 2 = 0 AND event_type = 'error')")
def queue_without_entry(spark, sf_dir):
    q = rows(spark, sf_dir, "events", "CAST(user_id AS STRING) AS source_id", "CASE WHEN event_id % 2 = 0 THEN 'even' ELSE CAST(event_id AS STRING) END AS stable_id", "event_type AS reason", "event_id")
    return cycle.without_entry(q, "13", "even", "error").selectExpr("CAST(source_id AS BIGINT) AS source_id", "CAST(event_id AS STRING) AS stable_id", "reason")


@query("SELECT doc_id AS fingerprint, n_chars AS \"at\" FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 2 = 1")
def lost_after_acceptance(spark, sf_dir):
    """Every fifth record still stands; of the lost ones those with even numbers have been accepted."""
    e = rows(spark, sf_dir, "documents", "doc_id AS fingerprint", "n_chars AS at", "'add' AS event")
    current = e.where("fingerprint % 5 = 0").select("fingerprint")
    lost = joins.lost_records(e, current)
    return joins.lost_records(cycle.accepted(e, lost.where("fingerprint % 2 = 0"), F.lit(1 << 40)), current)


@query(f"{CTES} SELECT s.source_id, CASE WHEN length(s.source_id) % 2 = 0 THEN 'graph_drive' ELSE 'local' END AS source_kind, CASE WHEN n % 3 = 0 THEN concat('a', stable_id) ELSE stable_id END AS stable_id, rel_path AS source_path, CASE WHEN length(s.source_id) % 2 = 0 THEN concat('https://h/', stable_id) END AS source_web_url FROM (SELECT *, CAST(substr(stable_id, 2) AS BIGINT) AS n FROM stored) s")
def provenance_columns(spark, sf_dir):
    s = sides(spark, sf_dir)[1].withColumn("extra", F.create_map(F.lit("web_url"), F.concat(F.lit("https://h/"), "stable_id")))
    n = F.substr("stable_id", F.lit(2)).cast("bigint")
    aliases = s.where(n % 3 == 0).select("source_id", F.concat(F.lit("a"), "stable_id").alias("old_id"), F.col("stable_id").alias("new_id"), F.lit(True).alias("origin"))
    return cycle.provenance(s, aliases, s.selectExpr("source_id", "CASE WHEN length(source_id) % 2 = 0 THEN 'graph_drive' ELSE 'local' END AS kind").distinct())


@query("SELECT concat('m/', CAST(doc_id AS STRING)) AS old_path, concat('n/', CAST(doc_id AS STRING)) AS path, sha256(concat('---', chr(10), 'kind: x', chr(10), 'source_path: to $1 ', CAST(doc_id AS STRING), chr(10), 'z: 1', chr(10), '---', chr(10), text)) AS page FROM documents")
def moved_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.expr("concat('m/', doc_id)").alias("path"), F.concat(F.lit("---\nkind: x\nsource_path: from\nz: 1\n---\n"), "text").alias("text"))
    moves = d.selectExpr("concat('m/', doc_id) AS path", "concat('n/', doc_id) AS new_path", "concat('to $1 ', doc_id) AS source_path")
    return cycle.rewritten_heads(pages, moves).select("old_path", "path", F.sha2(F.col("text").cast("binary"), 256).alias("page"))


@query("WITH b AS (SELECT event_id % 5000 AS run_id, arg_max(event_type, event_id) AS phase, max(event_id) AS last FROM events GROUP BY 1) SELECT run_id, phase FROM b WHERE phase <> 'click' AND last < 8900")
def stalled_runs(spark, sf_dir):
    b = rows(spark, sf_dir, "events", "event_id % 5000 AS run_id", "CASE WHEN event_type = 'click' THEN 'end' ELSE event_type END AS phase", "timestamp_seconds(event_id) AS at")
    return cycle.stalled(b, F.timestamp_seconds(F.lit(9000)), 100).select("run_id", "phase")


@query("SELECT concat('{\"n_name\":\"', n_name, '\",\"n_regionkey\":', CAST(n_regionkey AS STRING), '}') AS line FROM nation UNION ALL SELECT concat_ws(', ', concat('n_name: ', n_name), CASE WHEN n_regionkey > 1 THEN concat('region: ', CAST(n_regionkey AS STRING)) END) FROM nation")
def report_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return cycle.report_lines(n, ["n_name", "n_regionkey"], True).unionByName(cycle.report_lines(n.selectExpr("n_name", "CASE WHEN n_regionkey > 1 THEN n_regionkey END AS region"), ["n_name", "region"], False))


PIECES = "SELECT concat('s', CAST(l_orderkey AS STRING)) AS sha, l_linenumber AS piece, 'k' AS key FROM lineitem"


@query("SELECT concat('s', CAST(l_orderkey AS STRING)) AS sha, count(*) AS pieces, CAST(count_if(l_returnflag <> 'R') AS BIGINT) AS finished, count(*) = count_if(l_returnflag <> 'R') AS complete FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def pieces_progress(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    wanted = li.selectExpr("concat('s', l_orderkey) AS sha", "l_linenumber AS piece", "'k' AS key", "l_returnflag <> 'R' AS done")
    held = wanted.unionByName(wanted.selectExpr("sha", "piece", "'other' AS key", "true AS done"))
    return cycle.pieces_progress(wanted.drop("done"), held)


@query("SELECT concat('s', CAST(l_orderkey AS STRING)) AS sha, l_linenumber AS piece FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) WHERE f = 'R'")
def pieces_left(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    wanted = li.selectExpr("concat('s', l_orderkey) AS sha", "l_linenumber AS piece", "'k' AS key", "f <> 'R' AS done")
    return cycle.pieces_left(wanted.drop("done"), wanted).select("sha", "piece")


@query(f"{CTES} SELECT source_id, stable_id FROM stored WHERE stable_id LIKE 'd_%7'")
def withheld_rows(spark, sf_dir):
    return cycle.withheld_suffixes(sides(spark, sf_dir)[1], ["7.txt", ".msg"], True).select(*KEYS)


@query(f"{CTES} SELECT source_id, stable_id FROM stored WHERE rel_path LIKE 'en/%'")
def purge_selected(spark, sf_dir):
    return governance.selected(sides(spark, sf_dir)[1], "path", "en/").select(*KEYS)


@query(f"{CTES} SELECT s.source_id, stable_id, CASE WHEN s.source_id <> 'src2' THEN 'local' END AS kind, CASE WHEN s.source_id <> 'src2' THEN 'live' END AS config_state FROM stored s")
def governance_read(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    sources = s.select("source_id").distinct().where("source_id <> 'src2'").selectExpr("source_id", "'local' AS kind", "'live' AS config_state")
    return joins.governance_rows(s, sources).select(*KEYS, "kind", "config_state")


@query(f"{CTES} SELECT source_id, stable_id, size FROM stored WHERE CAST(substr(stable_id, 2) AS BIGINT) IN (SELECT o_orderkey FROM orders)")
def rows_by_id(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    ids = s.select(*KEYS).join(rows(spark, sf_dir, "orders", "concat('d', o_orderkey) AS stable_id"), "stable_id")
    return joins.by_ids(s, ids).select(*KEYS, "size")


@query(f"{CTES} SELECT stable_id FROM stored WHERE stable_id > 'd5' ORDER BY stable_id LIMIT 40")
def next_page(spark, sf_dir):
    return joins.keyset_page(sides(spark, sf_dir)[1], "d5", 40).select("stable_id")


@query(f"{CTES} SELECT stable_id, CASE WHEN n % 4 = 0 THEN concat('c', stable_id) ELSE content_sha256 END AS content_sha256, CASE WHEN n % 4 = 0 THEN 'changed' ELSE last_verdict END AS last_verdict FROM (SELECT *, CAST(substr(stable_id, 2) AS BIGINT) AS n FROM stored)")
def contents_set(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    read = s.where("CAST(substr(stable_id, 2) AS BIGINT) % 4 = 0").select(*KEYS, F.concat(F.lit("c"), "stable_id").alias("content_sha256"), F.lit("h").alias("canonical_sha256"), F.lit("bytes@1").alias("canonical_method"), F.lit("changed").alias("verdict"))
    return state.set_content(s, read).select("stable_id", "content_sha256", "last_verdict")


@query(
    "SELECT coalesce(a.k, b.k) AS source_id, CASE WHEN b.k IS NOT NULL THEN 'paused' ELSE 'live' END AS config_state, CASE WHEN b.k IS NOT NULL THEN b.f ELSE a.f END AS config_fingerprint, a.k IS NOT NULL AND NOT (b.k IS NOT NULL AND a.f <> b.f) AS baseline_complete "
    "FROM (SELECT n_name AS k, CAST(n_regionkey AS STRING) AS f FROM nation WHERE n_nationkey % 3 <> 0) a FULL JOIN (SELECT n_name AS k, CAST(n_nationkey % 5 AS STRING) AS f FROM nation WHERE n_nationkey % 4 <> 0) b ON a.k = b.k"
)
def sources_upserted(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    have = schemas.conform(n.where("n_nationkey % 3 <> 0").selectExpr("n_name AS source_id", "'local' AS kind", "'live' AS config_state", "CAST(n_regionkey AS STRING) AS config_fingerprint", "true AS enumeration_complete", "true AS baseline_complete"), schemas.SOURCE)
    configured = n.where("n_nationkey % 4 <> 0").selectExpr("n_name AS source_id", "'local' AS kind", "'paused' AS config_state", "CAST(n_nationkey % 5 AS STRING) AS config_fingerprint")
    return state.upsert_sources(have, configured)[0].select("source_id", "config_state", "config_fingerprint", "baseline_complete")


@query(f"{CTES} SELECT stable_id, CASE WHEN CAST(substr(stable_id, 2) AS BIGINT) % 2 = 0 THEN coalesce(absent_since_run, 9) END AS absent_since_run FROM stored")
def absences_marked(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    return state.mark_absent(s, s.where("CAST(substr(stable_id, 2) AS BIGINT) % 2 = 0"), 9).select("stable_id", "absent_since_run")


@query(
    f"""{CTES}, w AS (SELECT source_id, stable_id, CASE WHEN n % 41 = 0 THEN 'provider' WHEN parent_id = 'p3' THEN 'below-deleted-folder' WHEN n % 11 = 0 THEN 'scope-change' WHEN n % 5 = 0 AND source_id <> 'src1' THEN 'absent' END AS why
  FROM (SELECT *, CAST(substr(stable_id, 2) AS BIGINT) AS n FROM stored) WHERE state <> 'tombstone') SELECT * FROM w WHERE why IS NOT NULL"""
)
def removals(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    n = F.substr("stable_id", F.lit(2)).cast("bigint")
    folder = s.select("source_id").distinct().select("source_id", F.lit("p3").alias("stable_id"))
    explicit = s.where(n % 41 == 0).select(*KEYS).unionByName(folder)
    breaker = s.select("source_id").distinct().select("source_id", (F.col("source_id") == "src1").alias("tripped"))
    return state.removals(s, explicit, s.where(n % 5 == 0).select(*KEYS), s.where(n % 11 == 0).select(*KEYS), breaker)


@query(f"WITH o AS ({OUTPUTS}) SELECT concat('archive/', source, '/', CAST(doc_id AS STRING), '.md') AS path, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0")
def archived_copies(spark, sf_dir):
    (o,) = derived(spark, sf_dir, OUTPUTS)
    d = table(spark, sf_dir, "documents")
    removed = d.selectExpr("source AS source_id", "concat('d', doc_id) AS stable_id", "CASE doc_id % 6 WHEN 0 THEN 'provider' WHEN 3 THEN 'below-deleted-folder' ELSE 'absent' END AS why")
    return verbs.archive(o, d.selectExpr("concat('mirror/', source, '/', doc_id, '.md') AS path", "text"), removed).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("SELECT concat('d', CAST(doc_id AS STRING)) AS stable_id, 'whole' AS unit_id, 'gone' AS side FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), CASE WHEN doc_id % 4 = 0 THEN 'index' ELSE 'whole' END, 'now' FROM documents")
def outputs_replaced(spark, sf_dir):
    (o,) = derived(spark, sf_dir, OUTPUTS)
    made = o.where("CAST(substr(stable_id, 2) AS BIGINT) % 4 = 0").withColumn("unit_id", F.lit("index"))
    now, gone = state.replace_outputs(o, made)
    return gone.select("stable_id", "unit_id", F.lit("gone").alias("side")).unionByName(now.select("stable_id", "unit_id", F.lit("now").alias("side")))


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderkey = 7 THEN 'sync' ELSE 'poll' END AS mode, CASE WHEN o_orderkey = 7 THEN 'ok' ELSE o_orderstatus END AS outcome FROM orders")
def run_ledger(spark, sf_dir):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    runs = schemas.conform(rows(spark, sf_dir, "orders", "o_orderkey AS run_id", "'poll' AS mode", "o_orderstatus AS outcome"), schemas.RUN)
    return verbs.finish_run(verbs.begin_run(runs, 7, "sync", now), 7, "ok", now).select("run_id", "mode", "outcome")


@query("SELECT n_name AS source_id, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS current_token, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 THEN 'new' END AS pending_token FROM nation")
def cursors_promoted(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    have = schemas.conform(n.selectExpr("n_name AS source_id", "'old' AS current_token"), schemas.CURSOR)
    staged = state.stage_cursors(have, n.where("n_nationkey % 3 = 0").selectExpr("n_name AS source_id", "'new' AS token"), 5)
    odd = n.where("n_nationkey % 2 = 1").selectExpr("n_name AS source_id")
    mine, later = staged.join(odd, "source_id", "left_anti"), staged.join(odd, "source_id", "left_semi")
    return state.promote_cursors(mine, 5, True).unionByName(later).select("source_id", "current_token", "pending_token")


@query("SELECT n_name AS source_id, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-01-08 00:00:00' WHEN n_nationkey % 3 = 2 THEN TIMESTAMP '2023-12-31 00:00:00' END AS until, n_nationkey % 3 = 0 AS active FROM nation")
def breaker_states(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    sources = schemas.conform(n.selectExpr("n_name AS source_id", "'local' AS kind", "TIMESTAMP '2023-12-31 00:00:00' AS breaker_until", "TIMESTAMP '2023-12-24 00:00:00' AS breaker_tripped_at"), schemas.SOURCE)
    passes = n.where("n_nationkey % 3 < 2").selectExpr("n_name AS source_id", "CAST(40 AS BIGINT) AS candidates", "n_nationkey % 3 = 0 AS tripped")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    held = state.breaker_state(sources, passes, now)
    active = state.breaker_active(held, now).select("source_id", F.lit(True).alias("active"))
    return held.join(active, "source_id", "left").select("source_id", F.col("breaker_until").cast("timestamp_ntz").alias("until"), F.coalesce("active", F.lit(False)).alias("active"))


@query(f"{CTES}, o AS ({OUTPUTS}) SELECT source_id, stable_id FROM o WHERE (source_id, stable_id) NOT IN (SELECT (source_id, stable_id) FROM stored WHERE state = 'quarantined')")
def forgotten(spark, sf_dir):
    return state.forget(derived(spark, sf_dir, OUTPUTS)[0], sides(spark, sf_dir)[1].where("state = 'quarantined'")).select(*KEYS)


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'adopt' ELSE 'discard' END AS action FROM orders WHERE o_orderstatus = 'O'")
def recovered_runs(spark, sf_dir):
    runs = rows(spark, sf_dir, "orders", "o_orderkey AS run_id", "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at")
    return state.runs_recovered(runs, runs.where("run_id % 5 = 0"))


@query("WITH RECURSIVE c AS (SELECT event_id AS k, event_id // 3 AS p FROM events WHERE event_id > 0), w(k) AS (SELECT max(event_id) - 5 FROM events UNION SELECT p FROM w JOIN c USING (k)) SELECT concat('c', CAST(k AS STRING)) AS commit FROM w")
def ancestors(spark, sf_dir):
    c = rows(spark, sf_dir, "events", "concat('c', event_id) AS commit", "CASE WHEN event_id > 0 THEN concat('c', CAST(floor(event_id / 3) AS BIGINT)) END AS parent")
    head = table(spark, sf_dir, "events").agg(F.concat(F.lit("c"), (F.max("event_id") - 5).cast("string")).alias("commit"))
    return graph.ancestor_closure(c, head)


@query("SELECT n_name, CASE WHEN n_nationkey % 2 = 1 THEN 'configured' WHEN n_regionkey = 0 THEN 'baseline' WHEN n_nationkey > 15 THEN 'fresh' ELSE 'done' END AS step FROM nation")
def first_unmet_rule(spark, sf_dir):
    rules = [("configured", F.col("n_nationkey") % 2 == 0), ("baseline", F.when(F.col("n_regionkey") == 0, None).otherwise(F.lit(True))), ("fresh", F.col("n_nationkey") <= 15)]
    return table(spark, sf_dir, "nation").select("n_name", graph.first_unmet(rules).alias("step"))


@query(
    "SELECT l_orderkey AS slide, l_linenumber AS id, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY t) AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY t, l, u, l_linenumber) AS INTEGER) AS place FROM (SELECT l_orderkey, l_linenumber, min(CAST(l_quantity AS INTEGER) % 3) AS t, min(l_partkey % 10) AS l, min(CAST(l_quantity AS INTEGER) % 3) AS u FROM lineitem GROUP BY 1, 2)"
)
def slide_order(spark, sf_dir):
    shapes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("slide"), F.col("l_linenumber").alias("id")).agg(F.min(F.col("l_quantity").cast("int") % 3).alias("top"), F.min(F.col("l_partkey") % 10).alias("left"))
    return parts.slide_order(shapes, ["slide"])


@query("SELECT l_orderkey AS chart, l_returnflag AS series, l_linenumber AS idx, concat('c', CAST(l_linenumber AS STRING)) AS category, arg_min(l_partkey, (l_partkey, l_suppkey)) AS value FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3")
def chart_tables(spark, sf_dir):
    points = rows(spark, sf_dir, "lineitem", "l_orderkey AS chart", "l_returnflag AS series", "l_linenumber AS idx", "l_partkey AS value", "struct(l_partkey, l_suppkey) AS seq")
    names = points.select("chart", "idx").distinct().where("idx <= 4").selectExpr("chart", "idx", "concat('c', idx) AS category")
    return parts.chart_table(points, ["chart"], names).select("chart", "series", "idx", "category", "value")


@query("SELECT user_id, event_type AS text, min(event_id) AS place FROM events GROUP BY 1, 2")
def first_places(spark, sf_dir):
    return parts.first_places(rows(spark, sf_dir, "events", "user_id", "event_type AS text", "event_id AS place"), ["user_id"])


@query("WITH RECURSIVE c AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id - event_id % 10 + event_id % 10 // 2 END AS parent FROM events), w AS (SELECT id, id AS root, 0 AS level FROM c WHERE parent IS NULL UNION ALL SELECT c.id, root, level + 1 FROM w JOIN c ON c.parent = w.id) SELECT id, root, CAST(level AS INTEGER) AS level FROM w")
def comment_threads(spark, sf_dir):
    return parts.comment_threads(rows(spark, sf_dir, "events", "event_id AS id", "CASE WHEN event_id % 10 <> 0 THEN event_id - event_id % 10 + CAST(floor(event_id % 10 / 2) AS BIGINT) END AS parent"))


@query("SELECT source AS file, CASE WHEN length(regexp_replace(t, '\\s+', '', 'g')) < 20 THEN 'scanned' ELSE 'text' END AS outcome, count(*) AS n FROM (SELECT source, CASE WHEN doc_id % 3 = 0 THEN '  a b ' ELSE text END AS t FROM documents) GROUP BY 1, 2")
def scanned_pages(spark, sf_dir):
    return parts.scanned_pages(rows(spark, sf_dir, "documents", "source AS file", "CASE WHEN doc_id % 3 = 0 THEN '  a b ' ELSE text END AS text"))


@query("SELECT concat('p', CAST(doc_id AS STRING)) AS page, concat('  - path: p', CAST(doc_id AS STRING), chr(10), '    sha: ', sha256(text), chr(10), '    role: source', chr(10)) AS stub FROM documents")
def citation_stubs(spark, sf_dir):
    return parts.citation_stub(table(spark, sf_dir, "documents").select(F.expr("concat('p', doc_id)").alias("page"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))


@query("SELECT 'index-budget' AS rule, concat('i', CAST(doc_id AS STRING)) AS path, CAST(len(string_split(text, chr(10))) AS STRING) AS detail, false AS blocking FROM documents WHERE strlen(text) > 3000 OR len(string_split(text, chr(10))) > 12")
def index_findings(spark, sf_dir):
    return quality.index_findings(rows(spark, sf_dir, "documents", "concat('i', doc_id) AS path", "text"), 3000, 12)


@query("SELECT CAST(count_if(doc_id % 8 = 0) AS BIGINT) AS blocking, CAST(count_if(doc_id % 8 = 4) AS BIGINT) AS advisory FROM documents")
def land_gate(spark, sf_dir):
    f = rows(spark, sf_dir, "documents", "'r' AS rule", "concat('p', doc_id) AS path", "'' AS detail", "doc_id % 8 = 0 AS blocking", "doc_id")
    changed = f.where("doc_id % 4 = 0").select("path")
    return quality.gate(quality.checkpoint_blockers(f.drop("doc_id"), changed))


@query("SELECT concat('p', CAST(doc_id AS STRING)) AS path, 'adopted in run 4' AS provenance FROM documents WHERE doc_id % 5 = 2")
def adopted_pages(spark, sf_dir):
    p = rows(spark, sf_dir, "documents", "concat('p', doc_id) AS path", "doc_id")
    return quality.adopted(p, p.where("doc_id % 5 <> 2"), 4).select("path", "provenance")


@query("SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT contains(l, 'the') AND NOT contains(l, 'und')), chr(10))) AS left_over FROM documents")
def scrubbed_lines(spark, sf_dir):
    s = governance.scrubbed(rows(spark, sf_dir, "documents", "doc_id", "text"), ["the", "und"])
    return s.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("left_over"))


@query(
    """WITH e AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + event_id % 40 * 60000 AS end_ms, event_id % 3 AS voice FROM events),
  k AS (SELECT start_ms // 2000 AS tick, min(concat('L', CAST(id % 3 AS STRING))) AS label FROM e GROUP BY 1 HAVING count(DISTINCT id % 3) = 1),
  s AS (SELECT e.id, e.voice, k.label, count(*) AS n FROM e JOIN k ON k.tick >= CAST(ceil(start_ms / 2000.0) AS BIGINT) AND k.tick < CAST(ceil(end_ms / 2000.0) AS BIGINT) GROUP BY ALL),
  m AS (SELECT id, voice, arg_min(label, (-n, label)) AS top FROM s GROUP BY 1, 2) SELECT id FROM m WHERE voice < 2 AND top <> concat('L', CAST(voice AS STRING))"""
)
def vetoed_lines(spark, sf_dir):
    """Lines of some minutes, each beginning with a lit label of its own."""
    lines = spans(spark, sf_dir).select("id", "start_ms", (F.col("start_ms") + F.col("id") % 40 * 60000).alias("end_ms"), (F.col("id") % 3).alias("voice"))
    lit = lines.select(F.floor(F.col("start_ms") / 2000).alias("tick"), F.concat(F.lit("L"), "voice").alias("label"))
    names = spark.createDataFrame([(0, "L0", "named"), (1, "L1", "named"), (2, "L2", "mixed")], "voice bigint, label string, form string")
    return intervals.vetoed(lines, lit, names)


@query("SELECT l_orderkey AS recording, a AS start_ms, b AS end_ms FROM (SELECT l_orderkey, min(f) * 20 AS a, (max(f) + 1) * 20 AS b FROM (SELECT l_orderkey, f, f - row_number() OVER (PARTITION BY l_orderkey ORDER BY f) AS i FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber * 40 + k AS BIGINT) AS f, l_linenumber FROM lineitem, range(40) r(k)) WHERE l_linenumber % 3 <> 0) GROUP BY l_orderkey, i) WHERE b - a >= 500")
def silent_runs(spark, sf_dir):
    li = rows(spark, sf_dir, "lineitem", "l_orderkey AS recording", "l_linenumber").distinct()
    frames = li.select("recording", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"), "l_linenumber").selectExpr("recording", "CAST(l_linenumber * 40 + k AS BIGINT) AS frame", "CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1000000000 ELSE 100 END AS BIGINT) AS energy", "CAST(320 AS BIGINT) AS samples")
    return intervals.silent_runs(frames, ["recording"])


@query("SELECT concat('m/', CAST(doc_id AS STRING), '.md') AS path, sha256(concat('---', chr(10), 'kind: text', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('title: t', CAST(doc_id AS STRING), chr(10)) ELSE '' END, '---', chr(10), text)) AS page FROM documents WHERE doc_id % 3 <> 0")
def changed_pages(spark, sf_dir):
    pages = sinks.page_text(rows(spark, sf_dir, "documents", "concat('m/', doc_id, '.md') AS path", "text AS body", "'text' AS kind", "CASE WHEN doc_id % 2 = 0 THEN concat('t', doc_id) END AS title"))
    same = F.regexp_extract("path", r"([0-9]+)", 1).cast("bigint") % 3 == 0
    return sinks.changed_pages(pages, pages.select("path", F.when(same, F.col("text")).otherwise("old").alias("text"))).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("page"))


@query(f"WITH o AS ({OUTPUTS}) SELECT output_path AS path, sha256('---\nstatus: deleted\n---\n# Deleted\n\nThe source was deleted on 2024-01-02 (provider). This notice goes on 2024-06-30.\n') AS page FROM o WHERE status = 'tombstone'")
def tombstone_pages(spark, sf_dir):
    (o,) = derived(spark, sf_dir, OUTPUTS)
    t = state.tombstones_written(o.where("status = 'tombstone'").withColumn("reason", F.lit("provider")), 3, F.lit("2024-01-02").cast("date"))
    return sinks.tombstone_pages(t).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("page"))


@query("SELECT o_custkey AS run_id, concat('p', CAST(o_orderkey AS STRING)) AS path, 'github-token' AS rule FROM orders WHERE o_orderkey % 9 = 0")
def history_secrets(spark, sf_dir):
    said = "CASE WHEN o_orderkey % 9 = 0 THEN concat('x ghp_', repeat('A', 36)) ELSE 'clean' END"
    return governance.history_secrets(rows(spark, sf_dir, "orders", "o_custkey AS run_id", "concat('p', o_orderkey) AS path", f"{said} AS text"))


@query("SELECT o_orderkey AS seq, concat('p', CAST(o_orderkey % 50 AS STRING)) AS path FROM orders WHERE o_orderkey % 50 IN (3, 5)")
def carried_changes(spark, sf_dir):
    c = rows(spark, sf_dir, "orders", "o_orderkey AS seq", "concat('p', o_orderkey % 50) AS path")
    return governance.carried_changes(c, c.where("path IN ('p3', 'p5')").select("path"))


@query(f"{CTES} SELECT source_id, parent_id AS stable_id FROM observed GROUP BY ALL")
def missing_ancestors(spark, sf_dir):
    o, s = sides(spark, sf_dir)
    return readers.missing_ancestors(o, s)


@query(f"{CTES} SELECT source_id, stable_id FROM observed o WHERE is_dir AND NOT deleted AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id = o.source_id AND s.stable_id = o.stable_id)")
def new_folders(spark, sf_dir):
    return readers.new_folders(*sides(spark, sf_dir))


@query("SELECT concat('d', CAST(doc_id AS STRING)) AS stable_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS BIGINT) AS size, doc_id % 5 = 0 AS is_dir, CASE WHEN doc_id % 5 <> 0 THEN 'c2' END AS ctag, doc_id % 7 = 0 AS deleted, 1704067200000000000 + 5000000 AS mtime_ns FROM documents WHERE doc_id % 11 <> 0 AND (doc_id % 7 <> 0 OR doc_id % 2 = 0)")
def drive_feed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    none = F.lit(None)
    record = lambda seq, tag: d.select(
        F.expr("concat('d', doc_id)").alias("id"), F.expr("concat('n', doc_id)").alias("name"), F.col("n_chars").cast("bigint").alias("size"), F.lit(tag).alias("cTag"), F.lit("e").alias("eTag"), F.lit("2024-01-01T00:00:00.005Z").alias("lastModifiedDateTime"),
        F.struct(F.lit("root").alias("id"), F.lit("dr").alias("driveId")).alias("parentReference"), none.cast("struct<hashes:struct<quickXorHash:string,sha1Hash:string,sha256Hash:string>,mimeType:string>").alias("file"),
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit(2).cast("bigint").alias("childCount"))).alias("folder"), none.cast("struct<x:string>").alias("root"),
        F.when((F.col("doc_id") % 7 == 0) & F.lit(seq == 2), F.struct(F.lit("deleted").alias("state"))).alias("deleted"), F.when(F.col("doc_id") % 11 == 0, F.struct(F.lit("r").alias("id"))).alias("remoteItem"), F.lit(seq).alias("seq"),
    )
    known = d.where("doc_id % 2 = 0").selectExpr("'s' AS source_id", "concat('d', doc_id) AS stable_id")
    return readers.drive_feed(record(1, "c1").unionByName(record(2, "c2")), known, "s", False).select("stable_id", "size", "is_dir", "ctag", "deleted", "mtime_ns")


@query("SELECT concat('ch', CAST(conv_id AS STRING)) AS channel_id, '2024-01' AS month, concat('m', CAST(turn AS STRING)) AS id, sha256(text) AS body FROM conversations")
def month_messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.expr("concat('m', turn)").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("body"))).alias("messages"))
    return readers.month_messages(m.select(F.expr("concat('ch', conv_id)").alias("channel_id"), F.lit("2024-01").alias("month"), "messages"))


FOLDED = "concat(CASE doc_id % 4 WHEN 0 THEN 'Straße' WHEN 1 THEN 'STRASSE' WHEN 2 THEN 'Cafe\u0301' ELSE 'CAFÉ' END, CAST(doc_id % 15 AS STRING), '.md')"
KEY = "replace(lower(nfc_normalize(p)), 'ß', 'ss')"


def folded_names(spark, sf_dir):
    return rows(spark, sf_dir, "documents", "doc_id", "source AS source_id", "concat('d', doc_id) AS stable_id", f"{FOLDED} AS path")


@query(f"WITH n AS (SELECT DISTINCT p FROM (SELECT {FOLDED} AS p FROM documents)) SELECT {KEY} AS key, count(*) AS spellings FROM n GROUP BY 1 HAVING count(*) > 1")
def folded_collisions(spark, sf_dir):
    return aggregates.collision_groups(folded_names(spark, sf_dir).select("path").distinct()).select("key", "spellings")


@query(f"WITH n AS (SELECT doc_id, {FOLDED} AS p FROM documents) SELECT doc_id AS page_id FROM n WHERE {KEY} NOT LIKE 'strasse1%'")
def folded_orphans(spark, sf_dir):
    n = folded_names(spark, sf_dir).selectExpr("doc_id AS page_id", "path AS page")
    owned = spark.createDataFrame([(f"Straße{k}.MD",) for k in (1, *range(10, 20))], "output_path string")
    return joins.orphan_pages(n, owned).select("page_id")


@query(
    f"""WITH n AS (SELECT source AS source_id, concat('d', CAST(doc_id AS STRING)) AS stable_id, doc_id % 9 = 0 AS mine, {FOLDED} AS p FROM documents), k AS (SELECT *, {KEY} AS key FROM n), o AS (SELECT DISTINCT key FROM k WHERE mine),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_id, stable_id) AS i FROM k WHERE NOT mine)
  SELECT stable_id, lower(p) AS path FROM k WHERE mine UNION ALL SELECT stable_id, CASE WHEN i = 1 AND key NOT IN (SELECT key FROM o) THEN p ELSE concat(substr(p, 1, length(p) - 3), '-', substr(sha256(stable_id), 1, 8), '.md') END FROM r"""
)
def sticky_paths(spark, sf_dir):
    n = folded_names(spark, sf_dir)
    return parts.allocated_paths(n.select(*KEYS, "path"), n.where("doc_id % 9 = 0").select(*KEYS, F.lower("path").alias("path"))).select("stable_id", "path")


@query(f"WITH n AS (SELECT doc_id, {FOLDED} AS p FROM documents) SELECT doc_id, {KEY} AS key FROM n")
def path_folds(spark, sf_dir):
    return folded_names(spark, sf_dir).select("doc_id", nfc_fold("path").alias("key"))


@query("SELECT concat('n', CAST(doc_id AS STRING)) AS new_id, concat('o', CAST(doc_id AS STRING)) AS old_id FROM documents WHERE doc_id % 3 <> 0")
def composed_saves(spark, sf_dir):
    row = lambda who, name, dec: table(spark, sf_dir, "documents").selectExpr("'s' AS source_id", f"concat('{who}', doc_id) AS stable_id", f"concat({name}, doc_id) AS rel_path", "false AS is_dir", "false AS deleted", "'live' AS state", "CAST(4 AS BIGINT) AS last_seen_run", "doc_id")
    return classify.safe_saves(row("n", "'café'", 0), row("o", "'cafe\u0301'", 1).where("doc_id % 3 <> 0")).select("new_id", "old_id")


@query(
    """WITH d AS (SELECT doc_id AS k, concat('t/', CAST(doc_id % 20 AS STRING)) AS path, CASE doc_id % 4 WHEN 0 THEN 'decisions' WHEN 1 THEN 'action items' WHEN 2 THEN 'numbers shown' ELSE 'people' END AS s, concat(CASE doc_id % 4 WHEN 0 THEN 'decisions' WHEN 1 THEN 'action items' WHEN 2 THEN 'numbers shown' ELSE 'people' END, ' ', CAST(doc_id AS STRING)) AS w FROM documents)
  SELECT 'CITE-UNRESOLVED' AS rule, path, w || CASE WHEN k % 3 = 0 THEN ': no line' ELSE ': no unit' END AS detail, false AS blocking FROM d WHERE s <> 'people' AND s <> 'action items' AND k % 3 <> 1
  UNION ALL SELECT 'CITE-QUOTE', path, w, false FROM d WHERE s IN ('decisions', 'numbers shown') AND k % 3 = 1 AND k % 5 = 0
  UNION ALL SELECT 'CITE-MISSING', path, w, false FROM d WHERE s = 'action items' AND k % 7 = 0
  UNION ALL SELECT 'CITE-FRAME', path, w, false FROM d WHERE s = 'numbers shown' AND k % 3 <> 1
  UNION ALL SELECT 'CITE-INFERRED', path, w, false FROM d WHERE s = 'action items' AND (k % 7 = 0 OR k % 2 = 0 OR k % 9 = 0)
  UNION ALL SELECT 'CITE-BASIS', path, w, false FROM d WHERE s = 'people' AND k % 5 = 1
  UNION ALL SELECT 'CITE-SHARED', path, w, false FROM d WHERE s = 'people' AND k % 5 = 2"""
)
def evidence_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    section = F.element_at(F.array(*[F.lit(x) for x in ("decisions", "action items", "numbers shown", "people")]), (k % 4 + 1).cast("int"))
    tag = lambda kind, quote: F.struct(kind.alias("kind"), F.lit(1).cast("bigint").alias("recording"), F.when(k % 3 == 2, 999_999).when(k % 3 == 1, 10).otherwise(11).cast("bigint").alias("second"), quote.alias("quote"))
    quote = F.when(k % 5 == 0, "not ... said").otherwise("so ... it is")
    tags = F.when(section == "people", F.array().cast("array<struct<kind:string,recording:bigint,second:bigint,quote:string>>")).when(section == "action items", F.array(tag(F.lit("inferred"), F.lit(None).cast("string"))))
    tags = tags.when(section == "decisions", F.array(tag(F.lit("heard"), quote))).otherwise(F.array(tag(F.lit("seen+frame"), quote)))
    refs = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 9 == 0, F.array(F.lit("D9"))).otherwise(F.array(F.concat(F.lit("D"), (k % 2).cast("string"))))
    basis = F.element_at(F.array(*[F.lit(x) for x in ("VOICE line", "a guess", "voice 2, on shared audio of Ann, 3 voices", "mixed", "Voice 4, unidentified")]), (k % 5 + 1).cast("int"))
    page = F.concat(F.lit("t/"), (k % 20).cast("string"))
    rows_ = d.select(page.alias("path"), section.alias("section"), k.alias("row"), tags.alias("tags"), basis.alias("basis"), F.lit("ann").alias("person"), refs.alias("refs"), F.lit(False).alias("noted"))
    units = spark.createDataFrame([(1, 1)], "recording bigint, window bigint")
    lines = spark.createDataFrame([(1, 10, c, "so, said Ann, it is") for c in ("heard", "seen")], "recording bigint, second bigint, channel string, text string")
    decided = d.select(page.alias("path")).distinct().withColumn("id", F.lit("D1"))
    opened = d.select(page.alias("path")).distinct().select("path", F.lit(1).cast("bigint").alias("recording"), F.lit(10).cast("bigint").alias("second"))
    return quality.evidence_findings(rows_, units, lines, decided, opened)
