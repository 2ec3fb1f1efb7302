"""Queries of change detection and state, over stand-in listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates, classify, joins, state
from tidemark.plans import standin
from tidemark.plans.registry import query, table
from tidemark.plans.standin import CTES, WRITTEN_AT

RUNGS = f"""
j AS (
  SELECT o.source_id, o.stable_id, o.rel_path, o.name, o.parent_id, o.is_dir, o.deleted, o.dataless, o.quickxor, o.sha1, o.ctag, o.etag, o.size, o.mtime_ns, o.ctime_ns, o.ino, o.mode, o.gen_count,
    s.stable_id AS sid, s.rel_path AS spath, s.name AS sname, s.parent_id AS sparent, s.quickxor AS squick, s.sha1 AS ssha1, s.ctag AS sctag, s.etag AS setag, s.size AS ssize, s.mtime_ns AS smtime,
    s.ctime_ns AS sctime, s.ino AS sino, s.mode AS smode, s.gen_count AS sgen, s.state AS sstate, s.last_verdict AS slast, s.content_sha256 AS scontent
  FROM observed o LEFT JOIN stored s ON o.source_id = s.source_id AND o.stable_id = s.stable_id
), rung AS (
  SELECT *, CASE
    WHEN dataless THEN 'dataless|dataless'
    WHEN quickxor = squick THEN 'unchanged|quickxor-equal' WHEN quickxor <> squick THEN 'maybe_changed|quickxor-differs'
    WHEN sha1 = ssha1 THEN 'unchanged|sha1-equal' WHEN sha1 <> ssha1 THEN 'maybe_changed|sha1-differs'
    WHEN ctag = sctag THEN 'unchanged|ctag-equal' WHEN ctag <> sctag THEN 'maybe_changed|ctag-differs'
    WHEN etag <> setag AND size IS NOT DISTINCT FROM ssize AND mtime_ns IS NOT DISTINCT FROM smtime THEN 'metadata_only|etag-moved'
    WHEN etag <> setag THEN 'maybe_changed|etag-moved+size-or-mtime-differs'
    WHEN etag = setag AND size IS NOT DISTINCT FROM ssize AND mtime_ns IS NOT DISTINCT FROM smtime THEN 'unchanged|etag-equal'
    WHEN size IS DISTINCT FROM ssize THEN 'maybe_changed|stat-differs:size' WHEN mtime_ns IS DISTINCT FROM smtime THEN 'maybe_changed|stat-differs:mtime'
    WHEN ctime_ns IS DISTINCT FROM sctime THEN 'maybe_changed|stat-differs:ctime' WHEN ino IS DISTINCT FROM sino THEN 'maybe_changed|stat-differs:ino'
    WHEN mode IS DISTINCT FROM smode THEN 'maybe_changed|stat-differs:mode'
    WHEN coalesce(gen_count, 0) = 0 OR coalesce(sgen, 0) = 0 THEN 'maybe_changed|gen-count-unknown'
    WHEN gen_count < sgen THEN 'maybe_changed|gen-count-decreased' WHEN gen_count > sgen THEN 'maybe_changed|gen-count-differs'
    WHEN smtime IS NULL OR smtime >= {WRITTEN_AT} THEN 'maybe_changed|racily-clean'
    ELSE 'unchanged|stat-equal' END AS r
  FROM j
), moved AS (
  SELECT *, CASE WHEN split_part(r, '|', 1) IN ('unchanged', 'metadata_only')
    THEN (CASE WHEN rel_path IS DISTINCT FROM spath THEN '+renamed' ELSE '' END) || (CASE WHEN split_part(r, '|', 1) = 'unchanged' AND etag <> setag THEN '+etag-moved' ELSE '' END) ELSE '' END AS extra
  FROM rung
), settled AS (
  SELECT *, CASE WHEN extra <> '' THEN 'metadata_only|' || split_part(r, '|', 2) || extra ELSE r END AS q FROM moved
), verdicts AS (
  SELECT source_id, stable_id, CASE
    WHEN deleted THEN 'deleted|' || (CASE WHEN sid IS NULL THEN 'deleted-unseen' WHEN sstate = 'tombstone' THEN 'already-tombstoned' ELSE 'provider-tombstone' END)
    WHEN sid IS NULL THEN 'created|new-id'
    WHEN is_dir AND sstate = 'tombstone' THEN 'metadata_only|reappeared' WHEN is_dir AND rel_path <> spath THEN 'metadata_only|renamed'
    WHEN is_dir AND (parent_id <> sparent OR name <> sname) THEN 'metadata_only|moved' WHEN is_dir THEN 'unchanged|dir'
    WHEN sstate = 'tombstone' THEN 'maybe_changed|reappeared'
    WHEN split_part(q, '|', 1) IN ('unchanged', 'metadata_only', 'dataless') AND slast = 'created' THEN 'created|pending:created'
    WHEN split_part(q, '|', 1) IN ('unchanged', 'metadata_only', 'dataless') AND slast IN ('maybe_changed', 'changed', 'deferred', 'error') THEN 'maybe_changed|pending:' || slast
    WHEN split_part(q, '|', 1) IN ('unchanged', 'metadata_only') AND scontent IS NULL AND sstate IN ('live', 'dataless') THEN 'maybe_changed|never-materialised'
    ELSE q END AS v,
    CASE WHEN NOT deleted AND sid IS NOT NULL AND rel_path IS DISTINCT FROM spath THEN spath END AS prev_path
  FROM settled
)"""


def sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return standin.observed(d), standin.stored(d)


@query(f"{CTES}, {RUNGS} SELECT source_id, stable_id, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS reason, prev_path FROM verdicts")
def classify_h0(spark, sf_dir):
    o, s = sides(spark, sf_dir)
    return classify.classify_observed(o, s, WRITTEN_AT)


@query(f"{CTES}, {RUNGS} SELECT source_id, split_part(v, '|', 1) AS verdict, count(*) AS n FROM verdicts GROUP BY ALL")
def classify_pass_counts(spark, sf_dir):
    o, s = sides(spark, sf_dir)
    return aggregates.verdict_counts(classify.classify_observed(o, s, WRITTEN_AT))


H1 = """
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE md5(text) END AS stored_sha256, md5(concat(text, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END)) AS new_sha256,
    CASE WHEN doc_id % 9 = 0 THEN 'ooxml-parts@1' ELSE 'bytes@1' END AS stored_method, 'bytes@1' AS new_method,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'tombstone' ELSE 'live' END AS state, lang FROM documents"""


@query(
    f"""WITH r AS ({H1}) SELECT doc_id,
  CASE WHEN state IS NULL OR stored_sha256 IS NULL OR state = 'tombstone' OR stored_method <> new_method OR stored_sha256 <> new_sha256 THEN 'changed' ELSE 'touched_not_changed' END AS verdict,
  CASE WHEN state IS NULL THEN 'no-row' WHEN stored_sha256 IS NULL THEN 'no-previous-canonical' WHEN state = 'tombstone' THEN 'reappeared'
    WHEN stored_method <> new_method THEN 'canonical-method-changed' WHEN stored_sha256 = new_sha256 THEN 'canonical-equal' ELSE 'canonical-differs' END AS reason,
  CASE WHEN state = 'live' AND stored_method = new_method AND stored_sha256 <> new_sha256 THEN 'a,c' || CASE WHEN lang = 'en' THEN ',d' ELSE '' END ELSE '' END AS changed_parts FROM r"""
)
def classify_h1(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_h1")
    rows = spark.sql(H1.replace("FROM documents", "FROM documents_h1"))
    one = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    rows = rows.withColumn("stored_parts", one("a", "1", "b", "2", "c", "3"))
    rows = rows.withColumn("new_parts", F.when(F.col("lang") == "en", one("a", "9", "b", "2", "d", "4")).otherwise(one("a", "9", "b", "2")))
    return classify.classify_content(rows).select("doc_id", "verdict", "reason", F.array_join("changed_parts", ",").alias("changed_parts"))


OUT_OLD = "SELECT source AS source_id, concat('d', CAST(doc_id % 100 AS STRING)) AS stable_id, concat('u', CAST(doc_id AS STRING)) AS unit_id, md5(text) AS rendered_sha256, CASE WHEN doc_id % 41 = 0 THEN 'failed' WHEN doc_id % 43 = 0 THEN 'tombstone' ELSE 'ok' END AS status FROM documents"
OUT_NEW = "SELECT source AS source_id, concat('d', CAST(doc_id % 100 AS STRING)) AS stable_id, concat('u', CAST(doc_id AS STRING)) AS unit_id, md5(concat(text, CASE WHEN doc_id % 37 = 0 THEN 'x' ELSE '' END)) AS rendered_sha256, doc_id % 53 <> 0 AS ok FROM documents WHERE doc_id % 43 <> 0"


@query(
    f"""WITH old AS ({OUT_OLD}), new AS ({OUT_NEW}), items AS (SELECT source_id, stable_id, bool_and(ok) AS ok FROM new GROUP BY ALL),
  prior AS (SELECT source_id, stable_id, bool_and(status = 'ok') AS ok, count(*) AS n FROM old WHERE status <> 'tombstone' GROUP BY ALL),
  same AS (SELECT n.source_id, n.stable_id, count(*) AS hits FROM new n JOIN old o ON n.source_id = o.source_id AND n.stable_id = o.stable_id AND n.unit_id = o.unit_id AND n.rendered_sha256 = o.rendered_sha256 AND o.status <> 'tombstone' GROUP BY ALL),
  size AS (SELECT source_id, stable_id, count(*) AS n FROM new GROUP BY ALL)
  SELECT i.source_id, i.stable_id, CASE WHEN i.ok AND p.ok AND s.hits = p.n AND z.n = p.n THEN 'output_unchanged' ELSE 'changed' END AS verdict
  FROM items i LEFT JOIN prior p USING (source_id, stable_id) LEFT JOIN same s USING (source_id, stable_id) LEFT JOIN size z USING (source_id, stable_id)"""
)
def classify_h2(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_h2")
    run = lambda q: spark.sql(q.replace("FROM documents", "FROM documents_h2"))
    return classify.classify_output(run(OUT_OLD), run(OUT_NEW))


#: Vanished rows: some stood at other paths; and a second row for each, few of them at the path of the first.
SAVED = {**standin.STORED, "rel_path": "concat(lang, '/f', CAST(doc_id % 10 AS STRING), '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '-was' ELSE '' END, '.txt')"}
TWINS = {**standin.STORED, "rel_path": "concat(lang, '/f', CAST(doc_id % 10 AS STRING), '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '' ELSE '-twin' END, '.txt')"}
RENUMBERED = {**standin.OBSERVED, "stable_id": "concat('n', CAST(doc_id AS STRING))", "rel_path": standin.STORED["rel_path"]}


@query(
    f"""WITH created AS ({standin.sql(RENUMBERED, "true")}), missing AS ({standin.sql(SAVED, "true")} UNION ALL
  SELECT {", ".join((("concat('x', CAST(doc_id AS STRING))" if n == "stable_id" else e) + " AS " + n) for n, e in TWINS.items())} FROM documents),
  olds AS (SELECT *, rank() OVER (PARTITION BY source_id, rel_path ORDER BY last_seen_run DESC) AS k FROM missing WHERE NOT is_dir AND state <> 'tombstone'),
  one AS (SELECT source_id, rel_path, min(stable_id) AS old_id FROM olds WHERE k = 1 GROUP BY ALL HAVING count(*) = 1)
  SELECT c.source_id, c.stable_id AS new_id, o.old_id FROM created c JOIN one o USING (source_id, rel_path) WHERE NOT c.is_dir AND NOT c.deleted AND c.stable_id <> o.old_id"""
)
def safe_save_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    created = d.selectExpr(*[f"{e} AS {n}" for n, e in RENUMBERED.items()])
    twins = d.selectExpr(*[f"{e} AS {n}" for n, e in TWINS.items()]).withColumn("stable_id", F.regexp_replace("stable_id", "^d", "x"))
    missing = d.selectExpr(*[f"{e} AS {n}" for n, e in SAVED.items()]).unionByName(twins)
    return classify.safe_saves(created, missing)


@query(f"{CTES} SELECT source_id, stable_id FROM stored s WHERE NOT is_dir AND state <> 'tombstone' AND NOT EXISTS (SELECT 1 FROM observed o WHERE o.source_id = s.source_id AND o.stable_id = s.stable_id)")
def unseen_rows(spark, sf_dir):
    o, s = sides(spark, sf_dir)
    return classify.unseen(s, o).select("source_id", "stable_id")


@query(
    f"""{CTES}, live AS (SELECT source_id, count(*) AS live FROM stored WHERE state IN ('live', 'dataless') AND NOT is_dir GROUP BY 1),
  gone AS (SELECT source_id, count(*) AS candidates FROM stored s WHERE NOT is_dir AND state <> 'tombstone' AND NOT EXISTS (SELECT 1 FROM observed o WHERE o.source_id = s.source_id AND o.stable_id = s.stable_id) GROUP BY 1)
  SELECT source_id, coalesce(live, 0) AS live, coalesce(candidates, 0) AS candidates, 100 * coalesce(candidates, 0) > greatest(7 * coalesce(live, 0), 300) AS tripped FROM live FULL JOIN gone USING (source_id)"""
)
def breaker_by_source(spark, sf_dir):
    o, s = sides(spark, sf_dir)
    return classify.classify_pass(o, s, WRITTEN_AT, True, True, "0.07", 3)[2]


@query(
    f"""{CTES} SELECT source_id, stable_id FROM stored s WHERE NOT is_dir AND state <> 'tombstone' AND NOT EXISTS (SELECT 1 FROM observed o WHERE o.source_id = s.source_id AND o.stable_id = s.stable_id)
  AND (source_id IN ('src1', 'src2') OR coalesce(absent_since_run, 7) < 7)"""
)
def confirmed_absent(spark, sf_dir):
    o, s = sides(spark, sf_dir)
    missing = classify.unseen(s, o)
    return state.confirmed_absent(s, missing, 7, ~F.col("source_id").isin("src1", "src2")).select("source_id", "stable_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_record_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return classify.last_record_wins(e, ("user_id",), "at").select("user_id", "event_id", "event_type", "value")


@query(
    f"""{CTES}, {RUNGS}, u AS (
  SELECT coalesce(s.source_id, o.source_id) AS source_id, coalesce(s.stable_id, o.stable_id) AS stable_id, o.stable_id IS NOT NULL AS here, s.stable_id IS NOT NULL AS old, o.deleted, o.dataless AS od,
    s.state, s.rel_path AS sp, o.rel_path AS op, s.size AS ss, o.size AS os, s.last_seen_run AS sr, s.first_seen_run AS sf, split_part(v.v, '|', 1) AS verdict, s.last_verdict AS lv, s.content_sha256 AS c
  FROM observed o FULL JOIN stored s ON o.source_id = s.source_id AND o.stable_id = s.stable_id LEFT JOIN verdicts v ON v.source_id = o.source_id AND v.stable_id = o.stable_id)
  SELECT source_id, stable_id,
    CASE WHEN NOT here THEN state WHEN deleted THEN 'tombstone' WHEN od THEN 'dataless' WHEN state IS NULL OR state IN ('tombstone', 'dataless') THEN 'live' ELSE state END AS state,
    CASE WHEN here AND NOT (deleted AND old) THEN op ELSE sp END AS rel_path,
    CASE WHEN here AND NOT (deleted AND old) AND NOT (od AND old) THEN os ELSE ss END AS size,
    CASE WHEN here AND NOT deleted AND old AND op <> sp THEN sp END AS prev_path,
    CASE WHEN here AND state = 'tombstone' AND NOT deleted THEN NULL ELSE c END AS content_sha256,
    CASE WHEN here THEN verdict ELSE lv END AS last_verdict, CASE WHEN here THEN 8 ELSE sr END AS last_seen_run, coalesce(sf, 8) AS first_seen_run
  FROM u WHERE old OR NOT deleted"""
)
def upsert_snapshot(spark, sf_dir):
    o, s = sides(spark, sf_dir)
    v = classify.classify_observed(o, s, WRITTEN_AT)
    return state.upsert(s, o, v, 8).select("source_id", "stable_id", "state", "rel_path", "size", "prev_path", "content_sha256", "last_verdict", "last_seen_run", "first_seen_run")


@query(
    f"""{CTES}, pairs AS (SELECT source AS source_id, concat('n', CAST(doc_id AS STRING)) AS new_id, concat('d', CAST(doc_id AS STRING)) AS old_id FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 6 = 0),
  a AS (SELECT source AS source_id, concat('o', CAST(doc_id AS STRING)) AS old_id, concat('d', CAST(doc_id AS STRING)) AS new_id, true AS origin FROM documents WHERE doc_id % 18 = 0)
  SELECT a.source_id, a.old_id, coalesce(p.new_id, a.new_id) AS new_id, a.origin FROM a LEFT JOIN pairs p ON p.source_id = a.source_id AND p.old_id = a.new_id
  UNION ALL SELECT p.source_id, p.old_id, p.new_id, NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = p.source_id AND a.new_id = p.old_id AND a.origin) FROM pairs p"""
)
def rekey_aliases(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    _, s = sides(spark, sf_dir)
    pairs = d.where("doc_id % 17 <> 0 AND doc_id % 6 = 0").selectExpr("source AS source_id", "concat('n', doc_id) AS new_id", "concat('d', doc_id) AS old_id")
    aliases = d.where("doc_id % 18 = 0").selectExpr("source AS source_id", "concat('o', doc_id) AS old_id", "concat('d', doc_id) AS new_id", "true AS origin")
    fresh = s.join(pairs.select("source_id", F.col("old_id").alias("stable_id"), "new_id"), ["source_id", "stable_id"]).withColumn("stable_id", F.col("new_id")).drop("new_id")
    return state.rekey(s.unionByName(fresh.select(*s.columns)), {}, pairs, aliases)[2]


@query(
    f"""{CTES}, live AS (SELECT source_id, canonical_sha256 AS h FROM stored WHERE NOT is_dir AND state IN ('live', 'dataless') AND canonical_sha256 IS NOT NULL)
  SELECT a.source_id AS a, b.source_id AS b, count(*) AS n FROM live a JOIN (SELECT DISTINCT source_id, h FROM live) b ON a.h = b.h AND b.source_id > a.source_id GROUP BY 1, 2"""
)
def shared_content_counts(spark, sf_dir):
    return joins.shared_content_counts(sides(spark, sf_dir)[1])


OUTPUTS = (
    "SELECT source AS source_id, concat('d', CAST(doc_id AS STRING)) AS stable_id, 'whole' AS unit_id, concat('mirror/', source, '/', CAST(doc_id AS STRING), '.md') AS output_path, md5(text) AS rendered_sha256, "
    "md5(concat(text, 'p')) AS page_sha256, CASE WHEN doc_id % 3 = 0 THEN 'pandoc' ELSE 'text' END AS converter_id, CASE WHEN doc_id % 4 = 0 THEN '1' ELSE '2' END AS converter_version, "
    "concat('k', CAST(doc_id AS STRING)) AS action_key, CASE WHEN doc_id % 67 = 0 THEN 'quarantined' WHEN doc_id % 71 = 0 THEN 'tombstone' ELSE 'ok' END AS status FROM documents"
)
CACHE = "SELECT concat('k', CAST(doc_id AS STRING)) AS action_key, CASE WHEN doc_id % 10 = 0 THEN 'html' ELSE 'text' END AS converter_id, '3' AS converter_version FROM documents WHERE doc_id % 5 = 0"


def derived(spark, sf_dir, *texts):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_derived")
    return [spark.sql(t.replace("FROM documents", "FROM documents_derived")) for t in texts]


@query(
    f"{CTES}, o AS ({OUTPUTS}), c AS ({CACHE}) SELECT DISTINCT o.source_id, coalesce(c.converter_id, o.converter_id) AS converter_id, coalesce(c.converter_version, o.converter_version) AS converter_version "
    "FROM stored i JOIN o USING (source_id, stable_id) LEFT JOIN c ON c.action_key = o.action_key"
)
def produced_by(spark, sf_dir):
    return joins.produced_by(sides(spark, sf_dir)[1], *derived(spark, sf_dir, OUTPUTS, CACHE))


TARGETS = "SELECT * FROM (VALUES ('text', '2', CAST(NULL AS STRING), '.txt'), ('html', '3', CAST(NULL AS STRING), '.txt'), ('pandoc', '1', 'secret', '.txt')) AS t(converter_id, version, reason, suffix)"


@query(
    f"""{CTES}, o AS ({OUTPUTS}), c AS ({CACHE}), t AS ({TARGETS})
  SELECT source_id, stable_id FROM stored i WHERE NOT is_dir AND NOT dataless AND EXISTS (
    SELECT 1 FROM o LEFT JOIN c ON c.action_key = o.action_key JOIN t ON t.converter_id = coalesce(c.converter_id, o.converter_id) AND t.version = coalesce(c.converter_version, o.converter_version)
    WHERE o.source_id = i.source_id AND o.stable_id = i.stable_id AND i.name LIKE '%' || t.suffix
      AND ((t.reason IS NULL AND o.status = 'ok' AND i.state = 'live') OR (t.reason = i.state_reason AND o.status = i.state AND i.state IN ('quarantined', 'refused'))))"""
)
def reread_candidates(spark, sf_dir):
    o, c, t = derived(spark, sf_dir, OUTPUTS, CACHE, TARGETS)
    return joins.reread_candidates(sides(spark, sf_dir)[1], o, c, t).select("source_id", "stable_id")


@query(f"{CTES} SELECT source_id, state, count(*) AS n, CAST(count_if(last_verdict = 'deferred') AS BIGINT) AS deferred FROM stored WHERE NOT is_dir GROUP BY 1, 2")
def state_counts(spark, sf_dir):
    return aggregates.state_counts(sides(spark, sf_dir)[1])


@query(
    f"{CTES} SELECT source_id, stable_id, last_verdict FROM stored WHERE NOT is_dir AND state <> 'tombstone' AND (last_verdict IN ('created', 'maybe_changed', 'changed', 'deferred', 'error') OR (last_verdict = 'dataless' AND content_sha256 IS NULL))"
)
def pending_work(spark, sf_dir):
    return state.pending_work(sides(spark, sf_dir)[1]).select("source_id", "stable_id", "last_verdict")


@query(f"{CTES} SELECT source_id, parent_id AS rel_path, stable_id FROM stored QUALIFY row_number() OVER (PARTITION BY source_id, parent_id ORDER BY last_seen_run DESC, stable_id) = 1")
def item_by_path(spark, sf_dir):
    s = sides(spark, sf_dir)[1].withColumn("rel_path", F.col("parent_id"))
    return joins.newest_at_path(s).select("source_id", "rel_path", "stable_id")


@query(
    f"""{CTES}, o AS ({OUTPUTS}), a AS (SELECT source AS source_id, concat('z', CAST(doc_id AS STRING)) AS old_id, concat('d', CAST(doc_id AS STRING)) AS new_id FROM documents WHERE doc_id % 25 = 0)
  SELECT i.source_id, coalesce(a.old_id, i.stable_id) AS id, '{{"id":"' || coalesce(a.old_id, i.stable_id) || '","outputs":[{{"unit_id":"whole","output_path":"' || o.output_path || '","rendered_sha256":"' || o.rendered_sha256
    || '"}}],"path":"' || i.rel_path || '","size":' || i.size || ',"state":"' || (CASE WHEN i.state = 'dataless' THEN 'live' ELSE i.state END) || '"}}' AS line
  FROM stored i JOIN o USING (source_id, stable_id) LEFT JOIN a ON a.source_id = i.source_id AND a.new_id = i.stable_id WHERE NOT i.is_dir"""
)
def shard_export(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    aliases = d.where("doc_id % 25 = 0").selectExpr("source AS source_id", "concat('z', doc_id) AS old_id", "concat('d', doc_id) AS new_id", "true AS origin")
    return joins.shard_export(sides(spark, sf_dir)[1], derived(spark, sf_dir, OUTPUTS)[0], aliases)


@query(
    "WITH a AS (SELECT CAST(doc_id AS STRING) AS path, md5(text) AS sha FROM documents WHERE doc_id % 13 <> 0), "
    "b AS (SELECT CASE WHEN doc_id % 11 = 0 THEN concat('r', CAST(doc_id AS STRING)) ELSE CAST(doc_id AS STRING) END AS path, md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END) AS sha FROM documents WHERE doc_id % 17 <> 0) "
    "SELECT CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS op, coalesce(b.path, a.path) AS path FROM a FULL JOIN b ON a.path = b.path WHERE a.sha IS DISTINCT FROM b.sha"
)
def change_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 13 <> 0").selectExpr("CAST(doc_id AS STRING) AS path", "md5(text) AS sha")
    new = d.where("doc_id % 17 <> 0").selectExpr("CASE WHEN doc_id % 11 = 0 THEN concat('r', doc_id) ELSE CAST(doc_id AS STRING) END AS path", "md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END) AS sha")
    return joins.snapshot_changes(old, new)


CHANGES = "SELECT doc_id AS seq, source AS source_id, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'R' ELSE 'D' END AS op, doc_id % 3 = 0 AS item_live, concat('p', CAST(doc_id % 200 AS STRING)) AS path, 'x' AS stable_id, CAST(NULL AS STRING) AS prev_path FROM documents"


@query(f"WITH c AS ({CHANGES}), r AS (SELECT source_id, CASE WHEN op = 'D' AND item_live THEN 'M' ELSE op END AS op FROM c) SELECT source_id, " + ", ".join(f"CAST(count_if(op = '{x}') AS BIGINT) AS \"{x}\"" for x in "AMRD") + " FROM r GROUP BY 1")
def changelog_counts(spark, sf_dir):
    return aggregates.change_counts(*derived(spark, sf_dir, CHANGES))


@query(
    f"WITH c AS ({CHANGES}) SELECT min(seq) AS seq, min(op) AS op, path, source_id FROM c WHERE op IN ('A', 'M') GROUP BY path, source_id, stable_id, prev_path UNION ALL SELECT seq, op, path, source_id FROM c WHERE op IN ('R', 'D')"
)
def one_change_per_page(spark, sf_dir):
    return joins.one_change_per_page(*derived(spark, sf_dir, CHANGES)).select("seq", "op", "path", "source_id")


TOMBS = "SELECT concat('mirror/', CAST(doc_id AS STRING)) AS output_path, CAST('2024-01-01' AS DATE) + CAST(doc_id % 300 AS INT) AS reap_after FROM documents WHERE doc_id % 3 = 0"


@query(f"WITH t AS ({TOMBS}) SELECT output_path, CASE WHEN CAST(substr(output_path, 8) AS BIGINT) % 12 = 0 THEN 'row' ELSE 'page' END AS action FROM t WHERE reap_after <= DATE '2024-05-01'")
def tombstones_due(spark, sf_dir):
    (t,) = derived(spark, sf_dir, TOMBS)
    live = table(spark, sf_dir, "documents").where("doc_id % 12 = 0").selectExpr("concat('mirror/', doc_id) AS output_path")
    return state.tombstones_due(t, live, F.lit("2024-05-01").cast("date"))


@query(
    f"""{CTES}, o AS ({OUTPUTS}) SELECT s.source_id, CAST(count_if(state = 'live') AS BIGINT) AS n_live, CAST(count_if(state = 'dataless') AS BIGINT) AS n_dataless, CAST(count_if(state = 'quarantined') AS BIGINT) AS n_quarantined,
  CAST(count_if(state = 'refused') AS BIGINT) AS n_refused, CAST(count_if(state = 'tombstone') AS BIGINT) AS n_tombstone, CAST(count_if(last_verdict = 'deferred') AS BIGINT) AS n_deferred,
  (SELECT count(*) FROM o WHERE o.source_id = s.source_id AND o.status = 'tombstone') AS n_pages_gone, 7::BIGINT AS last_run FROM stored s WHERE NOT is_dir GROUP BY 1"""
)
def status_rows(spark, sf_dir):
    s = sides(spark, sf_dir)[1]
    (o,) = derived(spark, sf_dir, OUTPUTS)
    sources = s.select("source_id").distinct()
    return joins.status_rows(sources, s, o.where("status = 'tombstone'"), sources.withColumn("run_id", F.lit(7).cast("bigint")))


@query(f"{CTES}, o AS ({OUTPUTS}) SELECT action_key FROM (SELECT concat('k', CAST(doc_id AS STRING)) AS action_key FROM documents WHERE doc_id % 5 = 0) c WHERE EXISTS (SELECT 1 FROM o WHERE o.action_key = c.action_key AND status <> 'tombstone')")
def cache_gc(spark, sf_dir):
    o, c = derived(spark, sf_dir, OUTPUTS, CACHE)
    return state.cache_gc(c, o).select("action_key")


@query(
    f"""{CTES} SELECT i.stable_id, min(s.source_id) AS twin_source, arg_min(s.stable_id, (s.source_id, s.stable_id)) AS twin_id
  FROM (SELECT concat('in', CAST(doc_id AS STRING)) AS stable_id, md5(lower(text)) AS h FROM documents) i
  JOIN stored s ON s.canonical_sha256 = i.h AND s.state IN ('live', 'dataless') GROUP BY 1"""
)
def inbox_duplicates(spark, sf_dir):
    inbox = table(spark, sf_dir, "documents").selectExpr("concat('in', doc_id) AS stable_id", "md5(lower(text)) AS canonical_sha256")
    return joins.inbox_duplicates_by_content(inbox, sides(spark, sf_dir)[1])


@query(
    f"""{CTES}, o AS ({OUTPUTS}), p AS (SELECT concat('mirror/', source, '/', CAST(doc_id AS STRING), '.md') AS page, md5(concat(text, CASE WHEN doc_id % 21 = 0 THEN 'q' ELSE 'p' END)) AS sha FROM documents WHERE doc_id % 23 <> 0)
  SELECT source_id, stable_id FROM o LEFT JOIN p ON p.page = o.output_path WHERE status <> 'tombstone' GROUP BY ALL HAVING NOT bool_and(coalesce(p.sha = o.page_sha256, false))"""
)
def integrity_check(spark, sf_dir):
    (o,) = derived(spark, sf_dir, OUTPUTS)
    pages = table(spark, sf_dir, "documents").where("doc_id % 23 <> 0").selectExpr("concat('mirror/', source, '/', doc_id, '.md') AS page", "md5(concat(text, CASE WHEN doc_id % 21 = 0 THEN 'q' ELSE 'p' END)) AS sha")
    return joins.broken_items(o, pages)
