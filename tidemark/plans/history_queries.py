"""Queries over versions, cycles, paged feeds, histories, forests and pieces of work, each with a plain SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.functions.front import write_front
from tidemark.functions.scratch import materialize, shared_dir
from tidemark.operators import aggregates, graph, joins, pieces, quality
from tidemark.plans import verbs
from tidemark.plans.registry import query, table
from tidemark.schemas import OBSERVATION, conform
from tidemark.sources import paged, readers
from tidemark.sources.versions import VersionedStore


def fresh_store(spark, name, keys=None):
    return VersionedStore(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", keys)


RUNS = 10


@query(
    f"""SELECT CAST(run AS BIGINT) AS run, source, count(*) AS n, CAST(sum(n_chars + CASE WHEN doc_id % 7 <= (run - 1) % 7 THEN run * (CASE WHEN doc_id % 7 = (run - 1) % 7 THEN 1 ELSE 0 END) ELSE 0 END) AS BIGINT) AS size
  FROM documents, range(1, {RUNS + 1}) r(run) WHERE doc_id % 23 <> run GROUP BY run, source"""
)
def versions_of_ten_runs(spark, sf_dir):
    """Ten runs as base and changes, compacted once between; every run read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    store = fresh_store(spark, "versions", {"sizes": ("doc_id",)})
    for run in range(1, RUNS + 1):
        extra = F.when(F.col("doc_id") % 7 == (run - 1) % 7, run).otherwise(0)
        store.begin(run)
        store.replace("sizes", run, docs.where(F.col("doc_id") % 23 != run).select("doc_id", "source", (F.col("n_chars") + extra).cast("bigint").alias("size")))
        store.commit(run)
        if run == 6:
            store.compact()
    out = None
    for run in range(1, RUNS + 1):
        one = store.read("sizes", run).groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).select(F.lit(run).cast("bigint").alias("run"), "source", "n", "size")
        out = one if out is None else out.unionByName(one)
    return out


def listed(docs, run):
    """A listing in which a third changes its bytes with the run, a third its times only, and some are not there in the second run."""
    touched = F.when(F.col("doc_id") % 3 != 2, run).otherwise(0)
    rows = docs.where(f"{run} <> 2 or doc_id % 29 <> 0").select(
        F.col("source").alias("source_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stable_id"), F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.lit(False).alias("is_dir"), F.lit(False).alias("dataless"), F.lit(False).alias("deleted"), F.col("n_chars").alias("size"), (F.lit(10) + touched).cast("bigint").alias("mtime_ns"),
        F.lit(3).cast("bigint").alias("gen_count"), F.col("doc_id").alias("ino"),
    )
    said = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit(f" in run {run}")).otherwise(""))
    files = docs.select(
        F.col("source").alias("source_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stable_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), said.cast("binary").alias("content"),
    )
    return conform(rows, OBSERVATION), files


@query(
    """WITH d AS (SELECT doc_id, source FROM documents),
  r1 AS (SELECT 1 AS run, 'A' AS op, source, doc_id FROM d),
  r2 AS (SELECT 2 AS run, CASE WHEN doc_id % 29 = 0 THEN 'D' ELSE 'M' END AS op, source, doc_id FROM d WHERE doc_id % 29 = 0 OR doc_id % 3 = 0),
  r3 AS (SELECT 3 AS run, 'M' AS op, source, doc_id FROM d WHERE doc_id % 29 = 0 OR doc_id % 3 = 0)
  SELECT CAST(run AS BIGINT) AS run, op, source AS source_id, count(*) AS n FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY run, op, source"""
)
def three_cycles(spark, sf_dir):
    """What three cycles publish: all is new; some is changed, touched without a change (no page) or gone; what was gone returns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    store, out = fresh_store(spark, "cycles"), None
    for run in (1, 2, 3):
        observed, files = listed(docs, run)
        changes = verbs.sync(store, observed, files, run, 1000, True, True, verbs.Policy(accept_deletions=True)).changes
        one = changes.groupBy("op", "source_id").agg(F.count("*").alias("n")).select(F.lit(run).cast("bigint").alias("run"), "op", "source_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH RECURSIVE e AS (SELECT doc_id AS c, greatest(doc_id - 1 - doc_id % 3, 0) AS p, 0 AS place FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id, doc_id - 17, 1 FROM documents WHERE doc_id % 5 = 0 AND doc_id > 20),
  w(c, q, place) AS (SELECT c, p, place FROM e WHERE c % 4 = 0 UNION SELECT w.c, e.p, w.place FROM w JOIN e ON e.c = w.q WHERE w.q % 4 <> 0),
  links AS (SELECT c, q, min(place) AS place FROM w WHERE q % 4 = 0 GROUP BY c, q)
  SELECT c AS "commit", q AS parent, CAST(place AS BIGINT) AS place FROM links
  UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT c FROM links)"""
)
def compacted_history(spark, sf_dir):
    """A history with merges without three quarters of its commits, survivors linked through what went."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    first = d.select(F.col("doc_id").alias("commit"), F.when(F.col("doc_id") > 0, F.greatest(F.col("doc_id") - 1 - F.col("doc_id") % 3, F.lit(0))).alias("parent"), F.lit(0).alias("place"))
    second = d.where("doc_id % 5 = 0 and doc_id > 20").select(F.col("doc_id").alias("commit"), (F.col("doc_id") - 17).alias("parent"), F.lit(1).alias("place"))
    return graph.compacted(first.unionByName(second), d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("commit")))


@query(
    """WITH RECURSIVE t(id, root, path) AS (SELECT doc_id, doc_id, [n_chars, doc_id] FROM documents WHERE doc_id % 11 = 0
  UNION ALL SELECT d.doc_id, t.root, list_concat(t.path, [d.n_chars, d.doc_id]) FROM documents d JOIN t ON d.doc_id // 3 = t.id WHERE d.doc_id % 11 <> 0)
  SELECT id, root, row_number() OVER (ORDER BY path) AS place FROM t"""
)
def forest_in_reading_order(spark, sf_dir):
    """Documents as answers to one another, in the order in which they are read."""
    d = table(spark, sf_dir, "documents")
    return graph.preorder(d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.floor(F.col("doc_id") / 3)).alias("parent"), "n_chars"), ["n_chars"])


@query("SELECT source AS feed, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 40 AS place FROM documents")
def paged_feed(spark, sf_dir):
    """Documents as the records of paged feeds, one for each source, read as a stream."""
    from pyspark.sql import Window as W

    root = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1  # the order of a stand-in feed
    records = table(spark, sf_dir, "documents").select(F.col("source").alias("feed"), n.alias("n"), F.to_json(F.struct("doc_id")).alias("record"))
    paged.pages_of(records, f"{root}/pages", 40)
    feeds = {r["feed"]: f"{root}/pages/feed={r['feed']}/page=0" for r in records.select("feed").distinct().collect()}  # one for each source
    stream = paged.paged_stream(spark, feeds)
    run = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("feed", F.get_json_object("record", "$.doc_id").cast("bigint").alias("doc_id"), "place")


BOX = 400


@query(
    f"""WITH p AS (SELECT doc_id, unnest(range(0, 1 + n_chars // 2000)) AS piece FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, piece) AS k FROM p)
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS job, count(*) FILTER (k <= {2 * BOX}) AS done, count(*) AS "of" FROM o GROUP BY doc_id"""
)
def boxed_pieces(spark, sf_dir):
    """Long texts worked on in pieces by two runs with a time box."""
    d = table(spark, sf_dir, "documents")
    job = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("job")
    jobs = materialize(d.select(job, F.md5(F.col("text").cast("binary")).alias("key"), (1 + F.floor(F.col("n_chars") / 2000)).cast("int").alias("pieces")), "jobs")
    cost, store = jobs.select("job", F.lit(1).alias("seconds")), pieces.PieceStore(fresh_store(spark, "pieces"))
    for run in (1, 3):
        mine = store.claim(run, jobs, cost, BOX)
        store.finish(run + 1, run, mine.select("job", "piece", "key", F.concat_ws("-", "job", F.col("piece").cast("string")).alias("result")))
    return pieces.progress(store.pieces())


@query(
    """SELECT doc_id, unnest(CASE doc_id % 7 WHEN 1 THEN ['front-malformed'] WHEN 2 THEN ['front-form'] WHEN 3 THEN ['page-status'] WHEN 4 THEN ['front-missing'] WHEN 5 THEN ['page-body-hash'] ELSE ['front-kind'] END) AS rule
  FROM documents WHERE doc_id % 7 <> 0"""
)
def page_contracts(spark, sf_dir):
    """Documents as pages, most of them with one fault each."""
    k = F.col("doc_id") % 7
    sha = F.sha2(F.when(k == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256)
    status = F.when(k == 3, "new").when(k != 4, "current")
    head = F.struct(F.when(k == 6, F.lit("none")).otherwise(sha).alias("rendered_sha256"), F.col("source").alias("source_id"), F.concat(F.lit("a: "), "lang").alias("source_path"), status.alias("status"))
    block = write_front(F.to_json(head))
    block = F.when(k == 1, F.concat(F.lit("---\nno key\n---\n"))).when(k == 2, F.replace(block, F.lit("status: current"), F.lit('status: "current"'))).otherwise(block)
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(block, "text").alias("text"))
    return quality.contract_findings(pages).select(F.col("path").cast("bigint").alias("doc_id"), "rule")


@query(
    """WITH f AS (SELECT source AS source_id, concat('A/', lang, '/', CAST(doc_id % 10 AS STRING)) AS folder FROM documents),
  d AS (SELECT DISTINCT source AS source_id, unnest([concat('A/', lang), concat('a/', lang), concat('A/', lang, '/', CAST(doc_id % 10 AS STRING)), concat('A/x', lang)]) AS path FROM documents),
  p AS (SELECT source_id, 'A/' || split_part(folder, '/', 2) AS prefix FROM f UNION ALL SELECT source_id, folder FROM f),
  c AS (SELECT source_id, prefix, count(*) AS n FROM p GROUP BY ALL)
  SELECT d.source_id, d.path, CASE WHEN max(c.n) FILTER (c.prefix = d.path) > 0 THEN 'has-files' WHEN count(c.prefix) > 0 THEN 'would-collide' ELSE 'clear' END AS class,
    coalesce(max(c.n) FILTER (c.prefix = d.path), 0) AS n, min(c.prefix) FILTER (c.prefix <> d.path) AS other
  FROM d LEFT JOIN c ON c.source_id = d.source_id AND lower(c.prefix) = lower(d.path) GROUP BY d.source_id, d.path"""
)
def folder_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    deep = F.concat(F.lit("A/"), "lang", F.lit("/"), (F.col("doc_id") % 10).cast("string"))
    files = d.select(F.col("source").alias("source_id"), F.concat(deep, F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    folders = d.select(F.col("source").alias("source_id"), F.explode(F.array(F.concat(F.lit("A/"), "lang"), F.concat(F.lit("a/"), "lang"), deep, F.concat(F.lit("A/x"), "lang"))).alias("path"))
    return aggregates.folder_classes(files, folders)


@query(
    """SELECT source AS source_id, CAST(doc_id AS STRING) AS stable_id, n_chars AS size, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS rounds FROM documents WHERE doc_id % 3 <> 2"""
)
def two_reads(spark, sf_dir):
    """Documents read three times: a third agrees at once, a third changes after its first read, a third at every read."""
    d = table(spark, sf_dir, "documents")
    form = lambda k: F.when(F.col("doc_id") % 3 == 2, k).when((F.col("doc_id") % 3 == 1) & F.lit(k == 0), 9).otherwise(1).cast("string")
    read = lambda k: d.select(
        F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("stable_id"), F.col("n_chars").alias("size"), F.lit(5).cast("bigint").alias("mtime_ns"),
        F.sha2(F.concat("text", form(k)).cast("binary"), 256).alias("sha256"), F.lit(100 * k).cast("bigint").alias("at_ns"),
    )
    waiting, out = read(0).limit(0), None
    for k in range(3):
        stand, waiting = readers.agreed_reads(waiting, read(k), 100)
        waiting = materialize(waiting, "waiting")
        one = stand.select("source_id", "stable_id", "size", F.lit(k).alias("rounds"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("source_id", "stable_id", "size").agg(F.min("rounds").alias("rounds"))


@query(
    """SELECT event_id, event_id AS seen, false AS has_k, CAST(len(json_keys(props)) - CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 1 ELSE 0 END + 1 AS INTEGER) AS keys FROM events"""
)
def json_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("j", fx.json_set(fx.json_remove("props", "k"), "seen", F.col("event_id").cast("string")))
    return e.select("event_id", F.get_json_object("j", "$.seen").cast("bigint").alias("seen"), F.get_json_object("j", "$.k").isNotNull().alias("has_k"), F.size(F.json_object_keys("j")).alias("keys"))


@query(
    """WITH s AS (SELECT o_custkey AS k, max(o_orderkey) AS newest, max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END) AS good, count(*) AS n_live FROM orders GROUP BY 1)
  SELECT CAST(k AS STRING) AS source_id, n_live, CASE WHEN newest % 3 = 0 THEN 'failed' ELSE 'ok' END AS last_outcome, 100000 - good AS age_s, k % 5 = 0 AS held, CASE WHEN k % 5 = 0 THEN k END AS held_candidates,
    CASE WHEN k % 11 = 0 THEN 'retired' WHEN k % 5 = 0 THEN 'held' WHEN k % 7 = 0 THEN 'no-baseline' WHEN good IS NULL THEN 'never' WHEN 100000 - good > 60000 THEN 'late' ELSE 'ok' END AS health FROM s"""
)
def source_health(spark, sf_dir):
    """Customers as sources, their orders as runs."""
    o = table(spark, sf_dir, "orders")
    name = F.col("o_custkey").cast("string").alias("source_id")
    now, k = F.timestamp_seconds(F.lit(100_000)), F.col("o_custkey")
    sources = o.select("o_custkey").distinct().select(
        name, F.when(k % 11 == 0, "retired").otherwise("live").alias("config_state"), (k % 7 != 0).alias("baseline_complete"),
        F.when(k % 5 == 0, F.timestamp_seconds(F.lit(200_000))).when(k % 3 == 0, F.timestamp_seconds(F.lit(1))).alias("breaker_until"), k.alias("breaker_candidates"),
    )
    runs = o.select(name, F.timestamp_seconds("o_orderkey").alias("finished_at"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("ok").alias("outcome"))
    return joins.source_health(sources, o.groupBy(name).agg(F.count("*").alias("n_live")), runs, now, 60_000)
