"""Scans: listings, feeds and small files become DataFrames; where bytes are not asked for they are not read."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.columns import in_scope, pruned
from tidemark.operators.classify import KEYS, last_record_wins
from tidemark.schemas import OBSERVATION, conform


def local_listing(spark: SparkSession, root: str, source_id: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Observations of a folder tree from file metadata; the content column is pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z]+:/*", "/")
    rel = F.replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), base, F.lit(""))
    rows = files.select(
        F.lit(source_id).alias("source_id"), rel.alias("rel_path"), rel.alias("stable_id"), F.regexp_extract(rel, r"([^/]*)$", 1).alias("name"), F.lit(False).alias("is_dir"),
        F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(False).alias("dataless"), F.lit(False).alias("deleted"), F.lit(0).alias("seq"),
    )
    kept = rows.where(in_scope("rel_path", list(include), list(exclude)))
    if exclude:
        kept = kept.where(~pruned("rel_path", list(exclude)))
    return conform(kept, OBSERVATION)


def complete(listing: DataFrame, sentinel: str) -> bool:
    """A listing without its sentinel file is not complete evidence of absence."""
    return listing.where(F.col("rel_path") == sentinel).limit(1).count() == 1


def quiet_rows(listing: DataFrame, now_ns: Column, hold_s: int = 60) -> tuple[DataFrame, DataFrame]:
    """Rows that have rested long enough, and those withheld; the newest of three times counts."""
    newest = F.greatest(F.coalesce("mtime_ns", F.lit(0)), F.coalesce("ctime_ns", F.lit(0)), F.coalesce("created_ns", F.lit(0)))
    rested = newest <= now_ns - hold_s * 1_000_000_000
    return listing.where(rested), listing.where(~rested)


def agreed_reads(waiting: DataFrame, reads: DataFrame, rest_ns: int) -> tuple[DataFrame, DataFrame]:
    """Reads that stand, and those that wait for another: content counts once two reads some time apart agree in size, time and digest.

    waiting and reads: source_id, stable_id, size, mtime_ns, sha256, at_ns.  Of several reads of one object in a batch the last is taken, unless
    they disagree, when nothing of it stands.  What waits keeps the time of its first read while all later ones agree; an object that
    was not read again goes on waiting.
    """
    what = ("size", "mtime_ns", "sha256")
    now = reads.groupBy(*KEYS).agg(F.max_by(F.struct(*what), "at_ns").alias("r"), F.max("at_ns").alias("at_ns"), F.min("at_ns").alias("__from"), F.count_distinct(F.struct(*what)).alias("__forms"))
    now = now.select(*KEYS, "r.*", "at_ns", "__from", "__forms")
    old = waiting.select(*KEYS, *[F.col(c).alias(f"__{c}") for c in (*what, "at_ns")])
    both = now.join(old, list(KEYS), "full_outer")
    same = F.col("__forms") == 1
    for c in what:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    first = F.when(F.col("__at_ns").isNotNull() & same, F.col("__at_ns")).when(F.col("__forms") == 1, F.col("__from")).otherwise(F.col("at_ns"))
    both = both.withColumns({"__first": first, "__stands": F.coalesce((F.col("__forms") == 1) & (F.col("at_ns") - first >= rest_ns), F.lit(False))})
    stand = both.where("__stands").select(*KEYS, *what, "at_ns")
    read = F.col("at_ns").isNotNull()
    wait = both.where("not __stands").select(*KEYS, *[F.when(read, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in what], F.when(read, F.col("__first")).otherwise(F.col("__at_ns")).alias("at_ns"))
    return stand, wait


DRIVE = "id string, name string, size bigint, cTag string, eTag string, lastModifiedDateTime string, parentReference struct<id:string,driveId:string>, file struct<hashes:struct<quickXorHash:string,sha1Hash:string,sha256Hash:string>,mimeType:string>, folder struct<childCount:bigint>, root struct<x:string>, deleted struct<state:string>, remoteItem struct<id:string>"


def drive_feed(records: DataFrame, known: DataFrame, source_id: str, full: bool) -> DataFrame:
    """Observations from drive records (DRIVE columns and seq): the last record of an id wins; deletions count for known
    ids only; folders have no size and no content tag; shortcuts to other drives and the root are left out."""
    from tidemark.functions.columns import iso_ns

    latest = last_record_wins(records.where("remoteItem is null and root is null"), ("id",), "seq")
    mtime = iso_ns("lastModifiedDateTime")
    folder = F.col("folder").isNotNull()
    rows = latest.select(
        F.lit(source_id).alias("source_id"), F.col("id").alias("stable_id"), "seq", "name", F.col("parentReference.id").alias("parent_id"), folder.alias("is_dir"),
        F.when(folder, 0).otherwise(F.col("size")).cast("bigint").alias("size"), mtime.alias("mtime_ns"), mtime.alias("ctime_ns"), F.col("eTag").alias("etag"),
        F.when(~folder, F.col("cTag")).alias("ctag"), F.col("file.hashes.quickXorHash").alias("quickxor"), F.col("file.hashes.sha1Hash").alias("sha1"),
        F.col("file.hashes.sha256Hash").alias("sha256_remote"), F.col("file.mimeType").alias("content_type"), F.lit(False).alias("dataless"), F.col("deleted").isNotNull().alias("deleted"),
    )
    ids = known.where(F.col("source_id") == source_id).select("stable_id").distinct().withColumn("__known", F.lit(True))
    joined = rows.join(ids, "stable_id", "left").where(~F.col("deleted") | F.col("__known"))
    return conform(joined if not full else joined.where(~F.col("deleted")), OBSERVATION)


def new_folders(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Folders that a delta names for the first time: their children are to be listed."""
    return observed.where("is_dir and not deleted").join(known.select(*KEYS), list(KEYS), "left_anti").select(*KEYS)


def missing_ancestors(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Parents that neither the batch nor the state has: to be looked up."""
    have = observed.select(*KEYS).unionByName(known.select(*KEYS)).distinct()
    return observed.where("parent_id is not null").select("source_id", F.col("parent_id").alias("stable_id")).distinct().join(have, list(KEYS), "left_anti")


def mail_feed(records: DataFrame, folders: DataFrame, source_id: str) -> DataFrame:
    """id, action of mail records (id, removed, seq): listed; removed and found elsewhere is moved:<folder>, not found is
    deleted, still here is noise.  folders: id, folder_id, here."""
    latest = last_record_wins(records, ("id",), "seq")
    at = folders.select(F.col("id").alias("__id"), "folder_id", "here")
    action = (
        F.when(~F.col("removed"), F.lit("listed")).when(F.col("folder_id").isNull(), "deleted").when(F.col("here"), "noise").otherwise(F.concat(F.lit("moved:"), F.col("folder_id")))
    )
    return latest.join(at, latest["id"] == at["__id"], "left").select(F.lit(source_id).alias("source_id"), F.col("id").alias("stable_id"), action.alias("action"))


MONTH = (
    "schema string, team_id string, team_name string, channel_id string, channel_name string, month string, messages array<struct<id:string,reply_to_id:string,created:string,"
    "last_modified:string,`from`:string,subject:string,body_html:string,deleted:boolean,attachments:array<struct<content_url:string,name:string>>>>"
)


def month_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MONTH).json(path, multiLine=True)


def month_messages(documents: DataFrame) -> DataFrame:
    return documents.select("channel_id", "month", F.explode("messages").alias("m")).select("channel_id", "month", "m.*")


def edge_table(spark: SparkSession, path: str) -> DataFrame:
    """page, source, pinned_sha, role, fields of a tab-separated edge table; short records are kept for their verdict."""
    lines = spark.read.text(path).where(~F.col("value").startswith("page\tsource\t"))
    f = F.split("value", "\t", -1)
    return lines.select(
        F.get(f, F.lit(0)).alias("page"), F.get(f, F.lit(1)).alias("source"), F.get(f, F.lit(2)).alias("pinned_sha"), F.get(f, F.lit(3)).alias("role"), F.size(f).alias("fields")
    )


def usable_edges(spark: SparkSession, path: str) -> bool:
    """Whether an edge table has its header."""
    return spark.read.text(path).where(F.col("value").startswith("page\tsource\t")).limit(1).count() == 1


def page_heads(pages: DataFrame) -> DataFrame:
    """source, sha, status from the first front matter block of mirror pages (path, text)."""
    head = F.regexp_extract("text", r"\A---\n((?:(?!---\n).*\n)*?)---\n", 1)
    value = lambda k: F.nullif(F.regexp_extract(head, rf"(?m)^{k}: (.*)$", 1), F.lit(""))
    return pages.select(F.col("path").alias("source"), value("rendered_sha256").alias("sha"), value("status").alias("status"))


def topic_pages(pages: DataFrame) -> DataFrame:
    """page and its sources (path, sha, role), from front matter lines '  - path: …', 'sha: …', 'role: …'."""
    head = F.regexp_extract("text", r"\A---\n((?:(?!---\n).*\n)*?)---\n", 1)
    entries = F.filter(F.split(head, r"\n\s*-\s+(?=path:)"), lambda e: e.startswith("path:"))
    one = lambda e, k: F.nullif(F.regexp_extract(e, rf"(?m)^\s*{k}:\s*(\S+)", 1), F.lit(""))
    source = F.transform(entries, lambda e: F.struct(one(e, "path").alias("path"), one(e, "sha").alias("sha"), one(e, "role").alias("role")))
    return pages.select(F.col("path").alias("page"), source.alias("sources"))


def audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a JSON-lines log; lines that don't parse are kept apart in _bad."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def sources_from_config(spark: SparkSession, text: str) -> DataFrame:
    """The sources table of a TOML configuration; unknown keys are errors."""
    import hashlib
    import tomllib

    from tidemark.schemas import SOURCE_KINDS

    known = {"id", "kind", "state", "root", "include", "exclude"}
    rows = []
    for s in tomllib.loads(text).get("source", []):
        if set(s) - known or s.get("kind") not in SOURCE_KINDS:
            raise ValueError(f"bad source: {s.get('id')}: {sorted(set(s) - known) or s.get('kind')}")
        scope = json.dumps({k: s.get(k) for k in ("root", "include", "exclude")}, sort_keys=True, separators=(",", ":"))
        rows.append((s["id"], s["kind"], s.get("state", "live"), hashlib.sha256(scope.encode()).hexdigest()))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a source id twice")
    return spark.createDataFrame(rows, "source_id string, kind string, config_state string, config_fingerprint string")


def discovered(candidates: DataFrame, configured: DataFrame) -> DataFrame:
    """Scopes found in several ways (key, name, kind, rank), once each, with whether they are configured."""
    once = candidates.groupBy("key").agg(F.min_by(F.struct("name", "kind"), F.struct("rank", "name")).alias("c")).select("key", "c.*")
    return once.join(configured.select("key").distinct().withColumn("configured", F.lit(True)), "key", "left").na.fill(False, ["configured"])


class Pages(InputPartition):
    def __init__(self, first: str):
        self.first = first


class PagedReader(DataSourceReader):
    """Follows next links of JSON pages from each first page; a link seen before ends the walk."""

    def __init__(self, options: dict):
        self.firsts = json.loads(options["first"])
        self.limit = int(options.get("maxPages", "100000"))

    def partitions(self) -> list[Pages]:
        return [Pages(x) for x in self.firsts]

    def read(self, partition: Pages) -> Iterator[tuple]:
        seen, at, n = set(), partition.first, 0
        while at and at not in seen and n < self.limit:
            seen.add(at)
            with open(at, encoding="utf-8") as f:
                page = json.load(f)
            if not isinstance(page.get("value"), list):
                raise ValueError(f"no list of records in {at}")
            for record in page["value"]:
                yield partition.first, n, json.dumps(record, sort_keys=True)
                n += 1
            at = page.get("@odata.nextLink")


class PagedSource(DataSource):
    """Format 'paged': records of linked JSON pages, one partition for each first page; here the pages are files."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "feed string, seq bigint, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def paged(spark: SparkSession, firsts: list[str]) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("first", json.dumps(firsts)).load()


def cursor_step(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """source_id, action of the next read: delta from a token, resume a link, or a full pass after none, a bad or an
    expired one; a resumed pass is never complete and its token is not kept."""
    rows = state.join(outcomes, "source_id", "left")
    action = (
        F.when(F.col("current_token").isNull() | F.col("outcome").isin("expired", "bad-token"), "full")
        .when(F.col("resume_link").isNotNull(), "resume")
        .otherwise("delta")
    )
    return rows.select("source_id", action.alias("action"), (action != "resume").alias("may_complete"))


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, text of raw web pages."""
    from tidemark.operators.converters import html_text

    @F.pandas_udf("title string, text string")
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_text(x or "") for x in html], columns=["title", "text"])

    return pages.select("page_id", read("html").alias("t")).select("page_id", "t.*")
