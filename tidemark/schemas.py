"""Table schemas and closed value domains of a document collection's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Closed domains.
SOURCE_KINDS = ("local", "inbox", "graph_drive", "graph_mail", "graph_teams")
SOURCE_STATES = ("paused", "live", "retired")
PASS_KINDS = ("delta", "full_enumeration")
ROW_STATES = ("live", "dataless", "tombstone", "quarantined", "refused")
VERDICTS = (
    "created", "unchanged", "maybe_changed", "metadata_only", "dataless", "touched_not_changed", "changed",
    "output_unchanged", "deleted", "deletion_candidate", "deferred", "quarantined", "refused", "error",
)
OUTPUT_STATUSES = ("ok", "failed", "skipped-dataless", "quarantined", "refused", "tombstone")
PAGE_STATUSES = ("current", "deleted", "superseded", "unreadable", "refused", "archived")
UNIT_KINDS = ("whole", "index", "sheet", "summary", "window")
CHANGE_OPS = ("A", "M", "R", "D")
PENDING = ("created", "maybe_changed", "changed", "deferred", "error")
QUIET = ("unchanged", "metadata_only", "dataless")
PRESENT = ("live", "dataless", "quarantined", "refused")


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "map<string,bigint>": T.MapType(T.StringType(), T.LongType()),
    "parts": T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("sha256", T.StringType())])),
}


def _struct(text: str) -> T.StructType:
    """'name type, …' without a session: modules must import before one is there."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(" ") for x in text.split(", "))])


OBSERVATION = _struct(
    "source_id string, stable_id string, seq bigint, rel_path string, name string, parent_id string, is_dir boolean, size bigint, mtime_ns bigint, "
    "ctime_ns bigint, created_ns bigint, ino bigint, mode bigint, gen_count bigint, dataless boolean, deleted boolean, quickxor string, sha1 string, "
    "sha256_remote string, etag string, ctag string, content_type string, extra map<string,string>"
)
ITEM = _struct(
    "source_id string, stable_id string, rel_path string, prev_path string, name string, parent_id string, is_dir boolean, size bigint, mtime_ns bigint, "
    "ctime_ns bigint, created_ns bigint, ino bigint, mode bigint, gen_count bigint, dataless boolean, quickxor string, sha1 string, sha256_remote string, "
    "etag string, ctag string, content_type string, content_sha256 string, canonical_sha256 string, canonical_method string, "
    "canonical_parts parts, state string, state_reason string, last_verdict string, first_seen_run bigint, "
    "last_seen_run bigint, absent_since_run bigint, extra map<string,string>"
)
OUTPUT = _struct(
    "output_path string, source_id string, stable_id string, unit_id string, action_key string, rendered_sha256 string, page_sha256 string, "
    "converter_id string, converter_version string, options_hash string, status string, built_run bigint"
)
TOMBSTONE = _struct("output_path string, source_id string, stable_id string, unit_id string, deleted_at date, deleted_run bigint, last_rendered_sha256 string, reap_after date, reason string")
SOURCE = _struct(
    "source_id string, kind string, config_state string, config_fingerprint string, enumeration_complete boolean, baseline_complete boolean, "
    "last_full_run_id bigint, last_success_run_id bigint, breaker_tripped_at timestamp, breaker_until timestamp, breaker_candidates bigint"
)
CURSOR = _struct("source_id string, current_token string, pending_token string, resume_link string, pending_run bigint")
CACHE = _struct("action_key string, converter_id string, converter_version string, options_hash string, body string, body_sha256 string, created_run bigint")
RUN = _struct("run_id bigint, mode string, started_at timestamp, finished_at timestamp, outcome string, counts map<string,bigint>")
RUN_SOURCE = _struct("run_id bigint, source_id string, pass_kind string, enumeration_complete boolean, outcome string")
DEPENDS = _struct("page string, source string, pinned_sha string, role string")
UNIT_CACHE = _struct("action_key string, unit_id string, kind string, title string, body string, created_run bigint")
PAGE = _struct("path string, text string")
FAILURE = _struct("source_id string, stable_id string, failures bigint, failed_sha256 string")
PASS = _struct("source_id string, last_full_run bigint")
PIECE = _struct("job string, piece bigint, key string, state string, run_id bigint, result string")
ALIAS = _struct("source_id string, old_id string, new_id string, origin boolean")
TABLES = {
    "items": ITEM, "outputs": OUTPUT, "tombstones": TOMBSTONE, "sources": SOURCE, "cursors": CURSOR, "cache": CACHE, "runs": RUN, "run_sources": RUN_SOURCE,
    "depends": DEPENDS, "aliases": ALIAS, "unit_cache": UNIT_CACHE, "pages": PAGE, "failures": FAILURE, "passes": PASS, "pieces": PIECE,
}

DOMAINS = {"kind": SOURCE_KINDS, "config_state": SOURCE_STATES, "pass_kind": PASS_KINDS, "state": ROW_STATES, "last_verdict": VERDICTS, "op": CHANGE_OPS}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns and types of a schema; columns that df lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def domain_findings(df: DataFrame) -> DataFrame:
    """column, value, n of values outside their closed domain."""
    checks: list[Column] = [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, values in DOMAINS.items() if c in df.columns
    ]
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    found = df.select(F.explode(F.array(*checks)).alias("f")).where("f is not null").select("f.*")
    return found.groupBy("column", "value").agg(F.count("*").alias("n"))
