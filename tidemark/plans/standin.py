"""Stand-in listings made from ``documents`` by fixed arithmetic, written as SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame

WRITTEN_AT = 1_700_000_000_000_900_000

#: What both sides hold for a document.
COMMON = {
    "source_id": "source",
    "stable_id": "concat('d', CAST(doc_id AS STRING))",
    "name": "concat(CAST(doc_id AS STRING), '.txt')",
    "parent_id": "concat('p', CAST(doc_id % 10 AS STRING))",
    "is_dir": "doc_id % 43 = 0",
    "ctime_ns": "1700000000000000000 + doc_id * 1000",
    "created_ns": "CAST(NULL AS BIGINT)",
    "ino": "doc_id + 7",
    "mode": "CAST(33188 AS BIGINT)",
    "sha256_remote": "CAST(NULL AS STRING)",
    "content_type": "CAST(NULL AS STRING)",
}
OBSERVED = COMMON | {
    "seq": "doc_id",
    "rel_path": "concat(lang, '/f', CAST(doc_id % 10 AS STRING), '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 11 = 0 THEN '-new' ELSE '' END, '.txt')",
    "size": "n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END",
    "mtime_ns": "1700000000000000000 + doc_id * 1000 + CASE WHEN doc_id % 9 = 0 OR doc_id % 47 = 0 THEN 5 ELSE 0 END",
    "gen_count": "CAST(CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 53 = 0 THEN 2 WHEN doc_id % 61 = 0 THEN 4 ELSE 3 END AS BIGINT)",
    "dataless": "doc_id % 19 = 0",
    "deleted": "doc_id % 23 = 0",
    "quickxor": "CASE WHEN doc_id % 3 = 0 THEN md5(concat(text, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END)) END",
    "sha1": "CASE WHEN doc_id % 59 = 0 THEN md5(text) END",
    "etag": "CASE WHEN doc_id % 4 = 0 THEN concat('e', CAST(doc_id AS STRING), CASE WHEN doc_id % 8 = 0 THEN '-2' ELSE '' END) END",
    "ctag": "CASE WHEN doc_id % 6 = 1 THEN concat('c', CAST(doc_id AS STRING), CASE WHEN doc_id % 5 = 1 THEN '-2' ELSE '' END) END",
}
STORED = COMMON | {
    "rel_path": "concat(lang, '/f', CAST(doc_id % 10 AS STRING), '/', CAST(doc_id AS STRING), '.txt')",
    "prev_path": "CAST(NULL AS STRING)",
    "size": "n_chars",
    "mtime_ns": "1700000000000000000 + doc_id * 1000",
    "gen_count": "CAST(3 AS BIGINT)",
    "dataless": "doc_id % 19 = 0",
    "quickxor": "CASE WHEN doc_id % 3 = 0 THEN md5(text) END",
    "sha1": "CASE WHEN doc_id % 59 = 0 THEN md5(text) END",
    "etag": "CASE WHEN doc_id % 4 = 0 THEN concat('e', CAST(doc_id AS STRING)) END",
    "ctag": "CASE WHEN doc_id % 6 = 1 THEN concat('c', CAST(doc_id AS STRING)) END",
    "content_sha256": "CASE WHEN doc_id % 37 = 0 THEN NULL ELSE md5(text) END",
    "canonical_sha256": "CASE WHEN doc_id % 37 = 0 THEN NULL ELSE md5(lower(text)) END",
    "canonical_method": "'bytes@1'",
    "state": "CASE WHEN doc_id % 29 = 0 THEN 'tombstone' WHEN doc_id % 19 = 0 THEN 'dataless' WHEN doc_id % 67 = 0 THEN 'quarantined' ELSE 'live' END",
    "state_reason": "CAST(CASE WHEN doc_id % 67 = 0 THEN 'secret' END AS STRING)",
    "last_verdict": "CASE WHEN doc_id % 31 = 0 THEN 'changed' WHEN doc_id % 62 = 1 THEN 'created' ELSE 'unchanged' END",
    "first_seen_run": "CAST(1 AS BIGINT)",
    "last_seen_run": "5 + doc_id % 2",
    "absent_since_run": "CAST(CASE WHEN doc_id % 26 = 0 THEN 6 WHEN doc_id % 39 = 0 THEN 7 END AS BIGINT)",
}
LISTED, KNOWN = "doc_id % 13 <> 0", "doc_id % 17 <> 0"


def observed(documents: DataFrame) -> DataFrame:
    return documents.where(LISTED).selectExpr(*[f"{e} AS {n}" for n, e in OBSERVED.items()])


def stored(documents: DataFrame) -> DataFrame:
    return documents.where(KNOWN).selectExpr(*[f"{e} AS {n}" for n, e in STORED.items()])


def sql(columns: dict[str, str], where: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM documents WHERE {where}"


#: The two listings as common table expressions.
CTES = f"WITH observed AS ({sql(OBSERVED, LISTED)}), stored AS ({sql(STORED, KNOWN)})"
