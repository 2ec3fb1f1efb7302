"""Lints, content screening and policy over pages and items: each returns findings, and a gate counts the blocking ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import quote_held
from tidemark.functions.front import read_front
from tidemark.functions.text import RESERVED, nfc_fold, slugify
from tidemark.schemas import PAGE_STATUSES

#: What stands for a password without being one (a bracketed hint or placeholder, a mask, prose, a status word, and
#: the placeholders of a URL), and the rules that a page may not break; the first hit of a rule on a page counts.
HINT = r"(?:\((?:[^()\s]*\s[^()]*|[a-z_-]*)\)|<(?:[^<>\s]*\s[^<>]*|[a-z_-]*)>|\[(?:[^\[\]\s]*\s[^\[\]]*|[a-z_-]*)\]|\{(?:[^{}\s]*\s[^{}]*|[a-z_-]*)\})"
MASK = r"""[*x.•-]+[,;:!?)\]}>"']*(?!\S)"""
PROSE = r"[A-Za-z]+,?\s+[a-z0-9]"
STATUS = r"(?:required|optional|unknown|none|expired|blank|empty|same|provided|reset|sent|n/?a|tbd|tba|pending|disabled|enabled|changed|temporary|default|hidden|redacted)[,;.!?)\]]*(?!\S)"
NO_URL_PASSWORD = rf"(?:{HINT}|[*x•.-]+@|\$\{{[^}}]*\}}|%[a-z(]|(?:password|passwd|pass|pwd|secret|token|redacted)@)"
SECRET_RULES = {
    "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "azure-conn-string": r"AccountKey=[A-Za-z0-9+/=]{40,}",
    "generic-password": rf"\b(?i:password|pwd)\s*(?:=|:(?!\s*{PROSE}))\s*(?i:(?:{HINT}\s*)?(?!{HINT})(?!{MASK})(?!{STATUS}))\S{{6,}}",
    "url-credential": rf"(?i)\b[a-z][a-z0-9+.-]*://[^\s/?#@:]*:(?!{NO_URL_PASSWORD})[^\s/?#@]{{3,}}@",
    "slack-token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b",
    "github-token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
}
#: Hosts of meeting links, whose pass code is an invitation and no secret; and the shape of a token.
MEETING_HOSTS = r"(?:(?:gov\.|dod\.)?teams\.microsoft\.(?:com|us)|teams\.live\.com|teams\.cloud\.microsoft)"
MEETING_CODE = rf"""(?i)((?:^|(?<=[\s"'<>(\[]))https?://{MEETING_HOSTS}(?::\d+)?(?=[/?#])[^\s"'<>]*?)[?&]pwd=[^&#\s"'<>()]*"""
TOKEN_LEAK = r"\bBearer\s+[A-Za-z0-9._~+/=-]{20,}|(?:\$?(?:delta|skip)|access_|refresh_|id_)?token=[^\s&\"'<>]{16,}"
FINDING = "rule string, path string, detail string, blocking boolean"


#: The forms of a basis on which a person is named, besides a quoted heard tag, and the one that names whose audio is shared.
BASIS_FORMS = r"(?i)^(?:VOICE line|service transcript tag, one-person check passed|voice \d+, on shared audio of .+|mixed|voice \d+, unidentified)$"
#: Segments that the slug leaves as they are, unless their stem is reserved; most are, and need no call of it.
PLAIN_SEGMENT, RESERVED_STEM = r"^[a-z0-9_.-]*[a-z0-9_-]\z", rf"^(?:{'|'.join(sorted(RESERVED))})(?:\.|\z)"
SHARED_BASIS = r"(?i)^voice \d+, on shared audio of (.+?)(?:, \d+ voices)?$"


def finding(rule: str, path: Column, detail: Column, blocking: bool = True) -> list[Column]:
    return [F.lit(rule).alias("rule"), path.alias("path"), detail.cast("string").alias("detail"), F.lit(blocking).alias("blocking")]


def breaks(rule: str, line: Column) -> Column:
    """Whether a line breaks a secret rule."""
    seen = F.regexp_replace(line, MEETING_CODE, "$1") if rule == "generic-password" else line
    return seen.rlike(SECRET_RULES[rule])


def secret_hits(pages: DataFrame, text: str = "text") -> DataFrame:
    """path, rule, line of the first hit of each rule on a page, one pass over its lines."""
    lines = pages.where(F.col(text).isNotNull()).select("path", F.posexplode(F.split(text, "\n")).alias("line", "said"))
    tests = F.array_compact(F.array(*[F.when(breaks(name, F.col("said")), F.lit(name)) for name in SECRET_RULES]))
    return lines.select("path", "line", F.explode(tests).alias("rule")).groupBy("path", "rule").agg((F.min("line") + 1).cast("bigint").alias("line"))


def token_leaks(pages: DataFrame, known: list[str] = (), text: str = "text") -> DataFrame:
    """Pages with a token-shaped value, or a known one of 16 characters or more."""
    hit = F.col(text).rlike(TOKEN_LEAK)
    for k in known:
        if len(k) >= 16:
            hit = hit | F.contains(text, F.lit(k))
    return pages.where(hit).select("path")


def screened(pages: DataFrame, text: str = "text") -> DataFrame:
    """path, action: publish; stub (a secret in the body); redact (one in the name that the stub would show); block."""
    body = secret_hits(pages, text).select("path").distinct().withColumn("__body", F.lit(True))
    rules = reduce(lambda a, b: a | b, [breaks(rule, F.col("title")) for rule in SECRET_RULES])
    path_rules = reduce(lambda a, b: a | b, [breaks(rule, F.col("path")) for rule in SECRET_RULES])
    rows = pages.join(body, "path", "left")
    action = F.when(~F.coalesce("__body", F.lit(False)), "publish").when(path_rules, "block").when(rules, "redact").otherwise("stub")
    return rows.select("path", action.alias("action"))


def label_policy(items: DataFrame, excluded: list[str], refuse_unlabelled: bool = False) -> DataFrame:
    """Items (labels: array of string, null if unreadable) with refused and the first label that refuses them."""
    folded = F.array(*[F.lit(x.lower()) for x in excluded]) if excluded else F.array().cast("array<string>")
    hit = F.get(F.filter("labels", lambda x: F.array_contains(folded, F.lower(x))), F.lit(0))
    why = F.when(hit.isNotNull(), F.concat(F.lit("label "), hit)).when(
        F.lit(refuse_unlabelled) & (F.col("labels").isNull() | (F.size("labels") == 0)), F.when(F.col("labels").isNull(), "labels unreadable").otherwise("no label")
    )
    return items.withColumn("refused", why.isNotNull()).withColumn("why", why)


def page_findings(pages: DataFrame) -> DataFrame:
    """A page's contract: a status of the closed set, and a body that is what its digest says."""
    bad = pages.where(~F.coalesce(F.col("status").isin("current", "deleted", "superseded", "unreadable", "refused", "archived"), F.lit(False)))
    body = pages.where(~F.sha2(F.col("body").cast("binary"), 256).eqNullSafe(F.col("rendered_sha256")))
    return bad.select(*finding("page-status", F.col("path"), F.col("status"))).unionByName(body.select(*finding("page-body-hash", F.col("path"), F.col("rendered_sha256"))))


#: The keys that a page's head must have, with the form of each value as JSON.
HEAD_KEYS = {"rendered_sha256": '"[0-9a-f]{64}"', "source_id": '".+"', "source_path": '".+"', "status": '".*"'}


def contract_findings(pages: DataFrame) -> DataFrame:
    """What breaks the contract of mirror pages (path, text): a head that can't be read or is not in its canonical form, a key that is missing
    or of another kind, a status outside the closed set, a body that is not what its digest says."""
    read = pages.select("path", read_front("text").alias("f")).select("path", "f.*").withColumn("bad", F.col("error").isNotNull())
    value = lambda k: F.element_at("values", F.lit(k))
    rule = lambda name, holds, detail: F.when(holds, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    whole = ~F.col("bad")
    tests = [rule("front-malformed", F.col("bad"), F.col("error")), rule("front-form", whole & ~F.col("canonical"), F.lit("not canonical"))]
    for k, form in HEAD_KEYS.items():
        tests += [rule("front-missing", whole & value(k).isNull(), F.lit(k)), rule("front-kind", whole & ~value(k).rlike(f"(?s)^{form}$"), F.lit(k))]
    known = F.substring(value("status"), 2, F.length(value("status")) - 2).isin(*PAGE_STATUSES)
    tests.append(rule("page-status", whole & value("status").startswith('"') & ~known, value("status")))
    digest = F.concat(F.lit('"'), F.sha2(F.col("body").cast("binary"), 256), F.lit('"'))
    tests.append(rule("page-body-hash", whole & value("rendered_sha256").rlike("^" + HEAD_KEYS["rendered_sha256"] + "$") & (digest != value("rendered_sha256")), value("rendered_sha256")))
    found = read.select("path", F.explode(F.array_compact(F.array(*tests))).alias("x"))
    return found.select(F.col("x.rule").alias("rule"), "path", F.col("x.detail").alias("detail"), F.lit(True).alias("blocking"))


def path_findings(paths: DataFrame, longest: int = 200) -> DataFrame:
    """Paths too long, with segments that the slug would change, or that are one with another under the fold."""
    long = paths.where(F.length("path") > longest).select(*finding("path-length", F.col("path"), F.length("path")))
    each = paths.select("path", F.explode(F.split("path", "/")).alias("__segment"))
    plain = F.col("__segment").rlike(PLAIN_SEGMENT) & ~F.col("__segment").rlike(RESERVED_STEM)
    odd = each.where(~plain).where(~slugify("__segment").eqNullSafe(F.col("__segment"))).select("path").distinct()
    segment = odd.select(*finding("path-segment", F.col("path"), F.lit("not portable")))
    twins = paths.withColumn("__key", nfc_fold("path")).groupBy("__key").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).where("n > 1")
    return long.unionByName(segment).unionByName(twins.select(*finding("path-twin", F.col("path"), F.col("n"))))


def index_findings(indexes: DataFrame, max_bytes: int = 25_000, max_lines: int = 200) -> DataFrame:
    lines = F.size(F.split("text", "\n"))
    over = indexes.where((F.octet_length("text") > max_bytes) | (lines > max_lines))
    return over.select(*finding("index-budget", F.col("path"), lines, False))


def determinism_findings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Units (path, unit_id, sha) that two conversions of one file gave differently, or only one of them gave."""
    a, b = first.select("path", "unit_id", F.col("sha").alias("x")), second.select("path", "unit_id", F.col("sha").alias("y"))
    return a.join(b, ["path", "unit_id"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(*finding("not-deterministic", F.col("path"), F.col("unit_id")))


def citation_findings(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations (page, source, quote) whose source is missing, or whose quote doesn't stand in it."""
    rows = cites.join(pages.select(F.col("path").alias("source"), F.col("text").alias("__text")), "source", "left")
    missing = rows.where("__text is null").select(*finding("MISSING", F.col("page"), F.col("source")))
    unquoted = rows.where(F.col("__text").isNotNull() & F.col("quote").isNotNull()).where(~quote_held("__text", "quote")).select(*finding("QUOTE", F.col("page"), F.col("source")))
    return missing.unionByName(unquoted)


def evidence_findings(rows: DataFrame, units: DataFrame, lines: DataFrame, decisions: DataFrame, opened: DataFrame) -> DataFrame:
    """The rules for rows of a meeting's page: every tag resolves, its quote stands there, and what needs evidence has it.

    rows: path, section, row, tags (array of struct(kind, recording, second, quote)), basis, person, refs (decisions that an
    inference names), noted (that the picture wasn't kept).  units: recording, window; lines: recording, second, channel, text;
    decisions: path, id; opened: path, recording, second (of the frames that were looked at).  Tag kinds: seen, seen+frame,
    heard, inferred, and free ones (file, chat).
    """
    each = rows.select("path", "section", "row", F.explode("tags").alias("t")).select("path", "section", "row", "t.*")
    timed = each.where("kind in ('seen', 'seen+frame', 'heard')").withColumn("channel", F.when(F.col("kind") == "heard", "heard").otherwise("seen"))
    timed = timed.withColumn("window", (F.floor(F.col("second") / 300) + 1).cast("bigint"))
    known = units.select("recording", "window", F.lit(True).alias("__unit")).distinct()
    said = lines.groupBy("recording", "second", "channel").agg(F.collect_list("text").alias("__said"))  # lines of one second
    met = timed.join(known, ["recording", "window"], "left").join(said, ["recording", "second", "channel"], "left")
    where = F.concat_ws(" ", F.col("section"), F.col("row").cast("string"))
    lost = met.where("__said is null").select(*finding("CITE-UNRESOLVED", F.col("path"), F.concat(where, F.when(F.col("__unit").isNull(), ": no unit").otherwise(": no line")), False))
    odd = met.where(F.col("__said").isNotNull() & F.col("quote").isNotNull() & ~F.exists("__said", lambda t: quote_held(t, F.col("quote"))))
    unquoted = odd.select(*finding("CITE-QUOTE", F.col("path"), where, False))
    free = lambda t: t["kind"].isin("seen", "seen+frame", "heard", "file", "chat")
    quoted = F.exists("tags", lambda t: free(t) & t["quote"].isNotNull())
    inferred = F.exists("tags", lambda t: t["kind"] == "inferred") & ~F.exists("tags", free)
    asked = rows.where(F.col("section").isin("decisions", "action items", "numbers shown"))
    missing = asked.where(~quoted & ~((F.col("section") == "action items") & inferred & (F.size("refs") > 0)))
    missing = missing.select(*finding("CITE-MISSING", F.col("path"), where, False))
    frames = timed.where("section = 'numbers shown' and kind = 'seen+frame'").join(opened.select("path", "recording", "second", F.lit(True).alias("__opened")).distinct(), ["path", "recording", "second"], "left")
    unopened = frames.where("__opened is null").select(*finding("CITE-FRAME", F.col("path"), where, False))
    no_frame = asked.where((F.col("section") == "numbers shown") & ~F.exists("tags", lambda t: t["kind"] == "seen+frame") & ~F.col("noted")).select(*finding("CITE-FRAME", F.col("path"), where, False))
    refs = rows.where(inferred).select("path", "section", "row", F.explode_outer("refs").alias("id")).join(decisions.select("path", "id", F.lit(True).alias("__known")).distinct(), ["path", "id"], "left")
    baseless = refs.groupBy("path", "section", "row").agg(F.bool_and(F.col("__known").isNotNull()).alias("ok")).where("not ok")
    baseless = baseless.select(*finding("CITE-INFERRED", F.col("path"), where, False))
    people = rows.where("section = 'people'")
    heard = F.exists("tags", lambda t: (t["kind"] == "heard") & t["quote"].isNotNull())
    basis = people.where(~F.coalesce(F.col("basis").rlike(BASIS_FORMS) | heard, F.lit(False))).select(*finding("CITE-BASIS", F.col("path"), where, False))
    shared = people.where(F.lower(F.regexp_extract("basis", SHARED_BASIS, 1)) == F.lower("person")).where("person <> ''").select(*finding("CITE-SHARED", F.col("path"), where, False))
    return reduce(lambda x, y: x.unionByName(y), [lost, unquoted, missing, unopened, no_frame, baseless, basis, shared])


def gate(*findings: DataFrame) -> DataFrame:
    """blocking, advisory: a run lands only if nothing blocks."""
    every = reduce(lambda a, b: a.unionByName(b), findings)
    return every.agg(F.count_if("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("advisory"))


def checkpoint_blockers(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on pages that changed since a base."""
    return findings.join(changed.select("path").distinct(), "path", "left_semi")


def escalated(outputs: DataFrame, refused: DataFrame) -> DataFrame:
    """Published outputs of items that a label now refuses: their cache goes and a purge is queued."""
    return outputs.where("status = 'ok'").join(refused.where("refused").select("source_id", "stable_id"), ["source_id", "stable_id"], "left_semi").select(
        "source_id", "stable_id", "output_path", "action_key", F.lit("label-escalation").alias("reason")
    )


def adopted(pages: DataFrame, known: DataFrame, run_id: int) -> DataFrame:
    """Pages that no run wrote, with a stamp of where they came from."""
    return pages.join(known.select("path"), "path", "left_anti").withColumn("provenance", F.lit(f"adopted in run {run_id}"))
