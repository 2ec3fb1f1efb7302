"""Secret scan with multipart credential linking.

Strong spans come from three patterns and always stand.  Weak parts (account identifiers, random-looking or assigned
short secrets, endpoints) are common in clean text, so each is reported only where complementary parts meet: an interval
join pairs identifiers with secrets whose reach overlaps inside one scope (a block of lines without a blank line between
them), and endpoints join pairs that they overlap.  The join is a sweep over the sorted parts of one text, so it is a
map over rows: nothing is shuffled and memory is bounded by one text and its spans.

Defined results: null or empty text has no span; repeated rows and null ids get a row each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import small_batches

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short fails from every later start as well
HEX = re.compile(r"[0-9a-f]{16,}")
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9_])(user|username|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9_.@-]{2,63})""", re.ASCII | re.IGNORECASE
)
IDENTIFIER_WORDS = ("user", "login", "account", "client", "key")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,128}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s"'<>]+""")
BLANK = re.compile(r"\n[ \t\r]*\n")
REACH = 200
MIN_ENTROPY = 3.5

Span = tuple[str, int, int]


def strong_spans(text: str) -> list[Span]:
    """The three patterns, leftmost and non-overlapping for each kind; a match that fails its test isn't tried again."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def entropy(word: str) -> float:
    n = len(word)
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values())


def random_looking(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word) and entropy(word) >= MIN_ENTROPY


def weak_parts(text: str, strong: list[Span]) -> list[Span]:
    """Weak identifiers, secrets and endpoints clear of the strong spans; nothing is sought where no pair can come."""
    low = text.lower()
    taken = sorted((a, b) for _, a, b in strong)
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    top = 0
    for k, b in enumerate(ends):  # the furthest end so far, as spans of different kinds nest
        top = ends[k] = max(top, b)

    def clear(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    out = [("identifier", *m.span(2)) for m in IDENTIFIER.finditer(text) if clear(*m.span(2))] if any(w in low for w in IDENTIFIER_WORDS) else []
    if not out and not any(k == "access" for k, _, _ in strong):
        return []
    out += [("secret", m.start(), m.end()) for m in RANDOM.finditer(text) if clear(*m.span()) and random_looking(m[0])]
    out += [("secret", *m.span(2)) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < 12 and clear(*m.span(2))]
    if "://" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text) if clear(*m.span())]
    return out


def linked(text: str, strong: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak parts that meet their complement: identifier with secret, and endpoints with such pairs."""
    if not weak:
        return []
    breaks = [m.start() for m in BLANK.finditer(text)]
    role = {"assign": "secret", "hex": "secret", "access": "identifier"}

    def scope_of(part: Span) -> int:
        return bisect_right(breaks, part[1])

    def widened(part: Span) -> tuple[int, int]:
        scope = scope_of(part)
        low, high = breaks[scope - 1] if scope else 0, breaks[scope] if scope < len(breaks) else len(text)
        return max(low, part[1] - reach), min(high, part[2] + reach)

    def meeting(left: list[Span], right: list[Span]) -> tuple[set[Span], set[Span]]:
        """Interval semi-join both ways, scope by scope: those that begin in time, and of them the one that ends last, tell whether any meets."""
        got = []
        for one, other in ((left, right), (right, left)):
            begins, ends = defaultdict(list), defaultdict(list)
            for start, end, scope in sorted((widened(p)[0], p[2], scope_of(p)) for p in other):
                begins[scope].append(start)
                ends[scope].append(max(end, ends[scope][-1] if ends[scope] else -1))
            hit = set()
            for p in one:
                scope = scope_of(p)
                k = bisect_left(begins[scope], p[2])
                if k and ends[scope][k - 1] > widened(p)[0]:
                    hit.add(p)
            got.append(hit)
        return got[0], got[1]

    ids = [p for p in strong + weak if role.get(p[0], p[0]) == "identifier"]
    secrets = [p for p in strong + weak if role.get(p[0], p[0]) == "secret"]
    with_secret, with_id = meeting(ids, secrets)
    near, _ = meeting([p for p in weak if p[0] == "endpoint"], sorted(with_secret | with_id, key=lambda p: p[1]))
    return sorted((with_secret | with_id | near) & set(weak), key=lambda p: p[1])


def spans_of(text: str | None) -> list[Span]:
    if not text:
        return []
    strong = strong_spans(text)
    found = strong + linked(text, strong, weak_parts(text, strong))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, value) of every row, offsets in code points, ends exclusive."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in spans_of(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": rows})

    picked = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInPandas(found, "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string>>")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return scanned.select("doc_id", *[count(k) for k in STRONG], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
