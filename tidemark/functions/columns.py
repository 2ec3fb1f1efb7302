"""Scalar functions as column expressions: they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
KEY_SCHEMA_VERSION = "1"
DASHES = "‐‑‒–—―−﹘﹣－"
AGENT_NAMES = ("claude", "agents", "gemini", "copilot-instructions", "cursorrules", "windsurfrules")
SIZE_UNITS = {"": 1, "b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "kib": 1024, "mib": 1024**2, "gib": 1024**3}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(c).cast("timestamp_ntz"))


def sha(c: Column | str, digits: int = 64) -> Column:
    """sha256 in hex, or its first digits."""
    full = F.sha2(col(c).cast("binary"), 256)
    return full if digits == 64 else F.substring(full, 1, digits)


def action_key(converter_id: Column, version: Column, options_hash: Column, unit_id: Column, canonical: Column) -> Column:
    """The cache key of one unit of one conversion; null if any part is (a null must not shorten the key)."""
    parts = [F.lit(KEY_SCHEMA_VERSION), converter_id, version, options_hash, unit_id, canonical]
    return sha(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("|"))][:-1]))


def sorted_json(pairs: dict[str, Column]) -> Column:
    """A compact JSON object of string values with its keys in order."""
    return F.to_json(F.struct(*[pairs[k].cast("string").alias(k) for k in sorted(pairs)]))


def json_set(c: Column | str, key: str, value: Column) -> Column:
    """A JSON object with a key set (last in order) to a value given as JSON text; other values stay as they are.  Null for what is no object."""
    held = F.from_json(col(c), "map<string,variant>")
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(value))))


def json_remove(c: Column | str, *keys: str) -> Column:
    """A JSON object without some keys."""
    return F.to_json(F.map_filter(F.from_json(col(c), "map<string,variant>"), lambda k, _: ~k.isin(*keys)))


def options_hash(pairs: dict[str, Column]) -> Column:
    return F.concat(F.lit("sha256:"), sha(sorted_json(pairs)))


def rollup_hash(parts: Column, header: str = "") -> Column:
    """sha256 over sorted (name, NUL, digest, newline) lines of an array of structs (name, digest)."""
    lines = F.transform(F.array_sort(parts), lambda p: F.concat(p["name"], F.lit("\0"), p["digest"], F.lit("\n")))
    return sha(F.concat(F.lit(header), F.array_join(lines, "")))


def folder_digest(parts: Column) -> Column:
    """sha256 over sorted 'path sha' lines of an array of structs (name, digest)."""
    return sha(F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(p["name"], F.lit(" "), p["digest"], F.lit("\n"))), ""))


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(col(c)) / 4).cast("bigint")


def suffix(name: Column | str) -> Column:
    """The lower-case suffix: .teams.json whole, else from the last dot; a leading dot is none."""
    low = F.lower(col(name))
    return F.when(low.endswith(".teams.json") & (F.length(low) > 11), F.lit(".teams.json")).otherwise(F.regexp_extract(low, r"^.+(\.[^./]*[^./])$", 1))


def route(name: Column | str, routes: dict[str, str], default: str | None = None) -> Column:
    """The converter of the longest suffix that a name ends in."""
    low, out = F.lower(col(name)), F.lit(default)
    for ending in sorted(routes, key=lambda s: (len(s), s)):
        out = F.when(low.endswith(ending) & (F.length(low) > len(ending)), routes[ending]).otherwise(out)
    return out


def glob_pattern(glob: str) -> str:
    """An anchored, case-blind regular expression for a path glob.

    ``**`` crosses folders, ``*`` and ``?`` stay in one; a glob without a slash is for the name at any depth; a closing
    slash means all that is under it.
    """
    deep = "/" in glob.strip().rstrip("/")
    body = glob.strip().lstrip("/") + ("**" if glob.strip().endswith("/") else "")
    spec = re.compile(r"\*\*/|\*\*|\*|\?|\[!?[^\]]*\]|.", re.DOTALL)

    def one(m: re.Match) -> str:
        t = m[0]
        fixed = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        if t in fixed:
            return fixed[t]
        if len(t) > 2 and t[0] == "[":
            inner = t[1:-1].replace("\\", "\\\\").replace("[", "\\[")
            return "[^" + inner[1:] + "]" if inner[0] == "!" else f"[{inner}]"
        return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", t) if ord(t[0]) < 128 else t

    return "(?i)^" + ("" if deep else "(?:.*/)?") + spec.sub(one, body) + "$"


def glob_match(path: Column | str, glob: str) -> Column:
    return col(path).rlike(glob_pattern(glob))


def in_scope(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Some include glob matches (none means all) and no exclude glob does."""
    inside, outside = F.lit(not include), F.lit(False)
    for g in include:
        inside = inside | glob_match(path, g)
    for g in exclude:
        outside = outside | glob_match(path, g)
    return inside & ~outside


def pruned(path: Column | str, exclude: list[str]) -> Column:
    """Whether an exclude glob takes the path itself or a folder above it."""
    parts = F.split(col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    any_of = "|".join(f"(?:{glob_pattern(g)})" for g in exclude)
    return F.exists(prefixes, lambda p: p.rlike(any_of)) if exclude else F.lit(False)


def escape_glob(folder: Column | str) -> Column:
    """A folder name as an exclude glob: its glob characters each in brackets, and all under it."""
    return F.concat(F.regexp_replace(col(folder), r"([*?\[])", r"[$1]"), F.lit("/"))


def fold_copy_suffix(name: Column | str, rounds: int = 6) -> Column:
    """A name without ' (1)', ' - Copy' and default host suffixes before its extension, to a fixed point."""
    stem = F.regexp_replace(col(name), r"(?<=.)\.[^.]*$", "")
    ext = F.substr(col(name), F.length(stem) + 1)
    for _ in range(rounds):
        stem = F.regexp_replace(stem, r"(?i)(?<=\S)(?: \([0-9]+\)| - copy(?: \([0-9]+\))?|-(?:desktop|laptop)-[a-z0-9]{7})$", "")
    return F.concat(stem, ext)


def neutral_name(segment: Column | str) -> Column:
    """A path segment that agent tools or version control don't load: no leading dot, no instruction stem."""
    plain = F.regexp_replace(col(segment), r"^\.+", "dot-")
    return F.regexp_replace(plain, rf"(?i)^({'|'.join(AGENT_NAMES)})(?=\.|$)", "$1-doc")


def markdown_plain(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"([\\`*_\[\]<>#|])", r"\\$1")


def markdown_cell(c: Column | str) -> Column:
    """Text for a table cell: bars escaped, line ends and blanks made one blank."""
    return F.regexp_replace(F.trim(F.regexp_replace(col(c), r"\s+", " ")), r"\|", r"\\|")


def fence_width(c: Column | str) -> Column:
    """Back-ticks that a fence around the text needs: one more than its longest run, three at least."""
    runs = F.regexp_extract_all(col(c), F.lit("(`+)"), F.lit(1))
    return F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) + 1)


def body_text(c: Column | str) -> Column:
    """A body with line feeds only, no blank lines before it and one line end after it (composed letters: text.nfc)."""
    lines = F.regexp_replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), r"\A\n+|\n+\z", "")
    return F.concat(lines, F.lit("\n"))


def headings(c: Column | str) -> Column:
    """ATX headings outside fenced code, in order."""
    bare = F.regexp_replace(col(c), r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?(?:^\1[^\n]*$|\z)", "")
    return F.regexp_extract_all(bare, F.lit(r"(?m)^#{1,6}[ \t]+([^\n]*?)[ \t]*#*[ \t]*$"), F.lit(1))


def first_line(c: Column | str, width: int = 120) -> Column:
    """The first line that is not blank, trimmed and cut."""
    return F.substring(F.trim(F.regexp_extract(col(c), r"(?m)^[ \t]*(\S[^\n]*)$", 1)), 1, width)


def title(c: Column | str) -> Column:
    """The title in a front matter block, else the first heading, else the first line."""
    front = F.regexp_extract(col(c), r"\A---\n(?:(?!---\n).*\n)*?title:[ \t]*([^\n]*)\n", 1)
    return F.coalesce(F.nullif(front, F.lit("")), F.get(headings(c), F.lit(0)), first_line(c))


def join_limited(items: Column, room: int, sep: str = "; ") -> Column:
    """Items joined while they fit in ``room`` characters; an ellipsis shows that some did not."""
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        longer = F.when(a["text"] == "", x).otherwise(F.concat(a["text"], F.lit(sep), x))
        full = a["full"] | (F.length(longer) > room)
        return F.struct(F.when(full, a["text"]).otherwise(longer).alias("text"), full.alias("full"))

    return F.aggregate(items, zero, step, lambda a: F.when(a["full"], F.concat(a["text"], F.lit("…"))).otherwise(a["text"]))


def csv_field(c: Column | str) -> Column:
    """A field of a comma-separated line, quoted where it must be."""
    return F.when(col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(col(c))


def column_letters(n: Column | str) -> Column:
    """Spreadsheet letters of a column number from 1: A, Z, AA … up to three letters."""
    n = col(n).cast("bigint")
    letter = lambda k: F.chr((65 + k).cast("bigint"))
    a, b, c = (n - 1) % 26, F.floor((n - 27) / 26) % 26, F.floor((n - 703) / 676) % 26
    return F.when(n < 1, F.lit("")).when(n <= 26, letter(a)).when(n <= 702, F.concat(letter(b), letter(a))).otherwise(F.concat(letter(c), letter(b), letter(a)))


def type_label(c: Column | str) -> Column:
    """bool, int, float, date/time or text of a value written as text; a whole float is an int; null stays null."""
    v = col(c)
    number = v.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    value = v.try_cast("double")
    return (
        F.when(v.isNull(), None)
        .when(F.lower(v).isin("true", "false"), "bool")
        .when(number & (value == F.floor(value)), "int")
        .when(number, "float")
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:.]+(?:Z|[+-][0-9:]+)?)?$"), "date/time")
        .otherwise("text")
    )


def iso_ns(c: Column | str) -> Column:
    """Nanoseconds since 1970 of an ISO 8601 UTC time with any number of fraction digits."""
    v = col(c)
    seconds = F.unix_timestamp(F.to_timestamp(F.regexp_extract(v, r"^([0-9-]{10}[T ][0-9:]{8})", 1).try_cast("timestamp")))
    digits = F.substring(F.rpad(F.regexp_extract(v, r"\.([0-9]+)", 1), 9, "0"), 1, 9)
    return seconds * 1_000_000_000 + F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0))


def ns_iso(c: Column | str) -> Column:
    """A fixed ISO time in milliseconds of nanoseconds since 1970."""
    millis = F.floor(col(c).cast("decimal(19,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("bigint")
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def cue_ms(c: Column | str) -> Column:
    """Milliseconds of a cue time, [HH:]MM:SS.mmm."""
    part = lambda k: F.regexp_extract(col(c), r"^(?:([0-9]+):)?([0-9]{2}):([0-9]{2})\.([0-9]{3})$", k)
    return ((F.coalesce(F.nullif(part(1), F.lit("")).cast("bigint"), F.lit(0)) * 60 + part(2).cast("bigint")) * 60 + part(3).cast("bigint")) * 1000 + part(4).cast("bigint")


def clock(ms: Column | str) -> Column:
    """HH:MM:SS of milliseconds, floored."""
    s = F.floor(col(ms) / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("string")
    return F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), two(F.floor(s / 60) % 60), two(s % 60))


def decode_entities(c: Column | str) -> Column:
    """Six character references in one pass: the ampersand comes last."""
    out = col(c)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&lrm;", "‎"), ("&rlm;", "‏"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def message_path(created: Column, sender: Column, subject: Column) -> Column:
    part = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(""))
    return F.concat(F.date_format(created, "yyyy/MM/yyyy-MM-dd"), F.lit("-"), F.coalesce(part(sender), F.lit("unknown")), F.lit("-"), F.coalesce(part(subject), F.lit("no-subject")), F.lit(".eml"))


def reap_date(deleted: Column, days: int = 180) -> Column:
    return F.date_add(deleted, days)


def age_text(days: Column) -> Column:
    return F.when(days < 1, "today").when(days < 2, "1 day").when(days < 60, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months")))


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[\s\p{Cc}]+", " "))


def tsv_safe(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\t\r\n]", " ")


def parse_size(c: Column | str) -> Column:
    """Bytes of '500MB', '2 GiB' or a bare number; null if it is none of these."""
    v = F.lower(F.trim(col(c)))
    unit = F.regexp_extract(v, r"^[0-9]+(?:\.[0-9]+)? ?([kmg]i?b|b|)$", 1)
    scale = F.lit(None).cast("bigint")
    for name, factor in SIZE_UNITS.items():
        scale = F.when(unit == name, factor).otherwise(scale)
    return F.when(v.rlike(r"^[0-9]+(?:\.[0-9]+)? ?(?:[kmg]i?b|b)?$"), (F.regexp_extract(v, r"^([0-9.]+)", 1).try_cast("decimal(20,4)") * scale).cast("bigint"))


def guid(c: Column | str) -> Column:
    """A GUID without braces, in lower case; null if it is none."""
    v = F.lower(F.regexp_replace(F.trim(col(c)), r"^\{|\}$", ""))
    return F.when(v.rlike(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), v)


def label_header(c: Column | str) -> Column:
    """key=value; key=value of a label header as a map with lower-case keys."""
    return F.transform_keys(F.str_to_map(F.regexp_replace(col(c), r"\s*([;=])\s*", "$1"), F.lit(";"), F.lit("=")), lambda k, v: F.lower(k))


def redact_path(c: Column | str) -> Column:
    return sha(c, 12)


def home_to_tilde(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"/(?:Users|home)/[^/\s]+", "~")


def redact_url(c: Column | str) -> Column:
    """A URL without user information and query."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?<=://)[^/@\s]*@", ""), r"\?[^\s#]*", "?…")


def sharing_id(url: Column | str) -> Column:
    """u! and the URL in unpadded URL-safe base64."""
    code = F.regexp_replace(F.base64(F.encode(col(url), "UTF-8")), r"[\r\n=]", "")
    return F.concat(F.lit("u!"), F.translate(code, "+/", "-_"))


def container_kind(content: Column) -> Column:
    """The container that the first bytes name."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304"), "zip").when(head == "D0CF11E0A1B11AE1", "ole2").when(head.startswith("25504446"), "pdf").otherwise("other")


def allowed_remote(url: Column | str, base: str) -> Column:
    """Same scheme, user and host as the base URL, and its path or one below it."""
    same = F.lit(True)
    for part in ("PROTOCOL", "AUTHORITY"):
        same = same & F.try_parse_url(col(url), F.lit(part)).eqNullSafe(F.try_parse_url(F.lit(base), F.lit(part)))
    path, root = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), re.sub(r"^[a-z]+://[^/]*|[?#].*$", "", base).rstrip("/")
    return same & ((path == root) | path.startswith(root + "/"))


def quote_held(text: Column | str, quote: Column | str) -> Column:
    """Whether the pieces of a quote, split at three dots, stand in the text in order."""
    pieces = F.filter(F.transform(F.split(col(quote), r"\.\.\.|…"), lambda p: F.trim(p)), lambda p: p != "")

    def step(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, col(text), at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(piece))

    return F.aggregate(pieces, F.lit(1), step) > 0
