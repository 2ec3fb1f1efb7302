"""Text extraction: a converter is a function of name and content to units, run in Arrow batches behind the cache.

``convert`` asks the cache first by action key, converts what is missing once, writes it, and serves both from there.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import io
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import action_key, options_hash, route, token_estimate
from tidemark.functions.text import decoded
from tidemark.operators import office, pdf

UNITS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("unit_id", "kind", "title", "body")]))
OUTCOME = T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("units", UNITS)])
Unit = dict[str, str]
#: Converters by suffix.
ROUTES = {
    ".txt": "text", ".csv": "table", ".tsv": "table", ".log": "text", ".json": "text", ".xml": "text", ".yaml": "text", ".yml": "text", ".url": "shortcut",
    ".xlsx": "workbook", ".xlsm": "workbook", ".pptx": "slides", ".potx": "slides", ".docx": "document", ".odt": "document", ".rtf": "rich-text", ".msg": "message", ".pdf": "pdf",
    **dict.fromkeys((".png", ".jpg", ".jpeg", ".tif", ".tiff", ".gif", ".bmp"), "image"), **dict.fromkeys((".mp4", ".m4v", ".mov"), "recording"),
    ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".eml": "mail", ".vtt": "transcript", ".teams.json": "month", ".drawio": "diagram",
}
VERSIONS = dict.fromkeys(sorted(set(ROUTES.values())), "1")


def unit(body: str, title: str = "", unit_id: str = "whole", kind: str = "whole") -> Unit:
    body = re.sub(r"\A\n+", "", body.replace("\r\n", "\n")).rstrip("\n") + "\n"
    return {"unit_id": unit_id, "kind": kind, "title": title, "body": body}


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "blockquote", "pre", "header", "footer", "nav", "main"}
    HIDDEN = {"script", "style", "template", "noscript"}
    #: Tags that may stand in a head; any other begins the body, as the head's end may be left out.
    HEAD = HIDDEN | {"html", "head", "title", "meta", "link", "base"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.in_title, self.in_head = [], 0, "", False, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.in_title = tag == "title" or self.in_title
        self.in_head = tag == "head" or (self.in_head and tag in self.HEAD)
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.in_head = False
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden and (not self.in_head or data.strip()):
            self.in_head = False
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> tuple[str, str]:
    """title and text of a page; scripts and styles are gone, blocks are lines."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return " ".join(p.title.split()), re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def from_text(name: str, text: str) -> list[Unit]:
    first = next((x.strip() for x in text.split("\n") if x.strip()), "")
    return [unit(text if text.strip() else "[empty file]", first[:120] or name)]


def from_table(name: str, text: str, rows: int = 200) -> list[Unit]:
    """The first rows as a table; all of them in a sidecar where there are more."""
    sep = "\t" if name.lower().endswith(".tsv") else ","
    cells = [r for r in csv.reader(text.splitlines(), delimiter=sep) if any(c.strip() for c in r)]
    if not cells:
        return from_text(name, "")
    width = max(map(len, cells))
    whole = io.StringIO()
    csv.writer(whole, lineterminator="\n").writerows(cells)
    show = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r + [""] * (width - len(r))) + " |"
    out = [show(cells[0]), "|" + " --- |" * width, *map(show, cells[1 : rows + 1])]
    if len(cells) <= rows + 1:
        return [unit("\n".join(out), name)]
    out.append(f"\n{len(cells) - rows - 1} more rows in the sidecar")
    return [unit("\n".join(out), name), unit(whole.getvalue(), name, "whole.csv", "sidecar")]


def from_shortcut(name: str, text: str) -> list[Unit]:
    m = re.search(r"(?im)^URL=(\S+)", text)
    return [unit(m[1] if m else "[no target]", name)]


def from_markdown(name: str, text: str) -> list[Unit]:
    m = re.match(r"---\n(.*?)\n---\n?", text, re.DOTALL)
    body = text[m.end() :] if m else text
    own = re.search(r"(?m)^title:\s*(.+)$", m[1]) if m else None
    heading = re.search(r"(?m)^#{1,6}\s+(.+?)\s*#*$", body)
    title = own[1].strip("\"' ") if own else heading[1] if heading else next((x.strip() for x in body.split("\n") if x.strip()), name)[:120]
    return [unit((f"```yaml\n{m[1]}\n```\n\n" if m else "") + body, title)]


def from_html(name: str, text: str) -> list[Unit]:
    title, body = html_text(text)
    return [unit(body or "[no text]", title or name)]


def from_mail(name: str, text: str) -> list[Unit]:
    msg = email.message_from_string(text, policy=email.policy.default)
    body = msg.get_body(("plain", "html"))
    said = "" if body is None else body.get_content()
    if body is not None and body.get_content_type() == "text/html":
        said = html_text(said)[1]
    head = [f"**{k}:** {msg[k]}" for k in ("From", "To", "Date", "Subject") if msg[k]]
    parts = []
    for n, a in enumerate(msg.iter_attachments(), 1):
        data = a.get_payload(decode=True) or b""
        parts.append(f"| {n} | {a.get_filename() or ''} | {a.get_content_type()} | {len(data)} | {hashlib.sha256(data).hexdigest()} |")
    table = ["", "| n | name | type | bytes | sha256 |", "| --- | --- | --- | --- | --- |", *parts] if parts else []
    return [unit("\n".join([*head, "", said.strip(), *table]), str(msg["Subject"] or name))]


def cues(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, speaker, words of a transcript's cues, in start order."""
    out = []
    stamp = r"(?:(\d+):)?(\d\d):(\d\d)\.(\d{3})"
    names = {"amp": "&", "lt": "<", "gt": ">", "nbsp": " ", "lrm": "", "rlm": ""}
    plain = lambda s: " ".join(re.sub(r"&(amp|lt|gt|nbsp|lrm|rlm);", lambda m: names[m[1]], re.sub(r"<[^>]*>", "", s)).split())
    for block in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n"))[1:]:
        rows = block.strip("\n").split("\n")
        if re.match(r"(NOTE|STYLE|REGION)\b", rows[0]):
            continue
        at = 0 if "-->" in rows[0] else 1
        m = re.match(rf"\s*{stamp}\s+-->\s+{stamp}", rows[at]) if at < len(rows) else None
        if not m:
            continue
        ms = [((int(h or 0) * 60 + int(mi)) * 60 + int(s)) * 1000 + int(f) for h, mi, s, f in (m.groups()[:4], m.groups()[4:])]
        for piece in re.split(r"(?=<v[ .])|</v>", "\n".join(rows[at + 1 :])):
            v = re.match(r"<v(?:\.[^\s>]*)?\s+([^>]*)>", piece)
            if said := plain(piece):
                out.append((*ms, plain(v[1]) if v else "", said))
    return sorted(out, key=lambda c: c[0])


def clock(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}"


def joined_turns(said: list[tuple[int, int, str, str]], pause: int = 1000) -> list[tuple[int, int, str, str]]:
    out: list[tuple[int, int, str, str]] = []
    for a, b, who, words in said:
        if out and who and out[-1][2] == who and a - out[-1][1] < pause:
            out[-1] = (out[-1][0], max(out[-1][1], b), who, f"{out[-1][3]} {words}")
        else:
            out.append((a, b, who, words))
    return out


def from_transcript(name: str, text: str) -> list[Unit]:
    return [unit("\n".join(f"[{clock(a)}] {who or '?'}: {words}" for a, _, who, words in joined_turns(cues(text))) or "[no words]", name)]


def from_month(name: str, text: str) -> list[Unit]:
    doc = json.loads(text)
    rows = sorted(doc["messages"], key=lambda m: (m["created"], m["id"]))
    ids = {m["id"] for m in rows}
    tops = [m for m in rows if m.get("reply_to_id") not in ids]
    under = {t["id"]: [m for m in rows if m.get("reply_to_id") == t["id"]] for t in tops}

    def show(m: dict, mark: str) -> list[str]:
        edited = " (edited)" if m.get("last_modified") and m["last_modified"] != m["created"] else ""
        said = "[deleted]" if m.get("deleted") else html_text(m.get("body_html") or "")[1] or "[empty message]"
        note = ["(reply to a message outside this month)"] if m.get("reply_to_id") and not mark else []
        return [f"{mark}### {m['created']} {m.get('from', '')}{edited}", *note, *(mark + x for x in said.split("\n")), ""]

    out = [f"# {doc.get('team_name', '')} / {doc.get('channel_name', '')} {doc.get('month', '')}", f"{len(rows)} messages in {len(tops)} threads", ""]
    for t in tops:
        out += show(t, "")
        for r in under[t["id"]]:
            out += show(r, "> ")
    return [unit("\n".join(out), out[0][2:])]


def from_diagram(name: str, text: str) -> list[Unit]:
    """Edges between labelled shapes of an uncompressed diagram, and the labels by themselves."""
    import xml.etree.ElementTree as ET

    cells = {c.get("id"): c for c in ET.fromstring(text).iter("mxCell")}
    label = lambda i: html_text(cells[i].get("value") or "")[1] if i in cells else ""
    out = [f"- {x}" for i, c in cells.items() if c.get("vertex") and (x := label(i))]
    for i, c in cells.items():
        if c.get("edge"):
            a, b, mid = label(c.get("source")), label(c.get("target")), label(i)
            if a or b or mid:
                out.append(f"- {a or '?'} -> {b or '?'}" + (f": {mid}" if mid else ""))
    return [unit("\n".join(out) or "[no labels]", name)]


CONVERTERS: dict[str, Callable[[str, str], list[Unit]]] = {
    "text": from_text, "table": from_table, "shortcut": from_shortcut, "markdown": from_markdown, "html": from_html, "mail": from_mail,
    "transcript": from_transcript, "month": from_month, "diagram": from_diagram,
}


#: Converters of bytes that are no text.
BINARY: dict[str, Callable[[str, bytes], list[Unit]]] = {
    "workbook": office.from_workbook, "slides": office.from_slides, "document": office.from_document, "rich-text": office.from_rich_text, "message": office.from_message, "pdf": pdf.from_pdf,
}


WINDOW_MS = 300_000


def from_image(name: str, data: bytes, read: Callable[[bytes], list[str]]) -> list[Unit]:
    """The lines that an engine reads in a picture."""
    lines = [x for x in read(data) if x.strip()]
    return [unit("\n".join(lines) or "[no text in the picture]", name)]


def from_recording(name: str, data: bytes, read: Callable[[bytes], list[tuple[int, int, str, str]]]) -> list[Unit]:
    """An index, and a unit for each window of five minutes with the turns that an engine hears; a turn over a boundary is in both."""
    turns = joined_turns(sorted(read(data), key=lambda c: c[0]))
    windows: dict[int, list[str]] = {}
    for a, b, who, words in turns:
        for k in range(a // WINDOW_MS, max(a, b - 1) // WINDOW_MS + 1):
            windows.setdefault(k, []).append(f"[{clock(a)}] {who or '?'}: {words}")
    speakers = list(dict.fromkeys(who for _, _, who, _ in turns if who))
    index = [f"# {name}", f"{len(turns)} turns, {len(windows)} windows, speakers: {', '.join(speakers) or 'unknown'}", *(f"- {clock(k * WINDOW_MS)}: {len(x)} turns" for k, x in sorted(windows.items()))]
    return [unit("\n".join(index), name, "00-index", "index"), *(unit("\n".join(x), f"{name} {clock(k * WINDOW_MS)}", f"w{k + 1:03d}", "window") for k, x in sorted(windows.items()))]


#: Kinds that need an engine handed in, and the form of what it gives.
WITH_ENGINE = {"image": from_image, "recording": from_recording}
Engines = dict[str, tuple[str, Callable]]


def outcome(name: str, kind: str | None, data: bytes | None, engines: Engines) -> tuple[str, str | None, list[Unit]]:
    """Status, reason and units of one file; its own faults are outcomes."""
    if kind is None or kind not in CONVERTERS and kind not in BINARY and kind not in WITH_ENGINE:
        return "refused", "no converter", []
    if not data:
        return "unreadable", "empty", []
    if kind in WITH_ENGINE and kind not in engines:
        return "refused", f"no engine for {kind}", []
    try:
        if kind in WITH_ENGINE:
            return "ok", None, WITH_ENGINE[kind](name, data, engines[kind][1])
        if kind in BINARY:
            return "ok", None, BINARY[kind](name, data)
        text = decoded(data)
        return ("unreadable", "binary content", []) if text is None else ("ok", None, CONVERTERS[kind](name, text))
    except Exception as e:  # noqa: BLE001  the file's fault is its own outcome
        return "failed", f"{type(e).__name__}: {e}"[:200], []


def converted(engines: Engines):
    """The converters as a function of columns (name, kind, content); one bad file is a row, never a failed task."""

    @F.pandas_udf(OUTCOME)
    def each(names: pd.Series, kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [outcome(n, k, None if c is None else bytes(c), engines) for n, k, c in zip(names, kinds, contents, strict=True)]
        return pd.DataFrame(rows, columns=["status", "reason", "units"])

    return each


@F.pandas_udf(T.StringType())
def canonical_sha256(contents: pd.Series) -> pd.Series:
    """The hash that decides whether content changed: what a save alone changes is left out."""
    return contents.map(lambda data: None if data is None else office.canonical_hash(bytes(data)))


def planned(files: DataFrame, engines: Engines | None = None) -> DataFrame:
    """files (path, name, content) with converter, canonical hash and action key; an engine's version is part of the key."""
    kind = route("name", ROUTES)
    version = F.lit("1")
    for name in WITH_ENGINE:
        version = F.when(kind == name, F.lit(f"1+{(engines or {}).get(name, ('unavailable',))[0]}")).otherwise(version)
    hashed = files.withColumn("canonical_sha256", canonical_sha256("content"))
    key = action_key(F.coalesce(kind, F.lit("none")), version, options_hash({"rows": F.lit("200")}), F.lit("whole"), F.col("canonical_sha256"))
    return hashed.withColumns({"converter_id": kind, "action_key": key})


def convert(files: DataFrame, cache: DataFrame | None = None, engines: Engines | None = None) -> DataFrame:
    """path, action_key, status, reason, unit_id, kind, title, body, tokens: one row a unit (or one for a file without).

    files: path, name, content, or what ``planned`` made of them.  cache: action_key and the rest of these; files whose key it has are not converted.  engines: by kind (image, recording)
    a version and a function of bytes, to lines of text or to cues (start_ms, end_ms, speaker, words).
    """
    rows = files if "action_key" in files.columns else planned(files, engines)
    todo = rows if cache is None else rows.join(cache.select("action_key").distinct(), "action_key", "left_anti")
    once = todo.dropDuplicates(["action_key"]).select("action_key", converted(engines or {})("name", "converter_id", "content").alias("c"))
    units = once.select("action_key", "c.status", "c.reason", F.explode_outer("c.units").alias("u")).select("action_key", "status", "reason", "u.*")
    served = units if cache is None else units.unionByName(cache.select(*units.columns))
    return rows.select("path", "action_key").join(served, "action_key").withColumn("tokens", token_estimate("body"))


def threads(messages: DataFrame, by: list[str]) -> DataFrame:
    """Messages (by, id, reply_to_id, created) in reading order: thread (its top), place, is_reply.

    A message is a top if it has no parent or its parent is not there; a reply hangs under its direct parent, and one
    whose parent is itself a reply is not shown.
    """
    tops = messages.alias("m").join(messages.select(*by, F.col("id").alias("__p")).alias("p"), [*[F.col(f"m.{c}") == F.col(f"p.{c}") for c in by], F.col("m.reply_to_id") == F.col("p.__p")], "left")
    tops = tops.select("m.*", F.col("p.__p").isNotNull().alias("is_reply"))
    heads = tops.where("not is_reply").select(*by, F.col("id").alias("thread"), F.col("created").alias("__start"))
    shown = tops.withColumn("thread", F.when(F.col("is_reply"), F.col("reply_to_id")).otherwise(F.col("id"))).join(heads, [*by, "thread"])
    from pyspark.sql import Window as W

    order = W.partitionBy(*by).orderBy("__start", "thread", "is_reply", "created", "id")
    return shown.withColumn("place", F.row_number().over(order)).drop("__start")


def said_in(transcripts: DataFrame) -> DataFrame:
    """path, seq, start_ms, end_ms, speaker, text of the cues of transcripts (path, text)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, *c) for p, t in zip(batch["path"], batch["text"], strict=True) for n, c in enumerate(cues(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "seq", "start_ms", "end_ms", "speaker", "text"])

    return transcripts.select("path", "text").mapInPandas(read, "path string, seq bigint, start_ms bigint, end_ms bigint, speaker string, text string")
