"""Text of zipped office files, rich text and compound message files, read with the standard library.

Each reader takes a name and bytes and gives units (unit_id, kind, title, body), and sidecars of kind ``sidecar`` that hold in
full what a unit shows in part.
"""

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter

Unit = dict[str, str]
SHOWN_ROWS, INDEX_TERMS = 200, 400
#: Built-in number formats that show dates or times, and parts and attributes of a file that change on every save.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
VOLATILE_PARTS = ("docProps/core.xml", "docProps/app.xml", "docProps/thumbnail", "xl/calcChain.xml")
VOLATILE_NAMES = ("rsid", "paraId", "textId", "revision", "lastEdited")


def make(body: str, title: str, unit_id: str = "whole", kind: str = "whole") -> Unit:
    text = re.sub(r"\A\n+", "", body.replace("\r\n", "\n")).rstrip("\n") + "\n"
    return {"unit_id": unit_id, "kind": kind, "title": title, "body": text}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def children(node, name: str) -> list:
    return [x for x in node if local(x.tag) == name]


def below(node, name: str) -> list:
    return [x for x in node.iter() if local(x.tag) == name]


def attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


class Package:
    """A zip of XML parts with relations between them."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, part: str):
        return ET.fromstring(self.zip.read(part)) if part in self.names else None

    def targets(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id: kind and target part."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        if root is None:
            return {}
        where = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], where(r.get("Target", ""))) for r in root if r.get("TargetMode") != "External"}


def cell_line(cells: list[str]) -> str:
    return "| " + " | ".join(" ".join(c.split()).replace("|", "\\|") for c in cells) + " |"


def table(rows: list[list[str]], shown: int = SHOWN_ROWS) -> str:
    """A table of the first rows, the first of them as its header."""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    out = [cell_line(rows[0]), "|" + " --- |" * width, *map(cell_line, rows[1 : shown + 1])]
    return "\n".join(out) + (f"\n\n{len(rows) - shown - 1} more rows in the sidecar" if len(rows) > shown + 1 else "")


def comma_lines(rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shown_number(text: str, is_date: bool, epoch_1904: bool) -> str:
    try:
        value = float(text)
    except ValueError:
        return text
    if not is_date:
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    day = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)
    when = day + dt.timedelta(seconds=round(value * 86400))
    return when.time().isoformat() if value < 1 else when.date().isoformat() if value == int(value) else when.isoformat(" ")


def sheet_cells(root, strings: list[str], dates: list[bool], epoch_1904: bool) -> dict[tuple[int, int], str]:
    """Values by (row, column); a merged range holds its origin's value in every cell."""
    cells, at = {}, 0
    for row in below(root, "row"):
        at = int(row.get("r", at + 1))
        col = 0
        for c in children(row, "c"):
            col = column_number(c.get("r", "")) or col + 1
            kind, v = c.get("t", "n"), next((x.text or "" for x in children(c, "v")), None)
            if kind == "inlineStr":
                v = "".join(x.text or "" for x in below(c, "t"))
            elif kind == "s" and v is not None:
                v = strings[int(v)]
            elif kind == "b" and v is not None:
                v = "true" if v == "1" else "false"
            elif kind == "n" and v is not None:
                style = int(c.get("s", 0))
                v = shown_number(v, style < len(dates) and dates[style], epoch_1904)
            if v:
                cells[at, col] = v
    for merge in below(root, "mergeCell"):
        a, _, b = merge.get("ref", "").partition(":")
        (r1, c1), (r2, c2) = ((int(re.sub(r"\D", "", x) or 0), column_number(x)) for x in (a, b or a))
        if (r1, c1) in cells and (r2 - r1 + 1) * (c2 - c1 + 1) <= 100_000:
            for r in range(r1, r2 + 1):
                for c in range(c1, c2 + 1):
                    cells[r, c] = cells[r1, c1]
    return cells


def from_workbook(name: str, data: bytes) -> list[Unit]:
    """An index unit, a unit for each sheet, and a sidecar with all rows of a sheet that is shown in part."""
    p = Package(data)
    book = p.xml("xl/workbook.xml")
    related = p.targets("xl/workbook.xml")
    shared = p.xml("xl/sharedStrings.xml")
    strings = [] if shared is None else ["".join(t.text or "" for t in below(s, "t")) for s in children(shared, "si")]
    styles, dates = p.xml("xl/styles.xml"), []
    if styles is not None:
        custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in below(styles, "numFmt")}
        for formats in children(styles, "cellXfs"):
            dates = [int(x.get("numFmtId", 0)) in DATE_FORMATS or bool(re.search("[ymdhs]", custom.get(int(x.get("numFmtId", 0)), ""))) for x in children(formats, "xf")]
    old_epoch = any(attribute(x, "date1904") in ("1", "true") for x in below(book, "workbookPr"))
    units, index, terms = [], [], Counter()
    for n, sheet in enumerate(below(book, "sheet"), 1):
        kind, part = related.get(attribute(sheet, "id"), ("", ""))
        root, title = p.xml(part), sheet.get("name", f"Sheet{n}")
        if root is None or kind != "worksheet":
            index.append([str(n), title, kind or "missing", "", ""])
            continue
        cells = sheet_cells(root, strings, dates, old_epoch)
        unit_id = f"{n:02d}-{title}"
        if not cells:
            index.append([str(n), title, "empty", "0", "0"])
            units.append(make(f"# {title}\n\n[empty sheet]", title, unit_id, "sheet"))
            continue
        top, left = min(r for r, _ in cells), min(c for _, c in cells)
        bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
        used = sorted({r for r, _ in cells})
        grid = [[cells.get((r, c), "") for c in range(left, right + 1)] for r in used]
        area = f"{column_name(left)}{top}:{column_name(right)}{bottom}"
        hidden = " (hidden)" if sheet.get("state", "visible") != "visible" else ""
        index.append([str(n), title + hidden, area, str(len(used)), str(right - left + 1)])
        units.append(make(f"# {title}\n\nRange {area}, {len(used)} rows\n\n{table(grid)}", title, unit_id, "sheet"))
        if len(grid) > SHOWN_ROWS + 1:
            units.append(make(comma_lines(grid), title, f"{unit_id}.csv", "sidecar"))
        terms.update(" ".join(v.split()) for v in cells.values() if re.search(r"[^\W\d_]", v) and len(v) <= 80)
    top_terms = sorted(sorted(terms, key=lambda t: (-terms[t], t.casefold(), t))[:INDEX_TERMS], key=lambda t: (t.casefold(), t))
    body = f"# {name}\n\n{table([['n', 'sheet', 'range', 'rows', 'columns'], *index], len(index))}\n\nTerms: {'; '.join(top_terms)}"
    return [make(body, name, "00-index", "index"), *units]


def paragraphs(node) -> list[str]:
    """Lines of drawing text: one for each paragraph."""
    out = []
    for p in below(node, "p"):
        out.append("".join("\n" if local(x.tag) == "br" else x.text or "" for x in p.iter() if local(x.tag) in ("t", "br")))
    return [x for x in out if x.strip()]


def from_slides(name: str, data: bytes) -> list[Unit]:
    """One unit: a section for each slide, its shapes from the top to the bottom and from left to right, tables and notes."""
    p = Package(data)
    related, out, titles = p.targets("ppt/presentation.xml"), [], []
    for n, entry in enumerate(below(p.xml("ppt/presentation.xml"), "sldId"), 1):
        part = related.get(next((v for k, v in entry.attrib.items() if k.endswith("}id")), ""), ("", ""))[1]
        root = p.xml(part)
        if root is None:
            continue
        shapes, title = [], ""
        for k, s in enumerate(x for x in root.iter() if local(x.tag) in ("sp", "graphicFrame")):
            off = next(iter(below(s, "off")), None)
            place = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
            holder = next((x.get("type", "") for x in below(s, "ph")), "")
            if grid := below(s, "tr"):
                lines = [table([[" ".join(paragraphs(c)) for c in children(r, "tc")] for r in grid], len(grid))]
            else:
                lines = paragraphs(s)
            if holder in ("title", "ctrTitle") and lines and not title:
                title = " ".join(lines)
            elif lines and holder not in ("sldNum", "dt", "ftr"):
                shapes.append((place[0], place[1], k, lines))
        rows: list[list[tuple]] = []
        for s in sorted(shapes):  # shapes whose tops are close are one row, read from the left
            if rows and s[0] - rows[-1][0][0] <= 300_000:
                rows[-1].append(s)
            else:
                rows.append([s])
        out.append(f"## Slide {n}" + (f": {title}" if title else ""))
        out += ["\n".join(s[3]) for row in rows for s in sorted(row, key=lambda s: (s[1], s[0], s[2]))]
        titles.append(title)
        for kind, target in p.targets(part).values():
            if kind == "notesSlide" and (notes := p.xml(target)) is not None:
                said = [x for s in below(notes, "sp") if any(h.get("type") == "body" for h in below(s, "ph")) for x in paragraphs(s)]
                out += ["> " + "\n> ".join(said)] if said else []
    return [make("\n\n".join(out) or "[no slides]", next((t for t in titles if t), name))]


def from_document(name: str, data: bytes) -> list[Unit]:
    """One unit: headings, paragraphs, lists and tables of a word processor's file, deletions left out; notes at the end."""
    p = Package(data)
    if "content.xml" in p.names:
        return from_open_document(name, p)
    styles = {}
    if (sheet := p.xml("word/styles.xml")) is not None:
        for s in children(sheet, "style"):
            label = next((attribute(x, "val") or "" for x in children(s, "name")), "")
            if m := re.fullmatch(r"(?i)heading (\d)", label):
                styles[attribute(s, "styleId")] = int(m[1])
            elif label.lower() == "title":
                styles[attribute(s, "styleId")] = 1

    def said(node) -> str:
        out = []
        for x in node:
            tag = local(x.tag)
            if tag in ("del", "moveFrom", "instrText"):
                continue
            out.append(x.text or "" if tag == "t" else "\t" if tag == "tab" else "\n" if tag in ("br", "cr") else said(x))
        return "".join(out)

    def blocks(node) -> list[str]:
        out = []
        for x in node:
            tag = local(x.tag)
            if tag == "p":
                text = " ".join(said(x).split(" ")).strip()
                style = next((attribute(s, "val") for s in below(x, "pStyle")), None)
                if text:
                    out.append("#" * min(6, styles[style]) + " " + text if style in styles else "- " + text if below(x, "numPr") else text)
            elif tag == "tbl":
                rows = [[" ".join(" ".join(blocks(c)).split()) for c in children(r, "tc")] for r in children(x, "tr")]
                out += [table(rows, len(rows))] if rows and any(rows) else []
            elif tag in ("sdt", "sdtContent", "customXml", "ins", "body"):
                out += blocks(x)
        return out

    body = blocks(p.xml("word/document.xml"))
    for part in ("word/footnotes.xml", "word/endnotes.xml", "word/comments.xml"):
        if (notes := p.xml(part)) is not None:
            body += [f"[{local(x.tag)} {attribute(x, 'id')}] " + " ".join(" ".join(blocks(x)).split()) for x in notes if blocks(x)]
    core = p.xml("docProps/core.xml")
    own = "" if core is None else next(((x.text or "").strip() for x in below(core, "title")), "")
    head = next((x.lstrip("# ") for x in body if x.startswith("#")), "")
    return [make("\n\n".join(body) or "[no text]", own or head or name)]


def from_open_document(name: str, p: Package) -> list[Unit]:
    def said(node) -> str:
        out = [node.text or ""]
        for x in node:
            tag = local(x.tag)
            out.append(" " * int(attribute(x, "c") or 1) if tag == "s" else "\t" if tag == "tab" else "\n" if tag == "line-break" else "" if tag == "note" else said(x))
            out.append(x.tail or "")
        return "".join(out)

    def blocks(node, mark: str = "") -> list[str]:
        out = []
        for x in node:
            tag = local(x.tag)
            if tag in ("h", "p") and said(x).strip():
                out.append(("#" * min(6, int(attribute(x, "outline-level") or 1)) + " " if tag == "h" else mark) + said(x).strip())
            elif tag == "list":
                out += [y for item in children(x, "list-item") for y in blocks(item, "- ")]
            elif tag == "table":
                rows = [[" ".join(" ".join(blocks(c)).split()) for c in r if local(c.tag) == "table-cell"] for r in below(x, "table-row")]
                out += [table(rows, len(rows))] if rows and any(rows) else []
            elif tag in ("section", "text", "body", "list-item"):
                out += blocks(x, mark)
        return out

    text = next(iter(below(p.xml("content.xml"), "text")), None)
    body = [] if text is None else blocks(text)
    meta = p.xml("meta.xml")
    own = "" if meta is None else next(((x.text or "").strip() for x in below(meta, "title")), "")
    return [make("\n\n".join(body) or "[no text]", own or next((x.lstrip("# ") for x in body if x.startswith("#")), "") or name)]


SKIPPED_GROUPS = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "datastore", "listtable", "listoverridetable", "rsidtbl"}


def from_rich_text(name: str, data: bytes) -> list[Unit]:
    """The running text of a rich text file: control words give line ends, tabs and characters, other groups are left out."""
    text, out, skip, stack, room, after = data.decode("latin-1"), [], False, [], 1, 0
    for m in re.finditer(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", text):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, room))
        elif brace == "}":
            skip, room = stack.pop() if stack else (False, 1)
        elif sign == "*" or word in SKIPPED_GROUPS:
            skip = True
        elif skip:
            continue
        elif word == "uc":
            room = int(number or 1)
        elif word == "u":
            out.append(chr(int(number or 0) % 65536))
            after = room
        elif code and after:
            after -= 1
        elif code:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif word in ("par", "line", "row", "sect", "page"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif sign == "~":
            out.append("\u00a0")
        elif plain:
            out.append(plain[after:])
            after = max(0, after - len(plain))
    said = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()
    return [make(said or "[no text]", next((x.strip() for x in said.split("\n") if x.strip()), name)[:120])]


class Compound:
    """A compound file: a small file system of streams in sectors."""

    END = 0xFFFFFFFE

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("no compound file")
        self.data, self.size, self.mini = data, 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first, _, cutoff, mini_fat, n_mini, more, n_more = struct.unpack_from("<IIIIIIII", data, 44)
        self.cutoff, heads, seen = cutoff, list(struct.unpack_from("<109I", data, 76)), set()
        while n_more and more < self.END and more not in seen:
            seen.add(more)
            block = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            heads += block[:-1]
            more = block[-1]
        self.fat = [x for s in heads[:n_fat] if s < self.END for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        self.mini_fat = list(struct.unpack(f"<{n_mini * self.size // 4}I", self.chain(mini_fat)[: n_mini * self.size])) if n_mini else []
        listing, self.entries = self.chain(first), []
        for at in range(0, len(listing) - 127, 128):
            length = struct.unpack_from("<H", listing, at + 64)[0]
            label = listing[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", listing, at + 68)
            start, size = struct.unpack_from("<IQ", listing, at + 116)
            self.entries.append((label, listing[at + 66], left, right, child, start, size & 0xFFFFFFFF if self.size == 512 else size))
        self.small = self.chain(self.entries[0][5])

    def sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def chain(self, start: int) -> bytes:
        out, at, seen = [], start, set()
        while at < self.END and at not in seen:
            seen.add(at)
            out.append(self.sector(at))
            at = self.fat[at] if at < len(self.fat) else self.END
        return b"".join(out)

    def stream(self, entry: tuple) -> bytes:
        start, size = entry[5], entry[6]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, at, seen = [], start, set()
        while at < self.END and at not in seen:
            seen.add(at)
            out.append(self.small[at * self.mini : (at + 1) * self.mini])
            at = self.mini_fat[at] if at < len(self.mini_fat) else self.END
        return b"".join(out)[:size]

    def inside(self, entry: tuple) -> list[tuple]:
        """The entries of a storage, a tree of siblings."""
        out, todo, seen = [], [entry[4]], set()
        while todo:
            k = todo.pop()
            if k < len(self.entries) and k not in seen:
                seen.add(k)
                out.append(self.entries[k])
                todo += [self.entries[k][2], self.entries[k][3]]
        return sorted(out)


#: Property numbers of a message and of its attachments.
PROPERTIES = {"0037": "Subject", "0C1A": "From", "0E04": "To", "0E03": "Cc", "1000": "body", "3707": "file", "3704": "short", "3701": "content"}


def from_message(name: str, data: bytes) -> list[Unit]:
    """A mail client's message file: sender, recipients, subject, plain body, and a list of its attachments."""
    c = Compound(data)

    def read(entry: tuple) -> dict[str, object]:
        out: dict[str, object] = {}
        for e in c.inside(entry):
            if (m := re.fullmatch(r"__substg1\.0_([0-9A-F]{4})([0-9A-F]{4})", e[0])) and m[1] in PROPERTIES and e[1] == 2:
                raw = c.stream(e)
                out[PROPERTIES[m[1]]] = raw.decode("utf-16-le", "replace") if m[2] == "001F" else raw.decode("cp1252", "replace") if m[2] == "001E" else raw
        return out

    props = read(c.entries[0])
    head = [f"**{k}:** {props[k]}" for k in ("From", "To", "Cc", "Subject") if props.get(k)]
    rows = []
    for e in c.inside(c.entries[0]):
        if e[0].startswith("__attach_version1.0") and e[1] == 1:
            a = read(e)
            content = a.get("content", b"")
            content = content if isinstance(content, bytes) else b""
            rows.append([str(len(rows) + 1), str(a.get("file") or a.get("short") or ""), str(len(content)), hashlib.sha256(content).hexdigest()])
    listed = ["", table([["n", "name", "bytes", "sha256"], *rows], len(rows))] if rows else []
    return [make("\n".join([*head, "", str(props.get("body") or "[no text]").replace("\r\n", "\n").strip(), *listed]), str(props.get("Subject") or name))]


def canonical_parts(data: bytes) -> dict[str, str]:
    """part: sha256 of what a zipped office file says; parts and attributes that change on every save are left out."""
    p, out = Package(data), {}
    for part in sorted(p.names):
        if part.endswith("/") or part.startswith(VOLATILE_PARTS):
            continue
        raw = p.zip.read(part)
        if part.endswith((".xml", ".rels")):
            try:
                root = ET.fromstring(raw)
            except ET.ParseError:
                root = None
            if root is not None:
                for x in root.iter():
                    for k in [k for k in x.attrib if local(k).startswith(VOLATILE_NAMES)]:
                        del x.attrib[k]
                    for y in [y for y in x if local(y.tag).startswith(VOLATILE_NAMES)]:
                        x.remove(y)
                raw = ET.canonicalize(ET.tostring(root, encoding="unicode")).encode()
        out[part] = hashlib.sha256(raw).hexdigest()
    return out


def canonical_hash(data: bytes) -> str:
    """The hash of a file's bytes, or of the canonical parts of a zipped office file."""
    if data[:4] != b"PK\x03\x04":
        return hashlib.sha256(data).hexdigest()
    try:
        parts = canonical_parts(data)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
        return hashlib.sha256(data).hexdigest()
    return hashlib.sha256("".join(f"{k}\0{v}\n" for k, v in parts.items()).encode()).hexdigest()
