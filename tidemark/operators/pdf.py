"""The text layer of PDF files, read with the standard library: pages in order, lines by position, notes of annotations.

Fonts are read through their Unicode maps, simple fonts without one as western text.  Encrypted files fail as such; a page with
few characters is named as one that holds a picture.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from tidemark.operators.office import Unit, make

LEAST_CHARACTERS = 20
TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|\[|\]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)|\(|<|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|.)", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name object."""


class Word(str):
    """An operator or keyword."""


class Ref(int):
    """A reference to an object by its number."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets, which may nest, from behind the first bracket."""
    out, depth = [], 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(bytes([int(m[0], 8) & 255]))
                at = m.end()
            elif data[at + 1 : at + 2] in (b"\r", b"\n"):
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            else:
                c = data[at + 1 : at + 2]
                out.append(ESCAPES.get(c, c))
                at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out.append(c)
    return b"".join(out), at


def objects(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Objects one after the other, each with the place behind it."""
    while at < len(data) and (m := TOKEN.match(data, at)):
        token, at = m[1], m.end()
        if token == b"<<" or token == b"[":
            items, close = [], b">>" if token == b"<<" else b"]"
            for x, end in objects(data, at):
                at = end
                if isinstance(x, Word) and x.encode("latin-1") == close:
                    break
                if isinstance(x, Word) and x == "R" and len(items) > 1 and isinstance(items[-2], int):
                    items[-2:] = [Ref(items[-2])]
                else:
                    items.append(x)
            yield (dict(zip(items[::2], items[1::2], strict=False)) if token == b"<<" else items), at
        elif token == b"(":
            text, at = literal(data, at)
            yield text, at
        elif token == b"<":
            end = data.find(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at : end if end >= 0 else len(data)])
            at = end + 1 if end >= 0 else len(data)
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif token[:1] == b"/":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:]).decode("latin-1")), at
        elif re.fullmatch(rb"[+-]?\d+", token):
            yield int(token), at
        elif re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", token):
            yield float(token), at
        else:
            yield Word(token.decode("latin-1")), at


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF file")
        self.found: dict[int, tuple[object, bytes | None]] = {}
        trailers = [next(objects(data, m.end()), ({}, 0))[0] for m in re.finditer(rb"\btrailer\b", data)]
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            value, at = next(objects(data, m.end()), (None, m.end()))
            body = None
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream\r?\n").match(data, at)):
                size = value.get("Length")
                end = s.end() + size if isinstance(size, int) and not isinstance(size, Ref) and data[s.end() + size : s.end() + size + 12].lstrip().startswith(b"endstream") else data.find(b"endstream", s.end())
                body = data[s.end() : end if end >= 0 else len(data)]
            self.found[int(m[1])] = (value, body)
        trailers += [v for v, _ in self.found.values() if isinstance(v, dict) and v.get("Type") == "XRef"]
        if any("Encrypt" in t for t in trailers if isinstance(t, dict)):
            raise ValueError("encrypted")
        for value, body in list(self.found.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and body is not None:
                inner = self.decoded(value, body)
                heads = [x for x, _ in zip((x for x, _ in objects(inner)), range(2 * int(value.get("N", 0))), strict=False)]
                for number, place in zip(heads[::2], heads[1::2], strict=False):
                    self.found.setdefault(number, (next(objects(inner, int(value.get("First", 0)) + place), (None, 0))[0], None))
        self.trailers = trailers

    def get(self, x: object) -> object:
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.found.get(int(x), (None, None))[0]
        return None

    def decoded(self, value: dict, body: bytes) -> bytes:
        names = self.get(value.get("Filter"))
        for name in [self.get(n) for n in names] if isinstance(names, list) else [names] if names else []:
            if name in ("FlateDecode", "Fl"):
                body = zlib.decompressobj().decompress(body)
            elif name in ("ASCIIHexDecode", "AHx"):
                body = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", body.split(b">")[0]).decode())
            else:
                return b""
        return body

    def stream(self, x: object) -> bytes:
        value, body = self.found.get(int(x), (None, None)) if isinstance(x, Ref) else (None, None)
        return self.decoded(value, body) if isinstance(value, dict) and body is not None else b""

    def pages(self) -> list[dict]:
        """Leaves of the page tree in order, with what they inherit."""
        root = next((self.get(t["Root"]) for t in self.trailers if isinstance(t, dict) and "Root" in t), None)
        top = self.get(root.get("Pages")) if isinstance(root, dict) else None
        if not isinstance(top, dict):
            return [v for v, _ in self.found.values() if isinstance(v, dict) and v.get("Type") == "Page"]
        out, todo, seen = [], [(top, {})], set()
        while todo:
            node, above = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            held = above | {k: node[k] for k in ("Resources",) if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(self.get(k), held) for k in reversed(kids)]
            else:
                out.append(held | node)
        return out

    def title(self) -> str:
        for t in self.trailers:
            info = self.get(t.get("Info")) if isinstance(t, dict) else None
            if isinstance(info, dict) and isinstance(text := self.get(info.get("Title")), bytes):
                return shown(text).strip()
        return ""


def shown(text: bytes) -> str:
    return text[2:].decode("utf-16-be", "replace") if text[:2] == b"\xfe\xff" else text.decode("cp1252", "replace")


class Font:
    """How the codes of a font are read."""

    def __init__(self, doc: Document, font: object):
        font = font if isinstance(font, dict) else {}
        self.wide, self.map = font.get("Subtype") == "Type0", {}
        unit = lambda b: b.decode("utf-16-be", "replace")
        stack: list = []
        for x, _ in objects(doc.stream(font.get("ToUnicode"))):
            if not isinstance(x, Word):
                stack.append(x)
                continue
            if x == "endbfchar":
                for code, text in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(code, bytes) and isinstance(text, bytes):
                        self.map[code] = unit(text)
            elif x == "endbfrange":
                for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        for k, code in enumerate(range(int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535) + 1)):
                            if isinstance(to, list) and k < len(to) and isinstance(to[k], bytes):
                                self.map[code.to_bytes(len(a), "big")] = unit(to[k])
                            elif isinstance(to, bytes) and len(to) > 1:
                                self.map[code.to_bytes(len(a), "big")] = unit(to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 65535).to_bytes(2, "big"))
            stack = []

    def text(self, codes: bytes) -> str:
        width = 2 if self.wide else 1
        parts = [codes[k : k + width] for k in range(0, len(codes), width)]
        return "".join(self.map.get(c, "" if self.wide else c.decode("cp1252", "replace")) for c in parts)


def page_text(doc: Document, page: dict) -> str:
    """Lines of a page: text shown at one height is one line, a wide step inside it a blank."""
    resources = doc.get(page.get("Resources"))
    fonts = doc.get(resources.get("Font")) if isinstance(resources, dict) else None
    known: dict[str, Font] = {}
    parts = doc.get(page.get("Contents"))
    data = b"\n".join(doc.stream(c) for c in (parts if isinstance(parts, list) else [page.get("Contents")]))
    lines: list[tuple[float, list[str]]] = []
    height, leading, font, stack, fresh = 0.0, 0.0, Font(doc, None), [], True

    def put(text: str) -> None:
        nonlocal fresh
        if not lines or abs(lines[-1][0] - height) > 1:
            lines.append((height, []))
        elif fresh and lines[-1][1] and not lines[-1][1][-1].endswith(" "):
            lines[-1][1].append(" ")
        lines[-1][1].append(text)
        fresh = False

    for x, _ in objects(data):
        if not isinstance(x, Word):
            stack.append(x)
            continue
        if x == "Tf" and len(stack) > 1 and isinstance(fonts, dict):
            name = str(stack[-2])
            font = known.setdefault(name, Font(doc, doc.get(fonts.get(name))))
        elif x in ("Td", "TD") and len(stack) > 1:
            height, fresh = height + stack[-1], True
            leading = -stack[-1] if x == "TD" else leading
        elif x == "TL" and stack:
            leading = stack[-1]
        elif x == "Tm" and len(stack) > 5:
            height, fresh = stack[-1], True
        elif x == "BT":
            height, fresh = 0.0, True
        elif x in ("T*", "'", '"'):
            height, fresh = height - (leading or 12), True
        if x in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            put(font.text(stack[-1]))
        elif x == "TJ" and stack and isinstance(stack[-1], list):
            put("".join(font.text(y) if isinstance(y, bytes) else " " if isinstance(y, int | float) and y < -200 else "" for y in stack[-1]))
        stack = []
    return "\n".join(" ".join("".join(said).split()) for _, said in lines if "".join(said).strip())


def from_pdf(name: str, data: bytes) -> list[Unit]:
    """One unit: a section for each page, its text and its comments."""
    doc, out = Document(data), []
    for n, page in enumerate(doc.pages(), 1):
        text = page_text(doc, page)
        out.append(f"## Page {n}")
        out.append(text if len(re.sub(r"\s", "", text)) >= LEAST_CHARACTERS else f"{text}\n[page {n} may hold a picture of its text]".strip())
        notes = doc.get(page.get("Annots"))
        for note in [doc.get(x) for x in notes] if isinstance(notes, list) else []:
            if isinstance(note, dict) and note.get("Subtype") in ("Text", "FreeText", "Highlight") and isinstance(said := doc.get(note.get("Contents")), bytes):
                out.append(f"> {' '.join(shown(said).split())}")
    return [make("\n\n".join(out) or "[no pages]", doc.title() or name)]
