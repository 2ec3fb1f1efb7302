"""Front matter as a grammar: one canonical form, a parser that says what is wrong and where, and what holds between the two.

    block   = "---" LF *entry "---" LF
    entry   = key ":" (SP scalar) LF  /  key ":" LF 1*("  - " scalar LF)  /  key ": []" LF
    scalar  = null / true / false / integer / decimal / quoted / plain

A quoted scalar is a JSON string; a plain one is text that could be nothing else.  The canonical form has its keys in order, each
scalar in its shortest form, and texts quoted only where they must be, so a block is canonical if it equals what its values emit.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

READ = T.StructType(
    [T.StructField("error", T.StringType()), T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("canonical", T.BooleanType()), T.StructField("body", T.StringType())]
)
Scalar = None | bool | int | float | str
KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
INTEGER, DECIMAL = re.compile(r"-?(0|[1-9][0-9]*)"), re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
WORDS = {"null": None, "~": None, "true": True, "false": False}
#: Signs that no plain text begins with.
OPENING = set("!&*-?|>@`\"'%#{}[],:")
#: Signs that no plain text has.
CONTROL = re.compile("[\x00-\x1f\x7f\x85  ]")


class Malformed(ValueError):
    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}")


def is_plain(text: str) -> bool:
    """Whether a text can stand as it is and is read as itself."""
    odd = not text or text != text.strip() or text[0] in OPENING or CONTROL.search(text)
    return not (odd or ": " in text or text.endswith(":") or " #" in text or text.lower() in WORDS or INTEGER.fullmatch(text) or DECIMAL.fullmatch(text))


def emit_scalar(value: Scalar) -> str:
    if isinstance(value, str):
        return value if is_plain(value) else json.dumps(value, ensure_ascii=False)
    return json.dumps(value)


def emit(values: dict[str, Scalar | list[Scalar]]) -> str:
    """The canonical block of values."""
    out = ["---"]
    for key in sorted(values):
        value = values[key]
        if isinstance(value, list):
            out += [f"{key}:", *(f"  - {emit_scalar(x)}" for x in value)] if value else [f"{key}: []"]
        else:
            out.append(f"{key}: {emit_scalar(value)}")
    return "\n".join([*out, "---"]) + "\n"


def parse_scalar(text: str, line: int) -> Scalar:
    if text[:1] == '"':
        try:
            found = json.loads(text)
        except ValueError:
            raise Malformed(line, "a quoted text does not end") from None
        return found
    if text.lower() in WORDS:
        return WORDS[text.lower()]
    if INTEGER.fullmatch(text):
        return int(text)
    if DECIMAL.fullmatch(text):
        return float(text)
    if not is_plain(text):
        raise Malformed(line, "a text that must be quoted")
    return text


def parse(page: str) -> tuple[dict[str, Scalar | list[Scalar]], str]:
    """The values of a page's front matter, and its body."""
    lines = page.split("\n")
    if lines[0] != "---":
        raise Malformed(1, "no front matter")
    values: dict[str, Scalar | list[Scalar]] = {}
    key = None
    for n, line in enumerate(lines[1:], 2):
        if line == "---":
            if key is not None and values[key] == []:
                raise Malformed(n, f"{key} has no value")
            return values, "\n".join(lines[n:])
        if n == len(lines) and not line:
            break
        if line.startswith("  - "):
            if key is None:
                raise Malformed(n, "an item without a list")
            values[key].append(parse_scalar(line[4:], n))
            continue
        if key is not None and values[key] == []:
            raise Malformed(n, f"{key} has no value")
        name, colon, rest = line.partition(":")
        if not colon or not KEY.fullmatch(name) or (rest and not rest.startswith(" ")):
            raise Malformed(n, "no key")
        if name in values:
            raise Malformed(n, f"{name} stands twice")
        key = None
        if rest == " []":
            values[name] = []
        elif rest:
            values[name] = parse_scalar(rest[1:], n)
        else:
            key, values[name] = name, []
    raise Malformed(len(lines), "the front matter does not end")


@F.pandas_udf(READ)
def read_front(pages: pd.Series) -> pd.DataFrame:
    """What a page's head holds: each value as JSON, whether the block is in its canonical form, and the body."""
    rows = []
    for page in pages:
        try:
            values, body = parse(page or "")
            rows.append((None, {k: json.dumps(v, ensure_ascii=False) for k, v in values.items()}, emit(values) == (page[: len(page) - len(body)]), body))
        except Malformed as e:
            rows.append((str(e), {}, False, None))
    return pd.DataFrame(rows, columns=["error", "values", "canonical", "body"])


@F.pandas_udf(T.StringType())
def write_front(values: pd.Series) -> pd.Series:
    """The canonical block of a JSON object of scalars and lists of scalars."""
    return values.map(lambda v: None if v is None else emit(json.loads(v)))


@F.pandas_udf(T.StringType())
def front_scalar(texts: pd.Series) -> pd.Series:
    """A text as it stands in a canonical block."""
    return texts.map(lambda x: None if x is None else emit_scalar(x))
