"""Front matter: what is emitted is read back, what is wrong is named, and the contract of pages."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import front
from tidemark.operators import quality

SCALARS = st.none() | st.booleans() | st.integers(-(10**18), 10**18) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(blacklist_categories=["Cs"]), max_size=20)
ODD = ["", "null", "True", "~", "12", "-0", "1.5", "1e5", "- x", "a: b", "a #b", "ends:", " led", "x ", "---", "é", "\t", "a\nb", '"q"', "'", "key: [", "[]", "007", " "]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.from_regex(front.KEY, fullmatch=True), SCALARS | st.lists(SCALARS | st.sampled_from(ODD), max_size=4), max_size=6))
def test_round_trip(values):
    block = front.emit(values)
    got, body = front.parse(block + "body\n---\n")
    assert got == values and body == "body\n---\n" and front.emit(got) == block
    assert [type(v) for v in got.values()] == [type(values[k]) for k in got]


def test_odd_scalars_and_faults():
    values = {f"k{n}": x for n, x in enumerate(ODD)} | {"list": ODD}
    assert front.parse(front.emit(values))[0] == values
    for text, what in (("x", "no front matter"), ("---\na: 1\n", "does not end"), ("---\na: 1\na: 2\n---\n", "twice"), ("---\na\n---\n", "no key"), ("---\n  - x\n---\n", "without a list"), ("---\na:\n---\n", "no value"), ("---\na: 'x\n---\n", "quoted"), ('---\na: "x\n---\n', "end"), ("---\na:1\n---\n", "no key"), ("---\na:\nb: 1\n---\n", "no value")):
        with pytest.raises(front.Malformed, match=what):
            front.parse(text)


def test_contract_of_pages(spark):
    head = lambda body, **more: front.emit({"rendered_sha256": hashlib.sha256(body.encode()).hexdigest(), "source_id": "s", "source_path": "a: b.txt", "status": "current"} | more) + body
    pages = {
        "fine": head("x\n"), "none": "x", "form": head("x\n").replace("status: current", 'status: "current"'), "status": head("x\n", status="new"), "kind": head("x\n", source_path=5),
        "hash": head("x\n") + "y", "short": head("x\n", rendered_sha256="abc"), "lacks": front.emit(json.loads('{"status": "current"}')),
    }
    found = quality.contract_findings(spark.createDataFrame(list(pages.items()), "path string, text string")).collect()
    got = sorted((r.path, r.rule, r.detail) for r in found)
    assert [x[:2] for x in got] == [("form", "front-form"), ("hash", "page-body-hash"), ("kind", "front-kind"), *[("lacks", "front-missing")] * 3, ("none", "front-malformed"), ("short", "front-kind"), ("status", "page-status")]
    assert ("none", "front-malformed", "line 1: no front matter") in got
