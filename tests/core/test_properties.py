"""Laws over generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import columns as fx
from tidemark.functions import text as tx
from tidemark.operators import converters, layout

TEXT = st.text(max_size=30)


@given(TEXT)
def test_a_slug_is_portable(s):
    slug = tx.slug(s)
    assert slug and tx.slug(slug) == slug and "/" not in slug and not slug.endswith((".", " "))


@given(TEXT, st.lists(st.sampled_from(["a", "B b", "..", ".", "", "ü"]), max_size=8), st.sampled_from(["", "Sheet"]))
def test_a_mirror_path_stays_in_its_place(source, segments, unit):
    path = tx.mirror_path("s", "/".join(segments), unit)
    assert path.startswith("mirror/s/") and path.endswith(".md") and len(path) <= 200 and ".." not in path.split("/")


@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=6))
def test_numbers_sort_by_value(numbers):
    names = [f"file {n}" for n in numbers]
    assert sorted(names, key=tx.natural) == [f"file {n}" for n in sorted(numbers)]


@given(TEXT, TEXT)
def test_folding_is_an_equivalence(a, b):
    assert tx.folded(tx.folded(a)) == tx.folded(a)
    assert (tx.folded(a) == tx.folded(b)) == (tx.folded(tx.folded(a)) == tx.folded(tx.folded(b)))


@given(st.binary(max_size=60))
def test_decoding_never_fails(data):
    text = tx.decoded(data)
    assert text is None or ("\0" not in text and "\r" not in text)


@given(st.text(alphabet="ab*?[]!/.+()", max_size=10))
def test_every_glob_compiles(glob):
    import re

    pattern = fx.glob_pattern(glob)
    re.compile(pattern)
    assert pattern.startswith("(?i)^") and pattern.endswith("$")


@given(st.text(max_size=200))
def test_converters_of_text_give_one_unit(text):
    for kind in ("text", "markdown", "html", "transcript"):
        units = converters.CONVERTERS[kind]("name", text)
        assert len(units) == 1 and units[0]["body"].endswith("\n")


@settings(max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), st.integers(1, 30), st.integers(1, 6)), min_size=1, max_size=25))
def test_reading_order_loses_no_box(raw):
    boxes = [(f"t{i}", float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(raw)]
    out = [b[0] for block in layout.blocks(boxes, 4.0) for b in block]
    assert sorted(out) == sorted(b[0] for b in boxes)
    said = " ".join(t for block in layout.blocks(boxes, 4.0) for t in layout.rows(block)).split()
    assert sorted(said) == sorted(b[0] for b in boxes)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20), st.sampled_from(["A", "B", ""])), max_size=20))
def test_turns_keep_every_word(raw):
    cues = sorted((a * 100, a * 100 + d * 100, who, f"w{i}") for i, (a, d, who) in enumerate(raw))
    turns = converters.joined_turns(cues)
    assert sorted(" ".join(t[3] for t in turns).split()) == sorted(c[3] for c in cues)
    assert all(t[0] <= t[1] for t in turns)
