"""Page paths: what holds for every path, and the shared folder where none is named."""

import random

from tidemark.functions import scratch, text


def test_page_paths_are_short_apart_and_kept_together():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé -_.(1)#") for _ in range(n))
    names = {"/".join(word(rng.choice([3, 20, 45, 90])) for _ in range(rng.randint(1, 9))) for _ in range(3000)}
    for path in names:
        page = text.mirror_path("s", path)
        assert len(page) <= text.LONGEST - text.ROOM_FOR_HASH and page.startswith("mirror/s/") and page.endswith(".md")
        units = {text.mirror_path("s", path, u).rpartition("/")[0] for u in ("one", "two " * 30)}
        assert len(units) == 1 and all(len(text.mirror_path("s", path, u)) <= text.LONGEST for u in ("one", "x" * 90))
    long = [p for p in names if len(f"mirror/s/{p}.md") > 400]
    assert len({text.mirror_path("s", p) for p in long}) == len(long) > 100  # those that are cut end in a hash of the whole
    deep = "/".join(["folder" * 4] * 12) + "/report.docx"
    assert text.mirror_path("s", deep).startswith("mirror/s/" + "folder" * 4 + "/") and "/deep-" in text.mirror_path("s", deep)
    assert text.mirror_path("s", "a/b/Report.md") == "mirror/s/a/b/report.md" and text.mirror_path("s", ".md") == "mirror/s/dot-md.md"


def test_a_local_master_without_a_folder_gets_one(spark):
    folder = scratch.shared_dir(spark)
    assert folder and scratch.shared_dir(spark.newSession()) == folder
    assert scratch.materialize(spark.range(3), "t").count() == 3
