"""A paged feed as a stream: each record once over restarts; loops, odd pages, waits and expired links."""

import json

import pytest

from tidemark.sources import paged
from tidemark.sources.paged import DELTA, NEXT, ExpiredOffset, Feed, LoopingFeed, MalformedPage


def page(root, name, records, after=None, kind=NEXT, **more):
    (root / name).write_text(json.dumps({"value": records, **({kind: str(root / after)} if after else {}), **more}))


def drain(spark, root, feeds, out, per_batch=1000):
    stream = paged.paged_stream(spark, feeds, per_batch)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted((r.feed, json.loads(r.record)["id"]) for r in spark.read.parquet(f"{out}/rows").collect())


def test_each_record_once_over_restarts(spark, tmp_path):
    root, out = tmp_path / "pages", tmp_path / "out"
    root.mkdir()
    for k in range(5):
        page(root, f"a{k}", [{"id": 10 * k + j} for j in range(3)], f"a{k + 1}", DELTA if k == 4 else NEXT)
    page(root, "b0", [{"id": 1}], "b1", DELTA)
    feeds = {"a": str(root / "a0"), "b": str(root / "b0")}
    first = [("a", 10 * k + j) for k in range(5) for j in range(3)] + [("b", 1)]
    assert drain(spark, root, feeds, out) == sorted(first)
    assert drain(spark, root, feeds, out) == sorted(first)  # nothing new
    page(root, "a5", [{"id": 99}], "a6", DELTA)
    page(root, "b1", [{"id": 2}], "b2", DELTA)
    assert drain(spark, root, feeds, out) == sorted([*first, ("a", 99), ("b", 2)])


def test_what_ends_a_feed_is_named(tmp_path):
    feed = Feed()
    page(tmp_path, "x0", [], "x1")
    page(tmp_path, "x1", [], "x0")
    with pytest.raises(LoopingFeed, match="x0"):
        feed.walk(str(tmp_path / "x0"), 100)
    page(tmp_path, "y0", [], "y1")
    (tmp_path / "y1").write_text('{"value": {"no": "list"}}')
    with pytest.raises(MalformedPage, match="y1"):
        feed.walk(str(tmp_path / "y0"), 100)
    page(tmp_path, "z0", [1, 2], "z1")
    with pytest.raises(MalformedPage, match="z0"):
        feed.page(str(tmp_path / "z0"))
    (tmp_path / "gone").write_text('{"error": {"code": "resyncRequired"}}')
    page(tmp_path, "w0", [], "gone")
    with pytest.raises(ExpiredOffset, match="gone"):
        feed.walk(str(tmp_path / "w0"), 100)
    reader = paged.PagedStreamReader({"feeds": json.dumps({"w": str(tmp_path / "t0")})}, feed)
    page(tmp_path, "t0", [{"id": 1}], "t1", DELTA)
    with pytest.raises(ExpiredOffset):
        reader.partitions({"w": str(tmp_path / "t0")}, {"w": str(tmp_path / "elsewhere")})


def test_a_page_that_asks_to_wait_ends_the_batch_before_it(tmp_path):
    page(tmp_path, "p0", [{"id": 1}], "p1")
    (tmp_path / "p1").write_text('{"error": {"code": "throttled"}, "retryAfter": 0.2}')
    reader = paged.PagedStreamReader({"feeds": json.dumps({"f": str(tmp_path / "p0")})}, Feed())
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"f": str(tmp_path / "p1")} and [p.links for p in reader.partitions(start, end)] == [[str(tmp_path / "p0")]]
    page(tmp_path, "p1", [{"id": 2}], "p2", DELTA)
    assert reader.latestOffset() == end  # its time has not come
    import time

    time.sleep(0.3)
    later = reader.latestOffset()
    assert later == {"f": str(tmp_path / "p2")} and [r[3] for p in reader.partitions(end, later) for r in reader.read(p)] == ['{"id": 2}']


def test_content_counts_when_two_reads_agree(spark):
    from tidemark.sources.readers import agreed_reads

    kind = "source_id string, stable_id string, size bigint, mtime_ns bigint, sha256 string, at_ns bigint"
    waiting, taken = spark.createDataFrame([], kind), []
    rounds = [
        [("s", "same", 1, 1, "a", 0), ("s", "moves", 1, 1, "a", 0), ("s", "rare", 1, 1, "r", 0), ("s", "twice", 1, 1, "a", 0), ("s", "twice", 1, 1, "b", 1)],
        [("s", "same", 1, 1, "a", 50), ("s", "moves", 1, 1, "b", 50)],  # too soon; another digest
        [("s", "same", 1, 1, "a", 100), ("s", "moves", 1, 1, "b", 120), ("s", "twice", 1, 1, "b", 140)],
        [("s", "moves", 1, 1, "b", 160), ("s", "rare", 1, 1, "r", 200)],
    ]
    for rows in rounds:
        stand, wait = agreed_reads(waiting, spark.createDataFrame(rows, kind), 100)
        taken.append(sorted(r.stable_id for r in stand.collect()))
        waiting = spark.createDataFrame([tuple(r) for r in wait.select(*[c.split()[0] for c in kind.split(", ")]).collect()], kind)
    assert taken == [[], [], ["same", "twice"], ["moves", "rare"]] and waiting.count() == 0
