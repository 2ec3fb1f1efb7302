"""A paged feed as a streaming source: its offset is the link that is to be read next.

A feed is pages of JSON: ``value`` (a list of records), then ``@odata.nextLink`` (another page) or ``@odata.deltaLink`` (where
the next round begins, when there is one).  The driver follows links only; the pages between two offsets are dealt to tasks, which
read the records.  A stream that is restarted from its checkpoint goes on at its committed link, so each record comes once.

A link that leads back to a page of the same walk, a page that is none, and an offset that the provider has let expire end the
stream by name.  A page that asks to wait ends the batch before it, and is asked for again when its time has come.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NEXT, DELTA = "@odata.nextLink", "@odata.deltaLink"
#: Seconds that a task waits for a page that asks to wait, before it fails and is tried elsewhere.
PATIENCE_S = 30


class FeedError(Exception):
    """What ends a feed; its name says why."""


class LoopingFeed(FeedError):
    pass


class MalformedPage(FeedError):
    pass


class ExpiredOffset(FeedError):
    """The provider knows the link no more: the feed has to be listed anew."""


class Wait(Exception):
    def __init__(self, seconds: float):
        super().__init__(f"asked to wait {seconds} s")
        self.seconds = seconds


def fetch_file(link: str) -> dict | None:
    """A page from a file, or from a folder that holds one; None if it is not there (yet)."""
    path = link.removeprefix("file://")
    if os.path.isdir(path):
        parts = sorted(x for x in os.listdir(path) if x.startswith("part-"))
        if not parts:
            return None
        path = f"{path}/{parts[0]}"
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Feed:
    """Pages by link.  ``fetch`` is what a transport has to give; here pages are files that driver and executors share."""

    fetch = staticmethod(fetch_file)

    def page(self, link: str) -> dict | None:
        found = self.fetch(link)
        if found is None:
            return None
        if not isinstance(found, dict):
            raise MalformedPage(f"{link} is no page")
        error = found.get("error")
        if error is not None:
            code = error.get("code") if isinstance(error, dict) else error
            if code in ("gone", "resyncRequired", "itemNotFound"):
                raise ExpiredOffset(f"{link}: {code}")
            if code in ("throttled", "tooManyRequests", "serviceNotAvailable"):
                raise Wait(float(found.get("retryAfter", 1)))
            raise MalformedPage(f"{link}: {code}")
        if not isinstance(found.get("value"), list) or not all(isinstance(r, dict) for r in found["value"]):
            raise MalformedPage(f"{link} has no list of records")
        for name in (NEXT, DELTA):
            if not isinstance(found.get(name, ""), str):
                raise MalformedPage(f"{link}: {name} is no link")
        return found

    def walk(self, link: str, most: int, until: str | None = None) -> tuple[list[str], str, float]:
        """The links of the pages that are there, from one on (up to another, if given), the link after them, and seconds to wait."""
        links, seen = [], set()
        while len(links) < most and link != until:
            if link in seen:
                raise LoopingFeed(f"{link} was read in this walk already")
            try:
                page = self.page(link)
            except Wait as w:
                return links, link, w.seconds
            after = None if page is None else page.get(NEXT) or page.get(DELTA)
            if after is None:
                break  # the next round is not there yet, or the last page names none
            seen.add(link)
            links.append(link)
            link = after
        return links, link, 0.0


class PageRun(InputPartition):
    def __init__(self, feed: str, links: list[str]):
        self.feed, self.links = feed, links


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, feed: Feed):
        self.feed = feed
        self.firsts = json.loads(options["feeds"])  # by name, the link at which each feed begins
        self.per_task, self.most = int(options.get("pagesPerTask", "8")), int(options.get("pagesPerBatch", "1000"))
        self.at: dict[str, str] = {}
        self.not_before: dict[str, float] = {}

    def initialOffset(self) -> dict:
        return dict(self.firsts)

    def latestOffset(self) -> dict:
        """Each feed's link after the pages that are there now."""
        for name, first in self.firsts.items():
            if time.time() < self.not_before.get(name, 0):
                continue
            links, after, wait = self.feed.walk(self.at.get(name, first), self.most)
            self.at[name] = after
            if wait:
                self.not_before[name] = time.time() + wait
        return {name: self.at.get(name, first) for name, first in self.firsts.items()}

    def partitions(self, start: dict, end: dict) -> list[PageRun]:
        out = []
        for name, to in end.items():
            begin = start.get(name, self.firsts[name])
            if begin == to:
                continue
            links, after, _ = self.feed.walk(begin, 1 << 40, to)
            if after != to:
                raise ExpiredOffset(f"{name}: {begin} leads to {to} no more")
            out += [PageRun(name, links[k : k + self.per_task]) for k in range(0, len(links), self.per_task)]
            self.at[name] = to if name not in self.at else self.at[name]
        return out

    def read(self, partition: PageRun) -> Iterator[tuple]:
        for link in partition.links:
            page, end = None, time.time() + PATIENCE_S
            while page is None:
                try:
                    page = self.feed.page(link)
                    if page is None:
                        raise ExpiredOffset(f"{link} is gone")
                except Wait as w:
                    if time.time() + w.seconds > end:
                        raise
                    time.sleep(w.seconds)
            for n, record in enumerate(page["value"]):
                yield partition.feed, link, n, json.dumps(record, sort_keys=True)

    def commit(self, end: dict) -> None:
        """The engine's checkpoint holds the offset; nothing else is kept."""


class PagedStream(DataSource):
    """Format 'paged-stream': options feeds (JSON, first link by name), pagesPerTask, pagesPerBatch (bounds each look ahead)."""

    feed_class = Feed

    @classmethod
    def name(cls) -> str:
        return "paged-stream"

    def schema(self) -> str:
        return "feed string, link string, place bigint, record string"

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.options, self.feed_class())


def paged_stream(spark: SparkSession, feeds: dict[str, str], pages_per_batch: int = 1000, source: type[DataSource] = PagedStream) -> DataFrame:
    """Records (feed, link, place, record) of feeds as a stream."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("feeds", json.dumps(feeds)).option("pagesPerBatch", pages_per_batch).load()


def pages_of(records: DataFrame, root: str, per_page: int) -> None:
    """Writes records (feed, n from 0 on, record as JSON text) as the pages of feeds, a folder for each page, all linked."""
    from pyspark.sql import functions as F

    page = F.floor(F.col("n") / per_page).cast("bigint")
    grouped = records.withColumn("page", page).groupBy("feed", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "record"))), lambda x: x["record"]), ",").alias("held"))
    last = records.groupBy("feed").agg(F.max(page).alias("last"))
    link = F.concat(F.lit(root + "/feed="), "feed", F.lit("/page="), (F.col("page") + 1).cast("string"))
    name = F.when(F.col("page") == F.col("last"), DELTA).otherwise(NEXT)
    text = F.concat(F.lit('{"value":['), "held", F.lit('],"'), name, F.lit('":"'), link, F.lit('"}'))
    grouped.join(last, "feed").select("feed", "page", text.alias("value")).repartition("feed", "page").write.partitionBy("feed", "page").text(root)
