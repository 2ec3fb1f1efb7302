"""Snapshots by run, and the small files that a run publishes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    """Tables as immutable folders by run, and a pointer that names the published run.

    A run's tables are written first and the pointer last, so readers see all of a run or nothing of it, and a run that
    is written again after a crash replaces only itself.  What rewrites history (an erasure) writes all tables into the
    next generation; the pointer moves to it, and only then does the old generation go.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._generation = spark, root.rstrip("/"), None

    def _pointer(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("run_id bigint, generation bigint").parquet(f"{self.root}/_published")
        except AnalysisException:
            return None

    def generation(self) -> int:
        """The generation that the pointer names, read once by a store; a publication of this store moves it on."""
        if self._generation is None:
            rows = self._pointer()
            self._generation = 0 if rows is None else int(rows.agg(F.max("generation")).first()[0] or 0)
        return self._generation

    def _folder(self, table: str, generation: int | None = None) -> str:
        return f"{self.root}/generation={self.generation() if generation is None else generation}/{table}"

    def write(self, table: str, run_id: int, df: DataFrame, generation: int | None = None) -> None:
        df.write.mode("overwrite").parquet(f"{self._folder(table, generation)}/run_id={run_id}")

    def read(self, table: str, run_id: int, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(table, generation)}/run_id={run_id}")

    def history(self, table: str, generation: int | None = None) -> DataFrame:
        """All retained snapshots, with run_id."""
        return self.spark.read.parquet(self._folder(table, generation))

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def tables(self, generation: int | None = None) -> dict[str, list[int]]:
        """The tables of a generation and the runs that each has."""
        base = self._folder("", generation).rstrip("/")
        return {t: [int(r.partition("=")[2]) for r in self._names(f"{base}/{t}") if r.startswith("run_id=")] for t in self._names(base)}

    def drop(self, generation: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder("", generation).rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def publish(self, run_id: int, generation: int | None = None) -> None:
        self._generation = self.generation() if generation is None else generation
        row = [(run_id, self._generation)]
        self.spark.createDataFrame(row, "run_id bigint, generation bigint").coalesce(1).write.mode("append").parquet(f"{self.root}/_published")

    def published(self, at: int | None = None) -> int | None:
        """The newest published run, or the newest up to a given one."""
        runs = self._pointer()
        return None if runs is None else runs.where(F.col("run_id") <= at if at is not None else F.lit(True)).agg(F.max("run_id")).first()[0]


def write_shards(lines: DataFrame, path: str) -> None:
    """One folder of JSON lines per source, in order of id (source_id, id, line)."""
    lines.repartition("source_id").sortWithinPartitions("source_id", "id").select("source_id", "line").write.mode("overwrite").partitionBy("source_id").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def page_text(pages: DataFrame) -> DataFrame:
    """path, text of mirror pages: front matter with its keys in order, then the body."""
    keys = [c for c in sorted(pages.columns) if c not in ("path", "body")]
    lines = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(k).cast("string"), F.lit("\n"))).otherwise("") for k in keys]
    return pages.select("path", F.concat(F.lit("---\n"), *lines, F.lit("---\n"), F.coalesce("body", F.lit(""))).alias("text"))


def changed_pages(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pages (path, text) whose bytes differ from those published: only these are written."""
    before = old.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("__sha"))
    return new.join(before, "path", "left").where(~F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("__sha"))).select("path", "text")


def tombstone_pages(tombstones: DataFrame) -> DataFrame:
    return tombstones.select(
        F.col("output_path").alias("path"),
        F.format_string("---\nstatus: deleted\n---\n# Deleted\n\nThe source was deleted on %s (%s). This notice goes on %s.\n", F.col("deleted_at").cast("string"), "reason", F.col("reap_after").cast("string")).alias("text"),
    )


def changelog(changes: DataFrame) -> DataFrame:
    """run_id, place, line: a section per source, its changes in order of path."""
    from pyspark.sql import Window as W

    line = F.concat_ws(" ", "op", "path")
    return changes.select("run_id", "source_id", F.row_number().over(W.partitionBy("run_id", "source_id").orderBy("path", "op")).alias("place"), line.alias("line"))
