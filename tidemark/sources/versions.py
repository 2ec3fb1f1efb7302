"""State tables as a log of versions: a base, change files over it, and a manifest per run that names the live files.

A run writes only the rows that it changed and the keys that it removed; rows that are as they were are written nowhere, so a
run without change adds no data file.  A manifest names, for each table, its base and the changes to lay over it in
order; it is written once, after the files that it names, and a tag (``published``) that moves to it last makes the run visible.
Tags move by compare-and-set: a move is a file whose number is one above the last, created only if it isn't there, so of two
writers one fails.  A ledger of small files says how far each run has come; after a crash ``recover`` finishes a run that was
published and discards any other.  Compaction lays the changes over the base as a new base; manifests of older runs go on naming
the old files, until ``vacuum`` removes what no retained manifest names.

Small files go through Hadoop's file system, so any store works that Spark reads; data files are written by Spark only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas

#: The keys of the tables of a collection's state.
TABLE_KEYS = {
    "items": ("source_id", "stable_id"), "outputs": ("source_id", "stable_id", "unit_id"), "tombstones": ("output_path",), "aliases": ("source_id", "old_id"), "cursors": ("source_id",),
    "unit_cache": ("action_key", "unit_id"), "passes": ("source_id",), "pages": ("path",), "failures": ("source_id", "stable_id"), "pieces": ("job", "piece"),
}
#: Change files over a base before it is compacted, and the share of its rows that they may have.
MOST_CHANGES, CHANGED_SHARE = 8, 0.5
STEPS = ("begun", "staged", "committed", "promoted", "finished", "discarded")


class Conflict(Exception):
    """Another writer moved the tag first."""


class SmallFiles:
    """Text files below a root, each created once and whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if self._fs.exists(self._path(name)):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder)) if not x.getPath().getName().startswith("."))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Tags:
    """Named pointers with a history: tags/<name>/<number>, each written once and holding what the tag moved to."""

    def __init__(self, files: SmallFiles):
        self.files = files
        self._read: dict[str, dict] = {}  # a finished move never changes

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"tags/{name}"))

    def _value(self, name: str, number: int) -> dict | None:
        """None for a move whose file was never finished: it counts as a number, not as a move."""
        file = f"tags/{name}/{number:09d}"
        if file not in self._read:
            text = self.files.read(file) or ""
            if not text.endswith("\n"):
                return None
            self._read[file] = json.loads(text)
        return self._read[file]

    def get(self, name: str, run: int | None = None) -> tuple[int, dict | None]:
        """The number of the last move, and what the tag holds; of a run, what it held last for that run."""
        numbers = self._numbers(name)
        for n in reversed(numbers):
            value = self._value(name, n)
            if value is not None and run in (None, value["run"]):
                return numbers[-1], value
        return (numbers[-1] if numbers else 0), None

    def runs(self, name: str) -> list[int]:
        return sorted({v["run"] for n in self._numbers(name) if (v := self._value(name, n)) is not None})

    def move(self, name: str, expected: int, value: dict) -> int:
        """Moves the tag if ``expected`` is still the number of its last move; value names its run."""
        last = max(self._numbers(name), default=0)
        if last != expected or not self.files.create(f"tags/{name}/{expected + 1:09d}", json.dumps(value, sort_keys=True) + "\n"):
            raise Conflict(f"{name} is at {last}, not at {expected}")
        return expected + 1

    def forget(self, name: str, keep: set[int]) -> None:
        """Drops moves for other runs than those kept; the last one stays."""
        for n in self._numbers(name)[:-1]:
            value = self._value(name, n)
            if value is None or value["run"] not in keep:
                self.files.delete(f"tags/{name}/{n:09d}")


def comparable(column: str, kind: T.DataType) -> Column:
    """A column in a form that can be compared: maps as sorted entries."""
    return F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) else F.col(column)


def differences(old: DataFrame, new: DataFrame, keys: Iterable[str], ignore: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` that are not in ``old`` as they are, and keys of ``old`` that ``new`` lacks; columns in ``ignore`` don't tell rows apart."""
    keys = list(keys)
    told = [f for f in new.schema.fields if f.name not in (*keys, *ignore)]
    said = lambda df: F.struct(*[comparable(f.name, f.dataType).alias(f.name) for f in told]) if told else F.lit(1)
    before = old.select(*keys, said(old).alias("__old"))
    met = new.withColumn("__new", said(new)).join(before, keys, "left")
    changed = met.where(~F.col("__new").eqNullSafe(F.col("__old"))).select(*new.columns)
    return changed, old.select(*keys).join(new.select(*keys), keys, "left_anti")


class VersionedStore:
    """Keyed tables as base and changes, and tables of one run as they are."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys or TABLE_KEYS
        self.files = SmallFiles(spark, root)
        self.tags = Tags(self.files)
        self._staged: dict[int, dict] = {}

    # the published state

    def current(self) -> dict:
        """The manifest that the published tag holds: run, parent and tables."""
        value = self.tags.get("published")[1]
        return value or {"run": None, "generation": 0, "tables": {}}

    def published(self, at: int | None = None) -> int | None:
        """The newest published run, or the newest up to a given one."""
        runs = [r for r in self.tags.runs("published") if at is None or r <= at]
        return max(runs, default=None)

    def generation(self) -> int:
        return self.current()["generation"]

    def manifest(self, run: int | None = None) -> dict:
        if run in self._staged:
            return self._staged[run]
        found = self.current() if run is None else self.tags.get("published", run)[1]
        if found is None:
            raise KeyError(f"run {run} is not published")
        return found

    def _data(self, table: str, name: str, generation: int) -> str:
        return f"{self.root}/generation={generation}/{table}/{name}"

    def _none(self, schema: T.StructType | str) -> DataFrame:
        """No rows, and known as such to the optimizer, which drops the joins with them."""
        return self.spark.createDataFrame([], schema).limit(0)

    def _laid_over(self, table: str, files: dict, generation: int) -> DataFrame:
        """The rows of a base with its changes: the last change of a key counts."""
        keys, schema = list(self.keys[table]), T.StructType.fromJson(files["schema"])
        columns = [f.name for f in schema.fields]
        load = lambda name, kind: self.spark.read.schema(kind).parquet(self._data(table, name, generation))
        base = load(files["base"], schema) if files["base"] else self._none(schema)
        if not files["changes"]:
            return base
        wide = T.StructType([*schema.fields, T.StructField("__gone", T.BooleanType())])
        changes = reduce(DataFrame.unionByName, [load(c, wide).withColumn("__at", F.lit(k)) for k, c in enumerate(files["changes"])])
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys], "__gone"), "__at").alias("__row"))
        live = last.where("not __row.__gone").select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in columns])
        return base.join(last.select(*keys), keys, "left_anti").select(*columns).unionByName(live)

    def read(self, table: str, run: int | None = None) -> DataFrame:
        """A keyed table as of a run (the published one); a run's own table as it was written."""
        if table not in self.keys:
            return self.spark.read.parquet(self._data(table, f"run_id={run}", self.manifest(run)["generation"] if run not in self._staged else self._staged[run]["generation"]))
        found = self.manifest(run)
        files = found["tables"].get(table)
        if files is None:
            return self._none(schemas.TABLES[table])
        return self._laid_over(table, files, found["generation"])

    def has(self, table: str, run: int | None = None) -> bool:
        return table in self.manifest(run)["tables"]

    def rows(self, table: str, run: int | None = None) -> int:
        """An upper bound of a table's rows, from its manifest."""
        files = self.manifest(run)["tables"].get(table)
        return 0 if files is None else files["base_rows"] + files["change_rows"]

    # the protocol of a run

    def note(self, run: int, step: str, value: dict | None = None) -> None:
        self.files.create(f"runs/{run}/{step}", json.dumps(value or {}, sort_keys=True) + "\n")

    def steps(self, run: int) -> list[str]:
        return [s for s in STEPS if s in self.files.names(f"runs/{run}")]

    def begin(self, run: int) -> dict:
        """Opens a run over the published one; what a discarded attempt of the same number left is forgotten."""
        if "discarded" in self.steps(run):
            self.files.delete(f"runs/{run}")
        if self.steps(run):
            raise Conflict(f"run {run} was begun already: {self.steps(run)}")
        number, _ = self.tags.get("published")
        now = self.current()
        attempt = uuid.uuid4().hex[:12]
        self.note(run, "begun", {"attempt": attempt, "parent": now["run"]})
        self._staged[run] = {"run": run, "parent": now["run"], "generation": now["generation"], "tables": dict(now["tables"]), "__expected": number, "__attempt": attempt}
        return self._staged[run]

    def keep(self, table: str, run: int, df: DataFrame) -> DataFrame:
        """Writes a table of this run only, and reads it back."""
        path = self._data(table, f"run_id={run}", self._staged[run]["generation"])
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def change(self, table: str, run: int, changed: DataFrame, gone: DataFrame | None = None) -> int:
        """Stages rows that are new or other than before, and keys that go; the number of both.  No rows leave no file."""
        staged, keys = self._staged[run], list(self.keys[table])
        files = staged["tables"].get(table)
        schema = T.StructType.fromJson(files["schema"]) if files else changed.schema
        columns = [f.name for f in schema.fields]
        rows = changed.select(*columns, F.lit(False).alias("__gone"))
        if gone is not None:
            empty = [F.col(c) if c in keys else F.lit(None).cast(schema[c].dataType).alias(c) for c in columns]
            rows = rows.unionByName(gone.select(*empty, F.lit(True).alias("__gone")))
        name = f"{run}-{staged['__attempt']}-{uuid.uuid4().hex[:6]}"
        path = self._data(table, name, staged["generation"])
        rows.write.parquet(path)
        n = self.spark.read.parquet(path).count()  # from the files' footers
        if not n:
            self.files.delete(path.removeprefix(self.root + "/"))
            return 0
        files = files or {"base": None, "changes": [], "base_rows": 0, "change_rows": 0, "schema": schema.jsonValue()}
        staged["tables"][table] = files | {"changes": [*files["changes"], name], "change_rows": files["change_rows"] + n}
        return n

    def replace(self, table: str, run: int, df: DataFrame, ignore: Iterable[str] = ()) -> int:
        """Stages the difference between a table as the run has it and ``df``."""
        return self.change(table, run, *differences(self._now(table, run, df), df, self.keys[table], ignore))

    def _now(self, table: str, run: int, like: DataFrame) -> DataFrame:
        files = self._staged[run]["tables"].get(table)
        return self._none(like.schema) if files is None else self._laid_over(table, files, self._staged[run]["generation"])

    def commit(self, run: int) -> None:
        """Publishes a run: its manifest, then the tag.  Promotion of cursors and the end of the run follow."""
        staged = self._staged[run]
        value = {k: v for k, v in staged.items() if not k.startswith("__")}
        self.note(run, "staged", value)
        self.tags.move("published", staged["__expected"], value)
        del self._staged[run]
        self.note(run, "committed")
        self.promote(run)

    def abandon(self, run: int) -> None:
        """A run that shall not be published: what it staged is removed, but for its own tables."""
        self._staged.pop(run, None)
        self._discard(run)

    def promote(self, run: int) -> None:
        """After publication: the cursors that wait for the run count, and the run ends.  Doing it again changes nothing."""
        if self.has("cursors", run) and self.published() == run:
            from tidemark.operators.state import promote_cursors

            cursors = self.read("cursors", run)
            if cursors.where(F.col("pending_run") == run).limit(1).count():
                number, found = self.tags.get("published")
                self._staged[run] = found | {"tables": dict(found["tables"]), "__expected": number, "__attempt": "cursors"}
                try:
                    self.replace("cursors", run, promote_cursors(cursors, run, True))
                    value = {k: v for k, v in self._staged[run].items() if not k.startswith("__")}
                    self.tags.move("published", number, value)
                finally:
                    del self._staged[run]
        self.note(run, "promoted")
        self.note(run, "finished")

    def _discard(self, run: int) -> None:
        begun = json.loads(self.files.read(f"runs/{run}/begun") or "{}")
        if attempt := begun.get("attempt"):
            for generation in self.files.names(""):
                for table in self.files.names(generation) if generation.startswith("generation=") else []:
                    for name in self.files.names(f"{generation}/{table}"):
                        if f"-{attempt}-" in name:
                            self.files.delete(f"{generation}/{table}/{name}")
        self.note(run, "discarded")

    def recover(self) -> dict[int, str]:
        """What became of runs that a crash left: adopt (published, now finished) or discard."""
        out, visible = {}, set(self.tags.runs("published"))
        for run in sorted(int(r) for r in self.files.names("runs")):
            if {"finished", "discarded"} & set(self.steps(run)):
                continue
            told = self.tags.get("published", run)[1] if run in visible else None
            if told is not None:
                self.promote(run)
                out[run] = "adopt"
            else:
                self._staged.pop(run, None)
                self._discard(run)
                out[run] = "discard"
        return out

    # housekeeping

    def due(self, table: str) -> bool:
        """Whether the changes over a table's base are many or large."""
        files = self.current()["tables"].get(table)
        return files is not None and (len(files["changes"]) > MOST_CHANGES or files["change_rows"] > max(1, CHANGED_SHARE * files["base_rows"]) and bool(files["changes"]))

    def compact(self, tables: Iterable[str] | None = None) -> list[str]:
        """New bases for tables of the published run.  Before its last step nothing is seen of it; a crash leaves files that vacuum removes."""
        number, now = self.tags.get("published")
        done = dict(now["tables"])
        names = [t for t in (tables or now["tables"]) if now["tables"][t]["changes"]]
        for table in names:
            files = now["tables"][table]
            name = f"base-{now['run']}-{uuid.uuid4().hex[:12]}"
            path = self._data(table, name, now["generation"])
            self._laid_over(table, files, now["generation"]).write.parquet(path)
            done[table] = files | {"base": name, "changes": [], "base_rows": self.spark.read.parquet(path).count(), "change_rows": 0}
        if names:
            self.tags.move("published", number, now | {"tables": done})
        return names

    def retained(self, runs: Iterable[int] | None = None) -> list[dict]:
        """The manifests of runs (all published ones), as each was last published."""
        found = [self.tags.get("published", r)[1] for r in (runs if runs is not None else self.tags.runs("published"))]
        return [m for m in found if m is not None]

    def vacuum(self, keep: Iterable[int] | None = None) -> list[str]:
        """Removes data files that no manifest of the kept runs (all published ones) names, and the own tables of other runs."""
        now, runs = self.current(), sorted(set(keep if keep is not None else self.tags.runs("published")) | {self.published()} - {None})
        named = {(m["generation"], t, n) for m in [now, *self.retained(runs)] for t, f in m["tables"].items() for n in [f["base"], *f["changes"]]}
        out = []
        for folder in self.files.names(""):
            if not folder.startswith("generation="):
                continue
            generation = int(folder.partition("=")[2])
            for table in self.files.names(folder):
                for name in self.files.names(f"{folder}/{table}"):
                    own = name.startswith("run_id=")
                    if (own and int(name[7:]) not in runs) or (not own and (generation, table, name) not in named):
                        self.files.delete(f"{folder}/{table}/{name}")
                        out.append(f"{folder}/{table}/{name}")
        self.tags.forget("published", set(runs))
        return out

    def changes(self, table: str, after: int, run: int) -> DataFrame:
        """The rows that runs after one, up to another, wrote: the change files that one manifest has and the other lacks, with __gone.

        Where a compaction lies between, the difference of both versions is taken."""
        old, new = self.manifest(after), self.manifest(run)
        a, b = old["tables"].get(table), new["tables"][table]
        if a is not None and a["base"] == b["base"] and b["changes"][: len(a["changes"])] == a["changes"]:
            over = b | {"base": None, "changes": b["changes"][len(a["changes"]) :]}
            schema = T.StructType([*T.StructType.fromJson(b["schema"]).fields, T.StructField("__gone", T.BooleanType())])
            parts = [self.spark.read.schema(schema).parquet(self._data(table, c, new["generation"])).withColumn("__at", F.lit(k)) for k, c in enumerate(over["changes"])]
            if not parts:
                return self.spark.createDataFrame([], schema)
            keys = list(self.keys[table])
            rows = reduce(DataFrame.unionByName, parts)
            return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "__at")]), "__at").alias("__r")).select(*keys, "__r.*").select(*schema.names)
        changed, gone = differences(self.read(table, after) if a is not None else self.read(table, run).limit(0), self.read(table, run), self.keys[table])
        empty = [F.col(c) if c in self.keys[table] else F.lit(None).cast(changed.schema[c].dataType).alias(c) for c in changed.columns]
        return changed.withColumn("__gone", F.lit(False)).unionByName(gone.select(*empty, F.lit(True).alias("__gone")))

    def history(self, table: str) -> DataFrame:
        """Every row that a retained data file of a table holds, whatever became of it since."""
        files = {(m["generation"], n) for m in self.retained() for n in [m["tables"].get(table, {}).get("base"), *m["tables"].get(table, {}).get("changes", [])] if n}
        schema = T.StructType.fromJson(self.current()["tables"][table]["schema"])
        wide = T.StructType([*schema.fields, T.StructField("__gone", T.BooleanType())])
        parts = [self.spark.read.schema(wide).parquet(self._data(table, n, g)) for g, n in sorted(files)]
        return reduce(DataFrame.unionByName, parts).where("not coalesce(__gone, false)").drop("__gone")

    def own_tables(self, generation: int | None = None) -> dict[str, list[int]]:
        """The tables that runs keep beside the keyed ones, and their runs."""
        folder = f"generation={self.generation() if generation is None else generation}"
        found = {t: [int(n[7:]) for n in self.files.names(f"{folder}/{t}") if n.startswith("run_id=")] for t in self.files.names(folder)}
        return {t: runs for t, runs in found.items() if runs}

    def rewrite(self, without: Callable[[DataFrame], DataFrame], check: Callable[[str, DataFrame], int]) -> dict[str, int]:
        """A new generation of every retained file, passed through ``without``; the rows by table that ``check`` still finds in it.

        With none the published tag moves to it for every run and the old generation goes; else nothing has moved.
        """
        number, now = self.tags.get("published")
        new, manifests = now["generation"] + 1, self.retained()
        left: dict[str, int] = {}
        files = {(t, n) for m in manifests for t, f in m["tables"].items() for n in [f["base"], *f["changes"]] if n}
        files |= {(t, f"run_id={r}") for t, runs in self.own_tables(now["generation"]).items() for r in runs}
        for table, name in sorted(files):  # retained files: bounded by retention and compaction
            df = self.spark.read.parquet(self._data(table, name, now["generation"]))
            without(df).write.mode("overwrite").parquet(self._data(table, name, new))
            n = check(table, self.spark.read.schema(df.schema).parquet(self._data(table, name, new)))
            left |= {table: left.get(table, 0) + n} if n else {}
        if left:
            return left
        for m in sorted(manifests, key=lambda m: m["run"]):
            number = self.tags.move("published", number, m | {"generation": new})
        self.files.delete(f"generation={now['generation']}")
        return {}
