"""Folder trees listed by many tasks; folders that could not be read are known as such (``classify.absent_or_unknown``)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.operators.graph import _joined

#: name, kind (file, folder, link, volume), size, mtime_ns
Entry = tuple[str, str, int, int]
TREE = "path string, kind string, status string, size bigint, mtime_ns bigint"


def folder_entries(path: str) -> list[Entry]:
    """A folder of a file system that all executors mount.  Links are named and not followed, other volumes not entered."""
    here, out = os.stat(path).st_dev, []
    with os.scandir(path) as entries:
        for e in entries:
            s = e.stat(follow_symlinks=False)
            kind = "link" if e.is_symlink() else "file" if not e.is_dir() else "folder" if s.st_dev == here else "volume"
            out.append((e.name, kind, s.st_size, s.st_mtime_ns))
    return out


def walk_tree(roots: DataFrame, entries: Callable[[str], list[Entry]] = folder_entries, budget: int = 256, tasks: int | None = None) -> DataFrame:
    """path, kind, status, size, mtime_ns of all that lies under the roots (path), each path once, the roots among them.

    status of a file or link: listed.  Of a folder: listed; refused (PermissionError); gone (FileNotFoundError: its removal will be told elsewhere);
    unread (another OSError); volume (another file system, not entered).  Nothing is said of what lies under the last four.
    Each task walks its folders down to some number of them and hands the rest back; what is handed back is dealt anew to all tasks, so one deep or
    wide subtree does not stay with one task.  Every round is a written table.  A path that leads back to a walked one ends there.
    """
    spark = roots.sparkSession
    n = tasks or spark.sparkContext.defaultParallelism

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walked = 0
        for batch in batches:
            todo, out, seen = list(batch["path"]), [], set()
            while todo and walked < budget:
                path = todo.pop()
                if path in seen:
                    continue
                seen.add(path)
                walked += 1
                try:
                    inside = entries(path)
                except PermissionError:
                    out.append((path, "folder", "refused", None, None))
                    continue
                except FileNotFoundError:
                    out.append((path, "folder", "gone", None, None))
                    continue
                except OSError:
                    out.append((path, "folder", "unread", None, None))
                    continue
                out.append((path, "folder", "listed", None, None))
                for name, kind, size, mtime_ns in inside:
                    below = f"{path.rstrip('/')}/{name}"
                    if kind == "folder":
                        todo.append(below)
                    else:
                        out.append((below, *(("folder", "volume") if kind == "volume" else (kind, "listed")), size, mtime_ns))
            out += [(path, "folder", "open", None, None) for path in set(todo) - seen]
            for at in range(0, len(out), 10_000):
                frame = pd.DataFrame(out[at : at + 10_000], columns=["path", "kind", "status", "size", "mtime_ns"])
                yield frame.astype({"size": "Int64", "mtime_ns": "Int64"})

    front, found = roots.select("path").distinct(), None
    for k in count():
        level = materialize(front.repartition(n).mapInPandas(step, TREE), "tree")
        found = _joined(found, level.where("status <> 'open'"), k)
        walked = found.where("kind = 'folder'").select("path")
        front = materialize(level.where("status = 'open'").select("path").distinct().join(walked, "path", "left_anti"), "tree-front")
        if front.isEmpty():
            return found.dropDuplicates(["path"])


def walk_listed(roots: DataFrame, children: DataFrame, answers: DataFrame) -> DataFrame:
    """path, kind, status of all that is reached from the roots (path) through listings that were fetched, each path once.

    children: parent (a path), name, kind (file, folder).  answers: path, status of folders, listed where there is none.  A folder of any other
    status is named and what lies below it is not reached.
    """
    said = answers.select("path", F.col("status").alias("__status")).dropDuplicates(["path"])
    front, found = roots.select("path").distinct(), None
    for k in count():
        status = F.coalesce("__status", F.lit("listed")).alias("status")
        folders = materialize(front.join(said, "path", "left").select("path", F.lit("folder").alias("kind"), status), "tree")
        if folders.isEmpty():
            return folders if found is None else found
        inside = children.join(folders.where("status = 'listed'").select(F.col("path").alias("parent")), "parent")
        level = materialize(inside.select(F.concat("parent", F.lit("/"), "name").alias("path"), "kind").distinct(), "tree-level")
        found = _joined(found, folders.unionByName(level.where("kind <> 'folder'").withColumn("status", F.lit("listed"))), k)
        front = level.where("kind = 'folder'").select("path").join(found.where("kind = 'folder'").select("path"), "path", "left_anti")
