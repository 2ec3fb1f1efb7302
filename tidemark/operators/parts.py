"""Small relational forms over the parts of one file: slides, charts, merged cells, comments, grids, states, front matter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import sha
from tidemark.functions.scratch import materialize
from tidemark.functions.text import nfc_fold
from tidemark.operators.graph import _joined


def slide_order(shapes: DataFrame, by: list[str], row_gap: float = 0.05) -> DataFrame:
    """Shapes (by, id, top, left) with place: a row starts where the top is over the gap below the row's first top; inside
    a row from left to right.  Where rows begin is folded over the sorted shapes of one slide by a native aggregate."""
    order = F.array_sort(F.collect_list(F.struct("top", "left", "id")))
    zero = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, x: Column) -> Column:
        new = a["first"].isNull() | (x["top"] - a["first"] > row_gap)
        row = a["row"] + new.cast("int")
        return F.struct(F.when(new, x["top"]).otherwise(a["first"]).alias("first"), row.alias("row"), F.concat(a["rows"], F.array(row)).alias("rows"))

    rows = shapes.select(*by, "id", F.col("top").cast("double").alias("top"), F.col("left").cast("double").alias("left")).groupBy(*by).agg(order.alias("s"))  # shapes of one slide
    each = rows.select(*by, F.explode(F.arrays_zip("s", F.aggregate("s", zero, step)["rows"].alias("row"))).alias("z")).select(*by, "z.s.id", "z.s.left", "z.s.top", "z.row")
    return each.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("row", "left", "top", "id"))).select(*by, "id", "row", "place")


def chart_table(points: DataFrame, by: list[str], categories: DataFrame) -> DataFrame:
    """by, series, idx, category, value: the first point of an index counts, one past the categories doesn't."""
    first = points.groupBy(*by, "series", "idx").agg(F.min_by("value", "seq").alias("value"))
    return first.join(categories.select(*by, "idx", "category"), [*by, "idx"])


def filled_cells(cells: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Cells of a sheet with the origin's value copied over each merged span (top, left, bottom, right)."""
    area = spans.withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right")))
    origin = cells.select(*by, F.col("row").alias("top"), F.col("col").alias("left"), F.col("value").alias("__value"))
    copied = area.join(origin, [*by, "top", "left"]).select(*by, "row", "col", "__value")
    return cells.join(copied, [*by, "row", "col"], "full_outer").select(*by, "row", "col", F.coalesce("__value", "value").alias("value"))


def first_places(texts: DataFrame, by: list[str]) -> DataFrame:
    """Each text of a block once, at its first place."""
    return texts.groupBy(*by, "text").agg(F.min("place").alias("place"))


def comment_threads(comments: DataFrame) -> DataFrame:
    """id, root, level: roots are comments without a parent here; answers nest; what only a cycle reaches comes as roots."""
    known = comments.select(F.col("id").alias("__id"))
    tops = comments.join(known, comments["parent"] == known["__id"], "left_anti").select("id", F.col("id").alias("root"), F.lit(0).alias("level"))
    found = front = materialize(tops, "walk")
    for k in count(1):
        answers = comments.join(front.select(F.col("id").alias("parent"), "root"), "parent").select("id", "root", F.lit(k).alias("level"))
        front = materialize(answers.join(found.select("id"), "id", "left_anti"), "walk")
        if front.isEmpty():
            break
        found = _joined(found, front, k)
    loose = comments.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).alias("level"))
    return found.unionByName(loose)


def scanned_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """file, outcome, n: pages with few characters that are not blank are scans."""
    outcome = F.when(F.length(F.regexp_replace("text", r"\s+", "")) < least, "scanned").otherwise("text")
    return pages.groupBy("file", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def revisits(states: DataFrame, by: str, cells: int = 57_600, share: float = 0.002) -> DataFrame:
    """by, state, first: the earliest earlier state whose grid differs in a small share of its cells and whose rows don't
    differ past the text rule; chains end at the original.  states: by, state, grid (bytes), rows."""
    import numpy as np

    def apart(a: list[str], b: list[str]) -> bool:
        odd = sum(len(x) for x in a if x not in b) + sum(len(x) for x in b if x not in a)
        return odd * 100 > 30 * (sum(map(len, a)) + sum(map(len, b)))

    def find(group: pd.DataFrame) -> pd.DataFrame:
        g, out, origin = group.sort_values("state"), [], {}
        seen: list[tuple[int, np.ndarray, list[str]]] = []
        for r in g.itertuples():
            grid, rows = np.frombuffer(r.grid, np.uint8), list(r.rows)
            hit = next((k for k, other, said in seen if len(other) == len(grid) and (other != grid).sum() <= share * max(len(grid), 1) and not apart(said, rows)), None)
            origin[r.state] = origin.get(hit, hit) if hit is not None else r.state
            if hit is not None:
                out.append((getattr(r, by), r.state, origin[r.state]))
            seen.append((r.state, grid, rows))
        return pd.DataFrame(out, columns=[by, "state", "first"])

    kind = dict(states.dtypes)[by]
    return states.groupBy(by).applyInPandas(find, f"{by} {kind}, state bigint, first bigint")


def changed_cells(frames: DataFrame, by: list[str], least: int = 12) -> DataFrame:
    """by, tick, changed: cells of a frame's grid that differ from the frame before by some brightness."""
    import numpy as np

    before = F.lag("grid").over(W.partitionBy(*by).orderBy("tick"))
    pairs = frames.withColumn("__before", before).where("__before is not null").select(*by, "tick", "grid", "__before")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [int((np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)) >= least).sum()) for a, b in zip(batch["grid"], batch["__before"], strict=True)]
            yield batch[[*by, "tick"]].assign(changed=n)

    kinds = dict(frames.dtypes)
    return pairs.mapInPandas(count, ", ".join(f"{c} {kinds[c]}" for c in (*by, "tick")) + ", changed bigint")


def capped(pages: DataFrame, room: int, text: str = "text") -> DataFrame:
    """Pages with shown: text cut at a line end within the room, an open code fence closed; cut says that it was."""
    prefix = F.substring(text, 1, room)
    line_end = room - F.length(F.substring_index(prefix, "\n", -1))
    short = F.length(text) <= room
    body = F.when(short, F.col(text)).otherwise(F.substr(F.col(text), F.lit(1), F.when(line_end > 0, line_end).otherwise(F.lit(room))))
    fences = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^(```)"), F.lit(1)))
    return pages.withColumn("cut", ~short).withColumn("shown", F.when(short | (fences % 2 == 0), body).otherwise(F.concat(body, F.lit("```\n"))))


def front_matter(c: Column) -> Column:
    """The first front matter block as a map of its plain keys."""
    block = F.regexp_extract(c, r"\A---\n((?:(?!---\n).*\n)*?)---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*: "))
    return F.map_from_arrays(F.transform(lines, lambda x: F.substring_index(x, ": ", 1)), F.transform(lines, lambda x: F.regexp_replace(x, r"^[^:]*: ", "")))


def table_lines(header: Column, rows: Column) -> Column:
    """A markdown table of an array of cells and an array of such arrays."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.regexp_replace(F.regexp_replace(x, r"\|", r"\\|"), r"\s+", " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(header, lambda x: F.lit(" --- |")), ""))
    return F.concat(line(header), F.lit("\n"), rule, F.lit("\n"), F.array_join(F.transform(rows, line), "\n"))


def allocated_paths(wanted: DataFrame, owned: DataFrame) -> DataFrame:
    """source_id, stable_id, path: a page keeps the path it owns; among new ones of one folded path the least (source, id)
    has it, and the others, or all if it is owned, get a hash of their id before the extension.

    wanted and owned: source_id, stable_id, path.
    """
    keys = ["source_id", "stable_id"]
    mine = owned.select(*keys, F.col("path").alias("__mine"))
    taken = owned.select(nfc_fold("path").alias("__key")).distinct().withColumn("__taken", F.lit(True))
    rows = materialize(wanted.join(mine, keys, "left").withColumns({"__key": nfc_fold("path"), "__own": nfc_fold("__mine")}), "named")
    kept = rows.where("__own = __key").select(*keys, F.col("__mine").alias("path"))
    fresh = materialize(rows.join(kept.select(*keys), keys, "left_anti"), "fresh")
    if fresh.isEmpty():
        return kept
    fresh = fresh.join(taken, "__key", "left")
    first = F.row_number().over(W.partitionBy("__key").orderBy("source_id", "stable_id"))
    plain = F.col("__taken").isNull() & (F.col("__n") == 1)
    tail = F.concat(F.lit("-"), sha("stable_id", 8))
    marked = F.when(F.col("path").endswith(".md"), F.concat(F.regexp_replace("path", r"\.md$", ""), tail, F.lit(".md"))).otherwise(F.concat("path", tail))
    new = fresh.withColumn("__n", first).select(*keys, F.when(plain, F.col("path")).otherwise(marked).alias("path"))
    return kept.unionByName(new)


def citation_stub(pages: DataFrame) -> DataFrame:
    """page, stub: what to paste to cite a page as it is now."""
    return pages.select("page", F.concat(F.lit("  - path: "), "page", F.lit("\n    sha: "), "sha", F.lit("\n    role: source\n")).alias("stub"))
