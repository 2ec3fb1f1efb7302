"""Trees and dependency graphs.

Walks go level by level as joins over frontiers, each level written when it is made; a node is visited once, so cycles
end.  The number of rounds is the depth of the tree.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize


def _joined(found: DataFrame | None, level: DataFrame, round_: int) -> DataFrame:
    """found and level; written as one table now and then, so that the plan of a deep walk stays short."""
    if found is None:
        return level
    both = found.unionByName(level)
    return materialize(both, "walk") if round_ % 16 == 15 else both


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """source_id, stable_id of all nodes below the roots (source_id, stable_id), tombstones included; without roots the tree is not read."""
    if roots.isEmpty():
        return tree.select("source_id", "stable_id").limit(0)
    found = None
    front = roots.select("source_id", F.col("stable_id").alias("parent_id")).distinct()
    for k in count():
        level = tree.join(front, ["source_id", "parent_id"], "left_semi").select("source_id", "stable_id").distinct()
        if found is not None:
            level = level.join(found, ["source_id", "stable_id"], "left_anti")
        level = materialize(level, "walk")
        if level.isEmpty():
            break
        found = _joined(found, level, k)
        front = level.withColumnRenamed("stable_id", "parent_id")
    return level if found is None else found


def derive_paths(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """source_id, stable_id, rel_path of nodes reached from the scope roots (source_id, stable_id).

    tree: source_id, stable_id, parent_id, name.  Orphans and cycles are never reached, so their paths stay as they are.
    """
    nodes = tree.select("source_id", "stable_id", "parent_id", "name")
    front = roots.select("source_id", F.col("stable_id").alias("parent_id"), F.lit(None).cast("string").alias("path"))
    out = None
    for k in count():
        level = nodes.join(front, ["source_id", "parent_id"]).select("source_id", "stable_id", F.concat_ws("/", "path", "name").alias("rel_path"))
        if out is not None:
            level = level.join(out.select("source_id", "stable_id"), ["source_id", "stable_id"], "left_anti")
        level = materialize(level, "walk")
        if level.isEmpty():
            break
        out = _joined(out, level, k)
        front = level.select("source_id", F.col("stable_id").alias("parent_id"), F.col("rel_path").alias("path"))
    return level if out is None else out


def scope_of(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """source_id, stable_id, scope: inside (a root or below one), outside (its top is another node), unknown."""
    inside = descendants(tree, roots).unionByName(roots.select("source_id", "stable_id")).distinct().withColumn("scope", F.lit("inside"))
    tops = tree.where("parent_id is null").select("source_id", "stable_id")
    known = descendants(tree, tops).unionByName(tops).distinct().withColumn("__known", F.lit(True))
    keys = ["source_id", "stable_id"]
    return tree.select(*keys).join(inside, keys, "left").join(known, keys, "left").select(*keys, F.coalesce("scope", F.when(F.col("__known"), "outside"), F.lit("unknown")).alias("scope"))


def nearest_ancestor_value(tree: DataFrame, values: DataFrame) -> DataFrame:
    """source_id, stable_id, value: a node's own value, else that of its nearest ancestor with one.

    Values go down from the nodes that have one; a node takes the first to come, so cycles end.
    """
    keys = ["source_id", "stable_id"]
    nodes = tree.select(*keys, "parent_id").distinct()
    held = values.select(*keys, "value").where("value is not null")
    out = materialize(nodes.select(*keys).distinct().join(held, keys), "walk")
    front = held
    for k in count():
        above = front.select("source_id", F.col("stable_id").alias("parent_id"), "value")
        front = materialize(nodes.join(above, ["source_id", "parent_id"]).select(*keys, "value").join(out.select(*keys), keys, "left_anti"), "walk")
        if front.isEmpty():
            break
        out = _joined(out, front, k)
    return out


def dependency_edges(pages: DataFrame) -> DataFrame:
    """page, source, pinned_sha, role, again from pages (page, sources: array of struct(path, sha, role)); again marks all
    but the first mention of a source in a page."""
    each = pages.select("page", F.posexplode("sources").alias("place", "x")).select("page", "place", F.col("x.path").alias("source"), F.col("x.sha").alias("pinned_sha"), F.col("x.role").alias("role"))
    first = each.groupBy("page", "source").agg(F.min("place").alias("first"))
    return each.join(first, ["page", "source"]).select("page", "source", "pinned_sha", "role", (F.col("place") > F.col("first")).alias("again"))


def refresh_queue(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """page, source, verdict of edges that are not fresh.

    edges: page, source, pinned_sha, fields (number of fields in the record); heads: source, sha, status of mirror pages.
    """
    head = heads.select(F.col("source").alias("__source"), "sha", "status")
    pin = F.col("pinned_sha")
    verdict = (
        F.when(F.col("fields") < 3, F.lit("MALFORMED"))
        .when(F.coalesce(pin, F.lit("")) == "", "UNPINNED")
        .when(~pin.rlike("^[0-9a-f]{64}$"), "BAD-PIN")
        .when(F.coalesce("source", F.lit("")) == "", "MISSING-OR-UNPARSEABLE")
        .when(F.col("status") == "deleted", "SOURCE-DELETED")
        .when(F.col("status").isin("unreadable", "refused"), "SOURCE-UNREADABLE")
        .when(F.col("sha").isNull(), "MISSING-OR-UNPARSEABLE")
        .when(F.col("sha") != pin, "STALE")
    )
    shown = F.when(F.col("fields") < 3, F.lit("")).otherwise(F.col("source"))
    rows = edges.join(head, edges["source"] == head["__source"], "left").select("page", shown.alias("source"), verdict.alias("verdict"))
    return rows.where("verdict is not null").distinct()


def banners(pages: DataFrame, queue: DataFrame, today: Column) -> DataFrame:
    """page, stale_since of pages (page, stale_since, generated): set at the first stale day and kept; cleared when fresh."""
    stale = queue.where(F.col("verdict").isin("STALE", "SOURCE-DELETED", "SOURCE-UNREADABLE")).select("page").distinct().withColumn("__stale", F.lit(True))
    since = F.when(~F.col("generated"), F.col("stale_since")).when(F.col("__stale"), F.coalesce("stale_since", today))
    return pages.join(stale, "page", "left").select("page", since.alias("stale_since"))


def uncovered_pages(mirror: DataFrame, edges: DataFrame) -> DataFrame:
    """Mirror pages (page, status) that no edge cites, but for those that are deleted or not readable."""
    return mirror.where(~F.col("status").isin("deleted", "refused", "unreadable")).join(edges.select(F.col("source").alias("page")).distinct(), "page", "left_anti")


def unlisted_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    return pages.join(edges.select("page").distinct(), "page", "left_anti")


def citing_pages(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, page: the pages that cite each source."""
    return edges.join(sources.select("source").distinct(), "source", "left_semi").select("source", "page").distinct()


def ancestor_closure(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """commit of all that the heads reach; commits: commit, parent."""
    found = materialize(heads.select("commit").distinct(), "walk")
    front = found
    for k in count():
        level = commits.join(front, "commit", "left_semi").select(F.col("parent").alias("commit")).where("commit is not null").distinct().join(found, "commit", "left_anti")
        front = materialize(level, "walk")
        if front.isEmpty():
            break
        found = _joined(found, front, k)
    return found


def compacted(commits: DataFrame, removed: DataFrame) -> DataFrame:
    """commit, parent, place of a history without the removed commits: each survivor's parents are the nearest survivors along every path.

    commits: commit, parent (null for a root), place (order among the parents).  A removed commit's links to what lies behind
    it are doubled in length each round, so a chain of n removed commits takes about log2(n) rounds; merges among them keep all their
    branches.  Of several ways to one parent the first place counts; a survivor all of whose ancestors went is a root.
    """
    out = removed.select("commit").distinct().withColumn("__out", F.lit(True))
    edges = commits.where("parent is not null").select("commit", "parent", F.col("place").cast("bigint").alias("place"))
    behind = edges.join(out.select("commit"), "commit", "left_semi")
    skip = out.select(F.col("commit").alias("parent"), F.lit(True).alias("__open"))
    behind = materialize(behind.join(skip, "parent", "left").select("commit", "parent", "place", F.coalesce("__open", F.lit(False)).alias("open")), "behind")
    while behind.where("open").limit(1).count():
        far = behind.select(F.col("commit").alias("parent"), F.col("parent").alias("__next"), F.col("open").alias("__open"))
        jumped = behind.where("open").join(far, "parent").select("commit", F.col("__next").alias("parent"), "place", F.col("__open").alias("open"))
        both = behind.where("not open").unionByName(jumped)
        behind = materialize(both.groupBy("commit", "parent").agg(F.min("place").alias("place"), F.bool_and("open").alias("open")), "behind")
    kept = edges.join(out, "commit", "left_anti").join(skip, "parent", "left")
    through = kept.where("__open").join(behind.select(F.col("commit").alias("parent"), F.col("parent").alias("__next")), "parent").select("commit", F.col("__next").alias("parent"), "place")
    links = kept.where("__open is null").select("commit", "parent", "place").unionByName(through)
    links = links.groupBy("commit", "parent").agg(F.min("place").alias("place"))
    roots = commits.select("commit").distinct().join(out, "commit", "left_anti").join(links.select("commit"), "commit", "left_anti")
    return links.unionByName(roots.select("commit", F.lit(None).cast(commits.schema["parent"].dataType).alias("parent"), F.lit(0).cast("bigint").alias("place")))


def rooted(nodes: DataFrame) -> DataFrame:
    """id and root of every node of a forest (id, parent): pointers to ancestors double each round, so rounds are logarithmic in the depth.

    A node whose parent is missing is a root.  On a cycle the least node is the root of it and of all that hangs below.
    """
    ids = nodes.select(F.col("id").alias("__p")).distinct()
    up = nodes.select("id", "parent").join(ids.hint("merge"), F.col("parent") == F.col("__p"), "left").select("id", F.coalesce("__p", "id").alias("at"), (F.col("__p").isNull() | (F.col("__p") == F.col("id"))).alias("top"))
    up = materialize(up.withColumn("least", F.least("id", "at")), "up")
    n, steps = up.count(), 1
    while steps <= n and up.where("not top").limit(1).count():
        over = up.select(F.col("id").alias("at"), F.col("at").alias("__at"), F.col("top").alias("__top"), F.col("least").alias("__least"))
        joined = up.where("not top").join(over.hint("merge"), "at").select("id", F.col("__at").alias("at"), F.col("__top").alias("top"), F.least("least", "__least").alias("least"))
        up = materialize(up.where("top").unionByName(joined), "up")
        steps *= 2
    # what is left leads into a cycle and has gone round it: the least node from where it stands is the least of the cycle
    on = up.where("not top").select(F.col("at").alias("id")).distinct().join(up.select("id", F.col("least").alias("__root")), "id")
    return up.join(on.select(F.col("id").alias("at"), "__root"), "at", "left").select("id", F.coalesce("__root", "at").alias("root"))


def preorder(nodes: DataFrame, order: list[str]) -> DataFrame:
    """id, root, place (from 1) of a forest (id, parent and the columns of ``order``): roots in order, each before what hangs below it, answers in order.

    The walk down and up every tree is one list (a step down to each node and one up from it, whose successors follow from first
    children, next siblings and parents); ranks in the list come by pointer doubling, a constant row for each step and about
    log2(2 n) rounds for a tree of n nodes, however deep; whole tables are merged, as small files of narrow rows would be sent to the driver whole.  Trees with a cycle are cut before its least node and come last.
    """
    tree = nodes.join(rooted(nodes).hint("merge"), "id")
    looped = materialize(tree.where((F.col("id") == F.col("root")) & F.col("parent").isNotNull()).select("id", "parent"), "looped")
    known = nodes.select(F.col("id").alias("parent")).distinct()
    cyclic = looped.join(known, "parent", "left_semi").select(F.col("id").alias("root"), F.lit(True).alias("cycle"))
    tree = tree.join(cyclic, "root", "left").withColumn("cycle", F.coalesce("cycle", F.lit(False))).withColumn("parent", F.when(F.col("id") != F.col("root"), F.col("parent")))
    siblings = W.partitionBy("parent").orderBy(*order, "id")
    tree = materialize(
        tree.where("parent is not null").select("id", "root", "parent", F.lead("id").over(siblings).alias("next"), F.row_number().over(siblings).alias("nth")), "siblings"
    )
    firsts = tree.where("nth = 1").select(F.col("parent").alias("id"), F.col("id").alias("first"))
    every = nodes.select("id").join(tree.select("id", "parent", "next", "root").hint("merge"), "id", "left").join(firsts.hint("merge"), "id", "left")
    root = F.coalesce("root", "id")
    down, up = F.lit(0), F.lit(1)
    step = lambda i, way: F.struct(i.alias("id"), way.alias("way"))
    into = F.when(F.col("first").isNotNull(), step(F.col("first"), down)).otherwise(step(F.col("id"), up))
    back = F.when(F.col("next").isNotNull(), step(F.col("next"), down)).when(F.col("parent").isNotNull(), step(F.col("parent"), up))
    steps = every.select(root.alias("root"), step(F.col("id"), down).alias("at"), into.alias("to"), F.lit(1).cast("bigint").alias("left"))
    steps = steps.unionByName(every.select(root.alias("root"), step(F.col("id"), up).alias("at"), back.alias("to"), F.lit(0).cast("bigint").alias("left")))
    steps = materialize(steps, "steps")
    while steps.where("to is not null").limit(1).count():
        over = steps.select(F.col("at").alias("to"), F.col("to").alias("__to"), F.col("left").alias("__left"))
        moved = steps.where("to is not null").join(over.hint("merge"), "to").select("root", "at", F.col("__to").alias("to"), (F.col("left") + F.col("__left")).alias("left"))
        steps = materialize(steps.where("to is null").unionByName(moved), "steps")
    ranks = steps.where("at.way = 0").select(F.col("at.id").alias("id"), "root", "left")
    size = ranks.groupBy("root").agg(F.count("*").alias("n"))
    before = rooted_tops(nodes, cyclic, order).join(size.hint("merge"), F.col("id") == F.col("root")).select("root", "nth", "n")
    starts = prefix_sums(before, "nth", "n").select("root", "before")
    return ranks.join(size.hint("merge"), "root").join(starts.hint("merge"), "root").select("id", "root", (F.col("before") + F.col("n") - F.col("left") + 1).alias("place"))


def rooted_tops(nodes: DataFrame, cyclic: DataFrame, order: list[str]) -> DataFrame:
    """id and nth (dense enough to sort by) of the roots: those without a parent in order, then the least nodes of cycles."""
    known = nodes.select(F.col("id").alias("parent")).distinct().withColumn("__known", F.lit(True))
    loops = cyclic.select(F.col("root").alias("id"), F.lit(1).alias("__loop"))
    tops = nodes.join(known.hint("merge"), "parent", "left").join(loops, "id", "left").where("__known is null or __loop = 1")
    return tops.select("id", F.struct(F.coalesce("__loop", F.lit(0)).alias("loop"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], "id").alias("nth"))


def prefix_sums(rows: DataFrame, order: str, n: str) -> DataFrame:
    """rows with ``before``, the sum of n over all rows of lesser ``order``: sorted over all tasks, summed by task, then inside each."""
    n_tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(n_tasks, order).withColumn("__task", F.spark_partition_id()), "dealt")
    tasks = dealt.groupBy("__task").agg(F.sum(n).alias("__n"))  # a row for each task
    earlier = tasks.select("__task", F.coalesce(F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(n).over(W.partitionBy("__task").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return dealt.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(earlier), "__task").withColumn("before", F.col("__before") + F.col("__inside")).drop("__task", "__before", "__inside")


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in the order of a column, whatever their number: no task sorts them all."""
    return prefix_sums(rows.withColumn("__one", F.lit(1).cast("bigint")), order, "__one").withColumn(name, F.col("before") + 1).drop("__one", "before")


def erasure_fixpoint(history: DataFrame, seeds: DataFrame) -> DataFrame:
    """source_id, stable_id of all objects that ever shared a path of their source with a seed (source_id, stable_id), to the end.

    history: source_id, stable_id, path over every retained snapshot.
    """
    keys = ["source_id", "stable_id"]
    found = front = materialize(seeds.select(*keys).distinct(), "walk")
    for k in count():
        paths = history.join(front, keys, "left_semi").select("source_id", "path").distinct()
        level = history.join(paths, ["source_id", "path"], "left_semi").select(*keys).distinct().join(found, keys, "left_anti")
        front = materialize(level, "walk")
        if front.isEmpty():
            break
        found = _joined(found, front, k)
    return found


def first_unmet(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that does not hold, else 'done'."""
    out = F.lit("done")
    for name, holds in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out
