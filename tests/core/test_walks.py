"""Walks over trees deeper than 64 levels and threads longer than 32."""

from tidemark.operators import graph, parts

KEYS = "source_id string, stable_id string"


def test_deep_trees_are_walked_to_the_end(spark):
    n = 67
    tree = spark.createDataFrame([("s", f"n{k}", f"n{k - 1}" if k else None, f"p{k}") for k in range(n)] + [("s", "x", "y", "x"), ("s", "y", "x", "y")], f"{KEYS}, parent_id string, name string")
    root = spark.createDataFrame([("s", "n0")], KEYS)
    assert {r.stable_id for r in graph.descendants(tree, root).collect()} == {f"n{k}" for k in range(1, n)}
    assert {r.stable_id: r.rel_path for r in graph.derive_paths(tree, root).collect()}[f"n{n - 1}"] == "/".join(f"p{k}" for k in range(1, n))
    values = spark.createDataFrame([("s", "n0", "v"), ("s", "n1", "w")], f"{KEYS}, value string")
    assert {r.stable_id: r.value for r in graph.nearest_ancestor_value(tree, values).collect()} == {"n0": "v"} | {f"n{k}": "w" for k in range(1, n)}


def test_long_threads(spark):
    comments = spark.createDataFrame([(k, k - 1 if k else None) for k in range(36)] + [(50, 51), (51, 50)], "id bigint, parent bigint")
    assert {r.id: (r.root, r.level) for r in parts.comment_threads(comments).collect()} == {k: (0, k) for k in range(36)} | {50: (50, 0), 51: (51, 0)}
