"""Nearest neighbours of a table without ties whose rows stand in it several times."""

import numpy as np

from tidemark.llm import neighbours


def test_repeated_rows_take_no_places(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 300)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(150, 8))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    want = {(q, k + 1, int(x)) for q in (0, 50, 100) for k, x in enumerate(np.argsort(-sims[q])[:5])}
    for copies, moved in ((1, 0.0), (2, 0.0), (6, 0.0), (6, 1e-6)):  # moved: copies that differ a little
        rows = [(i, (x * (1 + c) + moved * c).tolist()) for i, x in enumerate(v) for c in range(copies) if moved or c == 0]
        rows = rows if moved else rows * copies
        found = neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
        assert {(r.query_id, r.rank, r.vec_id) for r in found} == want and len(found) == 15
