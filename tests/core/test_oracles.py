"""Every query that SQL can express against its twin in another engine, over the smallest tables."""

import duckdb
import pytest

from tidemark.plans.all_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_twin(spark, sf_dir, engine, tmp_path, name):
    QUERIES[name](spark, sf_dir).write.parquet(f"{tmp_path}/got")
    engine.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLES[name]}")
    engine.execute(f"CREATE OR REPLACE TEMP VIEW got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    kinds = lambda t: sorted(r[:2] for r in engine.execute(f"DESCRIBE {t}").fetchall())
    assert kinds("got") == kinds("want")
    cols = ", ".join(f'"{c}"' for c, _ in kinds("want"))
    for a, b in (("got", "want"), ("want", "got")):
        odd = engine.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall()
        assert not odd, (a, odd)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
