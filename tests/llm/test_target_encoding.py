"""Target encoding against a loop over all earlier lines, with heavy keys, ties and odd rows."""

import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tidemark.llm import runtime, target_encoding

BEGAN = datetime(2024, 1, 1)


def tables(spark, lines, sales, items=(), vendors=(), clients=()):
    return (
        spark.createDataFrame(list(lines), "sale_id bigint, item_id bigint, vendor_id bigint, flag string, n_lines string, t string"),
        spark.createDataFrame(list(sales), "sale_id bigint, client_id bigint, sold_at timestamp, fold string"),
        spark.createDataFrame(list(items), "item_id bigint, kind string"),
        spark.createDataFrame(list(vendors), "vendor_id bigint, nation_id int"),
        spark.createDataFrame(list(clients), "client_id bigint, segment string"),
    )


def plain(lines, sales, items, vendors, clients):
    sold = {s[0]: s for s in sales if s[0] is not None and s[2] is not None}
    of = [dict(items), dict(vendors), dict(clients)]
    rows = []
    for sale, item, vendor, flag, *_ in lines:
        if sale in sold:
            ids = [-1 if x is None else x for x in (item, vendor, sold[sale][1])]
            rows.append((sale, *ids, sold[sale][2], zlib.crc32(str(sale).encode()) % 5, flag == "returned", [d.get(x) for d, x in zip(of, ids, strict=True)]))
    rate = lambda n, s, p: p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)
    out = {}
    for r in rows:
        past = [x for x in rows if x[4] < r[4] and x[5] != r[5]]
        count = lambda some: (len(some), sum(x[6] for x in some))
        p = rate(*count(past), 500_000)
        told = []
        for k in range(3):
            n, s = count([x for x in past if x[1 + k] == r[1 + k]])
            told += [n, rate(n, s, rate(*count([x for x in past if x[7][k] == r[7][k]]), p))]
        mine = [x for x in rows if x[:3] == r[:3]]
        out[r[:3]] = (len(mine), sum(x[6] for x in mine), *told)
    return out


def result(df):
    return {(r.sale_id, r.item_id, r.vendor_id): (r.n_lines, r.n_returned, r.item_n, r.item_rate, r.vendor_n, r.vendor_rate, r.client_n, r.client_rate) for r in df.collect()}


def cases(seed, n, spread):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.05 else x
    sales = [(i, maybe(rng.choice([1, 1, 1, rng.randrange(30)])), maybe(BEGAN + timedelta(microseconds=rng.randrange(spread))), "x") for i in range(n)] + [(None, 1, BEGAN, "x")]
    lines = [(maybe(rng.choice([5, rng.randrange(n + 10)])), maybe(rng.choice([7, rng.randrange(40)])), rng.choice([3, rng.randrange(8)]), rng.choice(["returned", "kept", None]), "x", "y") for _ in range(3 * n)]
    lines += lines[:20]
    return lines, sales, [(i, rng.choice(["a", "b", None, ""])) for i in range(35)], [(i, rng.choice([1, 2, None])) for i in range(7)], [(i, rng.choice(["s", None])) for i in range(25)]


def test_equals_a_loop_over_earlier_lines(spark, monkeypatch):
    for seed, n, spread in ((2, 150, 40),):
        data = cases(seed, n, spread)
        assert result(target_encoding.shop_rates(*tables(spark, *data))) == plain(*data)
    # small bounds: heavy keys with trees of their own, that grow, and nodes that are copied
    for where, name, small in ((target_encoding, "LEAF_ROWS", 10), (runtime, "HEAVY_SHARE", 10), (runtime, "HEAVY_ROWS", 10), (target_encoding, "LEAF", 2)):
        monkeypatch.setattr(where, name, small)
    data = cases(3, 120, 10**6)
    bunched = [(s[0], s[1], s[2] and (BEGAN + timedelta(days=90) if s[0] == 0 else s[2]), s[3]) for s in data[1]]
    assert result(target_encoding.shop_rates(*tables(spark, data[0], bunched, *data[2:]))) == plain(data[0], bunched, *data[2:])


def test_empty_tables_and_times_without_a_zone(spark):
    data = cases(4, 30, 10**9)
    assert result(target_encoding.shop_rates(*tables(spark, [], data[1]))) == {}
    assert result(target_encoding.shop_rates(*tables(spark, data[0], []))) == {}
    alone = [(1, 2, 3, "returned", "x", "y")]
    assert result(target_encoding.shop_rates(*tables(spark, alone, [(1, None, BEGAN, "x")]))) == {(1, 2, 3): (1, 1, 0, 500_000, 0, 500_000, 0, 500_000)}
    got = spark.createDataFrame([(1,)], "a int").select(
        target_encoding.micros(F.expr("TIMESTAMP_NTZ'2024-03-31 02:30:01.000007'"), "timestamp_ntz").alias("a"), target_encoding.micros(F.expr("TIMESTAMP'1969-12-31 23:59:59.5Z'"), "timestamp").alias("b")
    )
    assert got.first() == (1711852201000007, -500000)


def test_sums_go_on_over_batches():
    rng, folds, rows = np.random.default_rng(3), 3, []
    for key in range(6):
        rows.append((key, 0, rng.integers(0, 9, 2 * folds).tolist(), 10 + key, -1, -1, 0, 0))
        rows += sorted((key, 0, None, 0, int(rng.integers(0, 7)), int(rng.integers(0, folds)), int(rng.integers(1, 4)), int(rng.integers(0, 2))) for _ in range(int(rng.integers(0, 25))))
    rows.sort(key=lambda r: (r[0], r[4]))
    names = ["key", "leaf", "known", "parent_key", "t", "fold", "n", "s"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(step):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + step], strict=True), kinds, strict=True)], names) for a in range(0, len(rows), step)]
        out = pa.Table.from_batches(list(target_encoding.sum_leaves(folds, True)(iter(parts))))
        return [tuple(r.values()) for r in out.to_pylist()]

    want, known = [], None
    for r in rows:
        if r[5] < 0:
            known, seen, parent = r[2], [], r[3]
            continue
        past = [x for x in seen if x[4] < r[4] and x[5] != r[5]]
        base = [sum(known[2 * f + k] for f in range(folds) if f != r[5]) for k in (0, 1)]
        want.append((*r[4:], parent, base[0] + sum(x[6] for x in past), base[1] + sum(x[7] for x in past)))
        seen.append(r)
    assert all(run(step) == want for step in (1, 2, 3, 7, 1000))
