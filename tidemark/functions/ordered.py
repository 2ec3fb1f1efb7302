"""Rows of groups that stream through tasks in order: a task holds what its fold keeps, never a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT_ROWS = 10_000


def values(column: pa.Array) -> list:
    """The values of a column; plain kinds without nulls come by way of numpy, which is many times faster."""
    plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_string(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain and not column.null_count else column.to_pylist()


def in_order(rows: DataFrame, by: list[str], order: list[str | Column], read: Callable[[Iterator[tuple]], Iterable[tuple]], columns: dict[str, str]) -> DataFrame:
    """by and columns (name: type) of the tuples that ``read`` gives.

    ``read`` gets the tuples of all rows of a task, those of a group (by) next to each other and in order, and yields tuples in the
    order of by and columns; a column of another type than bigint, string or boolean is one of rows, by name and type.  A group lies in one task, whose sort spills.
    """
    keys = [rows.schema[c] for c in by]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: dict[str, pa.DataType] = {}

        def tuples() -> Iterator[tuple]:
            for batch in batches:
                same.update({f.name: f.type for f in batch.schema})
                yield from zip(*map(values, batch.columns), strict=True)

        out = iter(read(tuples()))
        while part := list(islice(out, OUT_ROWS)):
            types = [*(same[c] for c in by), *(kinds[k] if k in kinds else same[c] for c, k in columns.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=[*by, *columns])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), *(f"`{c}` {k}" for c, k in columns.items())])
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, schema)


def real(name: str) -> Column:
    """A measure as a double, null as NaN: it compares with nothing."""
    return F.coalesce(F.col(name).cast("double"), F.lit(float("nan"))).alias(name)
