"""Streaming over sorted partitions in Arrow batches, for operators that need imperative logic per key.

`over_groups` keeps one group in memory at a time, `over_partitions` one batch; neither builds pandas frames.
Spark sorts each partition (spilling when it must), so memory doesn't follow the partition's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray]


def to_numpy(batch: pa.RecordBatch | pa.Table) -> Columns:
    """Columns as NumPy arrays: nulls in numbers become NaN (doubles) where there are any; strings stay objects."""
    return {name: batch.column(i).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(i).to_numpy() for i, name in enumerate(batch.schema.names)}


def over_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def boundaries(columns: list[np.ndarray]) -> np.ndarray:
    """Positions at which any of the columns differs from the row before; 0 is one of them. Nulls (None, NaN) equal each other."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    if n:
        change[0] = True
    for c in columns:
        a, b = c[1:], c[:-1]
        differ = a != b
        if c.dtype.kind == "f":
            differ &= ~(np.isnan(a) & np.isnan(b))
        change[1:] |= differ.astype(bool)
    return np.flatnonzero(change)


def over_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Columns], dict | None], schema: str, partitions: int | None = None) -> DataFrame:
    """`fn` on each group of rows with equal `keys`, sorted by `order`; it returns columns of `schema` or None.

    Groups must be of bounded size (keys hold a time block or a shard). Null keys form their own group.
    """
    spread = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    ordered = spread.sortWithinPartitions(*keys, *order)
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready: list[pa.Table] = []
        waiting = 0

        def emit(group: pa.Table) -> None:
            nonlocal waiting
            got = fn(to_numpy(group))
            if got is not None and len(next(iter(got.values()))):
                t = pa.table({f.name: pa.array(got[f.name], f.type, from_pandas=True) for f in out_schema}, schema=out_schema)
                ready.append(t)
                waiting += t.num_rows

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal ready, waiting
            if waiting > least:
                yield from pa.concat_tables(ready).combine_chunks().to_batches(20_000)
                ready, waiting = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = boundaries([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
            same = False
            if held:
                last = held[-1]
                same = all(last.column(last.schema.get_field_index(k))[last.num_rows - 1] == batch.column(batch.schema.get_field_index(k))[0] for k in keys)
                if not same:
                    emit(pa.Table.from_batches(held))
                    held = []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if a and held:
                    emit(pa.Table.from_batches(held))
                    held = []
                held.append(part)
            yield from flush(20_000)
        if held:
            emit(pa.Table.from_batches(held))
        yield from flush(0)

    return ordered.mapInArrow(run, schema)
