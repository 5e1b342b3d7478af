"""Groups of rows that are compared among themselves, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parallelism


def each_part(df: DataFrame, key: list[str], columns: list[str], run: Callable[[np.ndarray, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, batch_rows: int) -> DataFrame:
    """Calls ``run(starts, rows)`` with whole (key, part) groups, many at a time, sorted by their keys.

    ``starts`` are the places in ``rows`` (of ``columns``) where groups begin.
    """
    by = [*key, "part"]
    n = len(by)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= batch_rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(whole, n)
                last = int(starts[-1])
                held, rows = whole.slice(last).to_batches(), whole.num_rows - last
                if last:
                    yield from run(starts[:-1], whole.slice(0, last).select(columns).to_batches(max_chunksize=None)[0])
        if rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from run(_starts(whole, n), whole.select(columns).to_batches()[0])

    rest = [c for c in columns if c not in by]
    dealt = df.select(*by, *rest).repartition(parallelism(df.sparkSession), *by).sortWithinPartitions(*by, *rest[:1])
    return dealt.mapInArrow(go, schema)


def _starts(table: pa.Table, n: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for i in range(n):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
