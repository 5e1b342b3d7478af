"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is found on their
histogram, which has at most ``capacity`` entries however many documents there
are.  Items above a third of the capacity can share a bin with one other such
item at most: from the longest down, each is matched with the longest that
still fits.  Smaller items then go, from the longest down, into the smallest
gap that holds them, and into new bins where none does.  The result is a list
of bin classes (what a bin holds, and how many such bins there are); each item
finds its bin by its rank among the items of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encode
from .common import cut, fresh, parallelism, text_batches
from .words import groups

CAPACITY = 2048
def tokenize(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Rows (id, piece, start, length, ids): the ids of each text and ``end_id``, cut only if longer than ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit numbers.  A null text is empty and gives one piece with ``end_id`` alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in groups(batch.column(1)):
                ids, sizes = encode(texts, tokenizer)
                # One more id ends each text.
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(texts)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                ends = pa.array(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32))
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, ends.buffers()[1], pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data], names=["id", "piece", "start", "length", "ids"])

    text_batches(df.sparkSession)
    source = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(pieces, "id long, piece int, start long, length long, ids binary")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bin classes ([(length, items of it in a bin), ...], number of bins) that hold ``counts`` items of each length."""
    n = {k: v for k, v in counts.items() if v > 0}
    by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(gap: int, holds: list, bins: int) -> None:
        if bins > 0:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(gaps, gap)
            by_gap[gap].append([holds, bins])

    large = sorted(k for k in n if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        b = large[i] if i >= 0 else None
        if b == a and n[a] == 1:
            b = large[i - 1] if i > 0 else None
        if b is None:
            put(capacity - a, [(a, 1)], n[a])
            n[a] = 0
        elif a == b:
            put(capacity - 2 * a, [(a, 2)], n[a] // 2)
            n[a] %= 2
        else:
            m = min(n[a], n[b])
            put(capacity - a - b, [(a, 1), (b, 1)], m)
            n[a] -= m
            n[b] -= m
        large = [k for k in large if n[k]] if not n[a] or (b is not None and not n[b]) else large
    for size in sorted((k for k in n if 3 * k <= capacity), reverse=True):
        left = n[size]
        while left:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                q = capacity // size
                put(capacity - q * size, [(size, q)], left // q)
                put(capacity - (left % q) * size, [(size, left % q)], 1 if left % q else 0)
                break
            gap = gaps[i]
            holds, bins = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(i)
            q = gap // size
            full = min(bins, left // q)
            rest = left - full * q if full < bins else 0
            put(gap - q * size, [*holds, (size, q)], full)
            if rest:
                put(gap - rest * size, [*holds, (size, rest)], 1)
            put(gap, holds, bins - full - (rest > 0))
            left -= full * q + rest
    return [(holds, bins) for classes in by_gap.values() for holds, bins in classes]


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """All rows and columns of ``items`` plus ``sequence_id`` and ``offset``.

    ``length`` must be 1 to ``capacity``; ``order`` names columns that tell rows apart
    (rows alike in all of them may change places).  Columns named ``sequence_id`` or
    ``offset`` are replaced.  An empty table gives an empty result.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    salt, rank, base, size, lo, hi, seq, per, off = fresh(items, "salt", "rank", "base", "size", "lo", "hi", "seq", "per", "off")
    salted = cut(items.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(parallelism(spark))).cast("int")))
    cells = salted.groupBy(F.col(length).alias(size), salt).count()
    counts = {r[0]: r[1] for r in cells.groupBy(size).agg(F.sum("count")).collect()}
    rows, used, first = [], dict.fromkeys(counts, 0), 0
    for holds, bins in plan_bins(counts, capacity):
        at = 0
        for k, q in holds:
            rows.append((k, used[k], used[k] + bins * q, first, q, at))
            used[k] += bins * q
            at += k * q
        first += bins
    # Bounded by the capacity, not by the number of items.
    where = spark.createDataFrame(rows, f"{size} long, {lo} long, {hi} long, {seq} long, {per} long, {off} long")
    bases = cells.select(size, salt, F.coalesce(F.sum("count").over(Window.partitionBy(size).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    ranked = salted.withColumn(size, F.col(length).cast("long")).withColumn(rank, F.row_number().over(Window.partitionBy(size, salt).orderBy(*order)))
    ranked = ranked.join(bases, [size, salt]).withColumn(rank, F.col(base) + F.col(rank) - 1)
    found = ranked.join(F.broadcast(where.withColumnRenamed(size, "_" + size)), (F.col(size) == F.col("_" + size)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    nth = F.col(rank) - F.col(lo)
    return found.select(
        *items.columns,
        (F.col(seq) + F.call_function("div", nth, F.col(per))).alias("sequence_id"),
        (F.col(off) + nth % F.col(per) * F.col(size)).cast("long").alias("offset"),
    )
