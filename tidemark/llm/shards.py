"""Sharding by histogram sort.

Rows get a 126-bit key, the hash of the text and then the hash of the id.
Rounds of counting find the shard boundaries: a round counts the exact bytes
in each bin of the key ranges that still hold a sought boundary, and every
boundary that is off by more than the tolerance is sought again inside its
bin.  Only bin sums, whose number is bounded by the parameters, reach the
driver.  Then rows go to their shard in one exchange.

Equal texts share the first half of the key, so a group of copies stays in one
shard unless leaving it whole would miss the size by more than ``group_slack``
of a shard or by more than the largest row, which no boundary can divide; a
larger group is divided by the hash of the id.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

TOP = 1 << 63
FIRST_BINS = 4096
NEXT_BINS = 256
SLICES = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 16 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _hash63(col: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(col), 1)


def _less(key: tuple[Column, Column], at: tuple[int, int]) -> Column:
    u, v = key
    if at[1] == 0:
        return u < F.lit(at[0])
    return (u < F.lit(at[0])) | ((u == F.lit(at[0])) & (v < F.lit(at[1])))


def _tree(key: tuple[Column, Column], cuts: list[tuple[int, int]], lo: int, hi: int) -> Column:
    """Number of cuts at or below the key, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_less(key, cuts[mid]), _tree(key, cuts, lo, mid)).otherwise(_tree(key, cuts, mid + 1, hi))


class _Range:
    """A range of keys: of ``u`` alone, or of ``v`` at one ``u``."""

    def __init__(self, below: int, lo: int, hi: int, bins: int, at: int | None = None):
        self.below, self.lo, self.hi, self.at = below, lo, hi, at
        self.step = max(1, -(-(hi - lo) // bins))

    def key(self) -> tuple:
        return (self.at is None, self.at or 0, self.lo, self.hi)

    def holds(self, u: Column, v: Column) -> Column:
        if self.at is None:
            return u.between(F.lit(self.lo), F.lit(self.hi - 1))
        return (u == F.lit(self.at)) & v.between(F.lit(self.lo), F.lit(self.hi - 1))

    def bin(self, u: Column, v: Column) -> Column:
        x = u if self.at is None else v
        offset = x - F.lit(self.lo)
        return F.call_function("div", offset, F.lit(self.step)).cast("int")

    def start(self, b: int) -> int:
        return min(self.hi, self.lo + b * self.step)

    def cut(self, b: int) -> tuple[int, int]:
        return (self.start(b), 0) if self.at is None else (self.at, self.start(b))


def find_cuts(keys: DataFrame, n_shards: int, tolerance: float = 0.001, group_slack: float = 0.01) -> list[tuple[int, int]]:
    """Boundaries that split ``keys`` (columns u, v, size) into shards of near-equal size.

    ``tolerance`` and ``group_slack`` are shares of the mean shard; rows alike in u are a group.
    """
    u, v, size = F.col("u"), F.col("v"), F.col("size")
    open_ranges: dict[tuple, tuple[_Range, list[int]]] = {}
    first = _Range(0, 0, TOP, FIRST_BINS)
    open_ranges[first.key()] = (first, list(range(1, n_shards)))
    found: dict[int, tuple[int, int]] = {}
    total, largest = None, 0
    while open_ranges:
        ranges = [r for r, _ in open_ranges.values()]
        which, where = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, r in enumerate(ranges):
            which = F.when(r.holds(u, v), F.lit(i)).otherwise(which)
        for i, r in enumerate(ranges):
            where = F.when(F.col("r") == i, r.bin(u, v)).otherwise(where)
        bins = (
            keys.withColumn("r", which)
            .filter("r is not null")
            .withColumn("b", where)
            .groupBy("r", "b")
            .agg(F.sum(size).alias("size"), F.max(size).alias("most"), F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1"))
            .collect()
        )
        by: dict[int, list] = {}
        for row in bins:
            by.setdefault(row.r, []).append(row)
        if total is None:
            total = sum(row["size"] for row in bins)
            largest = max((row.most for row in bins), default=0)
        mean = max(total / n_shards, 1)
        todo: dict[tuple, tuple[_Range, list[int]]] = {}
        for i, (r, targets) in enumerate(open_ranges.values()):
            rows = sorted(by.get(i, []), key=lambda x: x.b)
            starts, below = [], r.below
            for row in rows:
                starts.append(below)
                below += row["size"]
            for t in targets:
                goal = total * t / n_shards
                if not rows:
                    found[t] = r.cut(0)
                    continue
                k = max(0, bisect_right(starts, goal) - 1)
                row, lo, hi = rows[k], starts[k], starts[k] + rows[k]["size"]
                near = r.cut(row.b) if goal - lo <= hi - goal else r.cut(row.b + 1)
                off = min(goal - lo, abs(hi - goal)) / mean
                alone = row.u0 == row.u1
                if off <= tolerance or (alone and r.at is None and off <= max(group_slack, largest / mean)) or (alone and row.v0 == row.v1):
                    found[t] = near
                    continue
                if alone and r.at is None:
                    new = _Range(lo, row.v0, row.v1 + 1, NEXT_BINS, at=row.u0)
                elif r.at is None:
                    new = _Range(lo, row.u0, row.u1 + 1, NEXT_BINS)
                else:
                    new = _Range(lo, row.v0, row.v1 + 1, NEXT_BINS, at=r.at)
                todo.setdefault(new.key(), (new, []))[1].append(t)
        open_ranges = todo
    cuts, last = [], (0, 0)
    for t in range(1, n_shards):
        last = max(last, found[t])
        cuts.append(last)
    return cuts


def shard(df: DataFrame, n_shards: int, text: str = "text", id: str = "doc_id", tolerance: float = 0.001, group_slack: float = 0.01) -> DataFrame:
    """All rows and columns of ``df`` plus ``size``, ``shard`` and ``slot``.

    Shards hold near-equal bytes; ``slot`` counts from 0 without gaps in each.
    A null text is empty, a null id is an id like any other; equal rows may
    change places.  An empty table gives an empty result.  If ``df`` has
    columns with these names, they are replaced.
    """
    df = df.drop("size", "shard", "slot")
    u, v, cell, rank, base = fresh(df, "key_u", "key_v", "cell", "rank", "base")
    keyed = df.withColumns({"size": text_size(F.col(text)), u: _hash63(F.coalesce(F.col(text), F.lit(""))), v: _hash63(F.col(id))})
    keys = cut(keyed.select(F.col(u).alias("u"), F.col(v).alias("v"), "size"))
    cuts = find_cuts(keys, n_shards, tolerance, group_slack)
    place = lambda x, y: (_tree((x, y), cuts, 0, len(cuts)), F.shiftright(x, 63 - 12) * SLICES + F.shiftright(y, 63 - 4))
    to, part = place(F.col("u"), F.col("v"))
    # At most FIRST_BINS * SLICES + n_shards cells whatever the input, so this side is broadcast.
    cells = (
        keys.select(to.alias("shard"), part.alias(cell))
        .groupBy("shard", cell)
        .count()
        .withColumn(base, F.sum("count").over(Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", cell, F.coalesce(base, F.lit(0)).alias(base))
    )
    to, part = place(F.col(u), F.col(v))
    order = Window.partitionBy("shard", cell).orderBy(u, v, id)
    return (
        keyed.withColumns({"shard": to, cell: part})
        .withColumn(rank, F.row_number().over(order))
        .join(F.broadcast(cells), ["shard", cell])
        .withColumn("slot", (F.col(base) + F.col(rank) - 1).cast("long"))
        .select(*df.columns, "size", "shard", "slot")
    )
