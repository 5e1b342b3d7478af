"""Places in an order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import kept


def placed(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row within its group ``by`` in ascending ``order``, as ``row_number() - 1`` would give.

    Rows are dealt by ranges of (by, order) and numbered where they lie; what is added to
    these numbers is the count of the group's rows in the ranges before.  So a group of any
    size is spread over tasks; only counts, one for each group and range, are cumulated.
    Nulls come first and are a group of their own; rows that tie take places in any order.
    """
    key = [*by, *order]
    taken = set(df.columns)
    at, first, before, task = (next(n for n in (p + s for s in ["", *map(str, range(99))]) if n not in taken) for p in ("_at", "_first", "_before", "_task"))
    dealt = kept(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(at, F.monotonically_increasing_id()))
    own = dealt.withColumn(task, F.shiftright(at, 33))
    counts = own.groupBy(*by, task).agg(F.min(at).alias(first), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn(before, F.coalesce(earlier, F.lit(0))).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, task])], first, before)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, task])]
    return own.join(base, same).select(*df.columns, (F.col(at) - F.col(first) + F.col(before)).alias(name))
