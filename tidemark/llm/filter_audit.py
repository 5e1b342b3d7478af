"""What the filters of a pipeline do to each other, from one cube over their flags.

Every row says, by a boolean flag, which filters it fails.  Rows are counted by
part and flags (the only pass that grows with the data), and a CUBE over these
few cells gives, in the grouping sets whose selected flags are all false, what
survives each subset of the filters.  A step of an order goes from the subset
applied before it to that subset with one filter more, so what it removes is
the difference of two survivors, found by joining pairs of subsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, SPACE, cut, join_hot, table


def text_flags(text: Column) -> dict[str, Column]:
    """The flags that a text decides by itself; null counts as empty, which fails for its few words only.

    A: under 50 words; B: under 65 % of the words are distinct; C: over 5 % of the characters
    are A to Z; D: a mark of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def repeats(rows: DataFrame, id: str, digest: str) -> DataFrame:
    """``rows`` plus ``repeats``: whether a row of smaller id has the same digest.

    Rows that share the smallest id of their digest repeat nothing; a null id is smaller
    and larger than none.
    """
    groups = rows.groupBy(digest).agg(F.min(id).alias("least_id"), F.count("*").alias("copies")).filter("copies > 1")
    out = join_hot(rows, cut(groups), [digest], F.col("copies") > HOT_ROWS, "left")
    return out.withColumn("repeats", F.coalesce(F.col(id) > F.col("least_id"), F.lit(False))).drop("least_id", "copies")


def survivors(cells: DataFrame, flags: Sequence[str], part: str, counts: Sequence[str]) -> DataFrame:
    """Rows (part, subset, counts...): the rows that pass all filters of each subset, zeros included.

    ``cells`` has the boolean ``flags``, ``part`` (not null) and counts.  Bit i of ``subset``
    stands for flag i.
    """
    n = len(flags)
    cube = cells.cube(*flags, part).agg(*[F.sum(c).alias(c) for c in counts], F.grouping_id().alias("rolled"))
    # Of the grouping id the first flag has the highest bit, the part the lowest; a bit is 0 where the column is selected.
    selected = [(F.shiftright("rolled", n - i).bitwiseAND(F.lit(1)) == 0) for i in range(n)]
    none_fails = ~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags]) if n > 1 else ~F.coalesce(F.col(flags[0]), F.lit(False))
    subset = sum((F.when(s, 1 << i).otherwise(0) for i, s in enumerate(selected)), F.lit(0))
    kept = cube.filter((F.col("rolled").bitwiseAND(F.lit(1)) == 0) & none_fails).select(part, subset.alias("subset"), *counts)
    every = cells.select(part).distinct().select(part, F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("subset"))
    return every.join(kept, [part, "subset"], "left").select(part, "subset", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def orders(flags: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """(order, step, place of the step's filter, subset before it, subset after it) of all orders of the filters."""
    out = []
    for p in permutations(range(len(flags))):
        before = 0
        for step, i in enumerate(p, 1):
            out.append(("".join(flags[j] for j in p), step, i, before, before | 1 << i))
            before |= 1 << i
    return out


def audit(rows: DataFrame, flags: Sequence[str] = "ABCDE", part: str = "part", losses: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """For each part, order of the filters and step: what the step keeps and removes, and what its filter does alone.

    ``rows`` has a boolean column for each flag (null passes), ``part`` (null is the empty
    string) and a boolean column for each loss (null is false).  Columns: part,
    filter_order, step, kept, removed, redundant (rows that fail the step's filter and are gone
    before), unique_fails (rows that fail this filter only), ``<loss>_lost`` (rows removed here
    that are marked so), shapley (what the filter removes, summed over all orders).  With n
    filters there are n! orders, so this is for a handful; an empty table gives no rows.
    """
    n = len(flags)
    marked = rows.select(
        F.coalesce(part, F.lit("")).alias(part), *[F.coalesce(f, F.lit(False)).alias(f) for f in flags], *[F.coalesce(x, F.lit(False)).cast("long").alias(x) for x in losses]
    )
    counts = ["rows", *losses]
    cells = cut(marked.groupBy(part, *flags).agg(F.count("*").alias("rows"), *[F.sum(x).alias(x) for x in losses]))
    left = cut(survivors(cells, flags, part, counts))

    # Pairs of subsets that differ by one filter: the same pair serves all orders that pass through it.
    steps = left.select(part, F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in counts]).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    steps = steps.withColumn("after", F.col("before").bitwiseOR(F.expr("shiftleft(1, place)"))).filter("after <> before")
    pairs = steps.join(left.withColumnRenamed("subset", "after"), [part, "after"])
    gone = pairs.select(part, "before", "after", "place", F.col("rows").alias("kept"), (F.col("rows_before") - F.col("rows")).alias("removed"), *[(F.col(f"{x}_before") - F.col(x)).alias(f"{x}_lost") for x in losses])
    size = F.bit_count("before").cast("int")
    # So many orders have exactly the filters of this subset before the step.
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    alone = gone.groupBy(part, "place").agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"),
    )
    each = gone.join(alone, [part, "place"])
    listed = rows.sparkSession.createDataFrame(orders(flags), "filter_order string, step int, place int, before int, after int")
    out = each.join(F.broadcast(listed), ["place", "before", "after"])
    return out.select(part, "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{x}_lost" for x in losses], F.col("shapley").cast("long").alias("shapley"))


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """Rows (part, A..E, good, toxic), one for each row of ``docs``: the five flags and the labels.

    E: the text, known by its SHA-256, is also that of a smaller id, wherever in the table.
    An id with several label rows is good or toxic if one of them says so; ids without a label
    are neither, nor are null ids.
    """
    own = text_flags(F.col(text))
    narrow = table(docs.select(F.col(id).alias("id"), F.col(part).cast("string").alias("part"), *[c.alias(f) for f, c in own.items()], F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest")))
    seen = repeats(narrow, "id", "digest").select("id", "part", *own, F.col("repeats").alias("E"))
    said = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id are no key of a join, however many they are.
    met = seen.filter("id is not null").join(said, "id", "left").withColumns({x: F.coalesce(x, F.lit(False)) for x in ("good", "toxic")})
    none = seen.filter("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    columns = ["part", *own, "E", "good", "toxic"]
    return met.select(*columns).unionByName(none.select(*columns))
