"""Connected components of large graphs by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, cut, join_hot

#: Up to so many edges (16 bytes each) the smallest neighbours of all nodes are broadcast.
SMALL_EDGES = 500_000


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (a, b) with ``m``, the smallest b of each a; the rows of a hub stay where they are."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    if n <= SMALL_EDGES:
        return rows.join(F.broadcast(least.drop("degree")), "a")
    return join_hot(rows, cut(least), ["a"], F.col("degree") > HOT_ROWS).drop("degree")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (node, root): ``root`` is the smallest node that can be reached; nodes without edges are absent.

    ``edges`` has the columns a and b; edges with a null end, loops and repeated edges
    change nothing.  A large-star step links each node's larger neighbours to its smallest
    one, a small-star step links the smaller ones and the node itself; both keep what is
    connected, and repeated they leave stars.  Minima are combined before each exchange,
    and hubs are joined by broadcast, so a node with many links stays cheap.  The rounds
    needed grow with the logarithm of the number of nodes; it raises if
    ``max_rounds`` do not suffice.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    seen = state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * seen.n).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        # Every edge now leads down, so the smaller neighbours of a node are all it has.
        large = cut(large) if seen.n > SMALL_EDGES else large
        small = _with_least(large, seen.n)
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = state(edges)
        if seen == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
