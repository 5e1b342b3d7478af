"""Paired bootstrap of metric differences with a counter-based generator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import kept
from .ranks import placed

# The generator's constants and the defaults of the test.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SEED, ROUNDS, LEAST_PAIRS, CONFIDENCE = 0x5EED1234, 2000, 8, 0.95


def draws(t: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Draw number t (from 1) of a sequential SplitMix64 generator, modulo n."""
    z = np.uint64(seed) + t.astype(np.uint64) * np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def participates(metric: str) -> Column:
    k = {"hit_at1": 1, "hit_at3": 3, "hit_at5": 5}.get(metric)
    return F.col("is_positive") & (F.lit(True) if k is None else F.col("expected_count") <= k)


#: Pairs of a block, and draws that are made at a time.
BLOCK = 65_536


def differences(current: DataFrame, baseline: DataFrame, metrics: list[str], scope: str | None) -> DataFrame:
    """Rows (metric, case_id, d): for each metric the differences of the cases that take part in it in both tables."""

    def side(df: DataFrame, name: str) -> DataFrame:
        some = df if scope is None else df.filter(F.col("scope") == scope)
        values = [F.when(participates(m), F.struct(F.lit(m).alias("metric"), F.col(m).cast("int" if m.startswith("hit") else "double").cast("double").alias(name))) for m in metrics]
        return some.select("case_id", F.explode(F.array_compact(F.array(*values))).alias("x")).select("case_id", "x.*")

    return side(current, "c").join(side(baseline, "b"), ["metric", "case_id"]).select("metric", "case_id", (F.col("c") - F.col("b")).alias("d"))


def intervals(current: DataFrame, baseline: DataFrame, metrics: list[str], scope: str | None = "in_scope", rounds: int = ROUNDS, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """Rows (metric, delta, lower, upper, pairs) for cases in both outcome tables; no row for a metric with fewer than eight pairs.

    Pairs are numbered in order of their ids and lie in blocks.  Draw t of the generator
    needs no earlier draw, so any task makes any stretch of a round's draws; it sends the
    numbers drawn to the blocks that have them, which add up their differences by round.
    """
    rows = placed(differences(current, baseline, metrics, scope), ["metric"], ["case_id"])
    totals = kept(rows.groupBy("metric").agg(F.count("*").alias("n"), F.sum("d").alias("total")).filter(F.col("n") >= LEAST_PAIRS))
    blocks = rows.groupBy("metric", F.floor(F.col("place") / BLOCK).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "d"))), lambda x: x["d"]).alias("ds"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for metric, n, number, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = np.sort(draws(np.arange(number * n + lo, number * n + min(lo + BLOCK, n)) + 1, n, seed))
                of, first = np.unique(i // BLOCK, return_index=True)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(i)), pa.int32()), pa.array(i % BLOCK, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([metric] * len(of)), pa.array([number] * len(of), pa.int64()), pa.array(of, pa.int32()), places], names=["metric", "round", "block", "places"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(d.values.to_numpy()[p.values.to_numpy()].sum()) for p, d in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.float64())], names=["metric", "round", "part"])

    # A metric has as many stretches as it has rounds and blocks: few rows, each of which makes a block of draws.
    each = totals.select("metric", "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    asked = each.select("metric", "n", F.col("round").cast("long").alias("round"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("lo")).repartition("metric", "round", "lo")
    met = asked.mapInArrow(drawn, "metric string, round long, block int, places array<int>").join(blocks, ["metric", "block"])
    parts = met.select("metric", "round", "places", "ds").mapInArrow(summed, "metric string, round long, part double")
    means = parts.groupBy("metric", "round").agg(F.sum("part").alias("s")).join(totals, "metric").select("metric", "n", "total", (F.col("s") / F.col("n")).alias("m"))
    tail = (1 - confidence) / 2
    low, high = int(np.floor(tail * rounds)), min(rounds - 1, int(np.ceil((1 - tail) * rounds)))
    ends = means.groupBy("metric", F.col("n").alias("pairs"), "total").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return ends.select("metric", (F.col("total") / F.col("pairs")).alias("delta"), F.get("ms", F.lit(low)).alias("lower"), F.get("ms", F.lit(high)).alias("upper"), "pairs")


def bootstrap(current: DataFrame, baseline: DataFrame, metric: str, scope: str | None = "in_scope", rounds: int = ROUNDS, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """:func:`intervals` of one metric: one row (delta, lower, upper, pairs), or none."""
    return intervals(current, baseline, [metric], scope, rounds, confidence, seed).drop("metric")
