"""Release gate: checks over one-row metric tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

EPSILON = 1e-9


@dataclass(frozen=True)
class Thresholds:
    """The defaults of the gate."""

    recall_at1_delta: float = 0.0
    recall_at5_delta: float = 0.0
    mrr_tolerance: float = 0.01
    recall_at1_floor: float | None = 0.35
    recall_at5_floor: float | None = 0.40
    mrr_floor: float | None = 0.38
    p50_budget: float = 100.0
    p95_budget: float = 250.0
    regression_min: float = 1.0


def checks(current: DataFrame, baseline: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Rows (check, passed, actual, least) from metrics with p50, p95 and regression_rate.

    With intervals (columns ``upper_recall_at1``, ``upper_recall_at5``, ``upper_mrr``) quality
    fails only where an interval lies below zero; without them points are compared.
    """
    t = thresholds
    b = baseline.select([F.col(c).alias("b_" + c) for c in baseline.columns])
    j = current.join(F.broadcast(b))
    c = F.col

    def quality(metric: str, delta: float) -> Column:
        point = c(metric) >= c("b_" + metric) + delta - EPSILON
        if "upper_" + metric not in current.columns:
            return point
        return F.when(c("upper_" + metric).isNotNull(), c("upper_" + metric) >= 0).otherwise(point)

    floor = F.lit(True)
    for metric, least in (("recall_at1", t.recall_at1_floor), ("recall_at5", t.recall_at5_floor), ("mrr", t.mrr_floor)):
        if least is not None:
            floor = floor & (c(metric) >= least - EPSILON)
    comparable = c("cases") == c("b_cases")
    rows = (
        ("recall", comparable & quality("recall_at1", t.recall_at1_delta) & quality("recall_at5", t.recall_at5_delta), c("recall_at1")),
        ("mrr", comparable & quality("mrr", -t.mrr_tolerance), c("mrr")),
        ("floor", floor, c("recall_at1")),
        ("latency", (c("p50") <= t.p50_budget + EPSILON) & (c("p95") <= t.p95_budget + EPSILON), c("p95")),
        ("regression", c("regression_rate") >= t.regression_min - EPSILON, c("regression_rate")),
    )
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("check"), p.alias("passed"), a.cast("double").alias("actual")) for i, (n, p, a) in enumerate(rows)]))
    return j.select(made.alias("r")).select("r.*")


# The metrics of the gate and the columns of outcomes that they are means of.
INTERVALS = {"recall_at1": "hit_at1", "recall_at5": "hit_at5", "mrr": "reciprocal_rank"}


def with_intervals(current: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """``current`` (one row of metrics) with the upper ends of the paired test's intervals between two outcome tables, null where it has too few pairs; :func:`checks` judges by them."""
    found = stats.intervals(now, before, list(INTERVALS.values()))
    ends = [F.max(F.when(F.col("metric") == m, F.col("upper"))).alias("upper_" + name) for name, m in INTERVALS.items()]
    return current.join(F.broadcast(found.agg(*ends)))


def verdict(found: DataFrame, stale: str | None = None) -> DataFrame:
    """One row: stale (with its reason), pass if all checks pass, else blocked."""
    if stale is not None:
        return found.sparkSession.createDataFrame([("stale", stale)], "status string, reason string")
    return found.agg(F.when(F.bool_and("passed"), "pass").otherwise("blocked").alias("status"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",").alias("reason"))


# The budgets in milliseconds of each measured layer (p50, p95); None is recorded but not judged.
BUDGETS: dict[str, tuple[float | None, float | None]] = {"first_result": (100.0, 250.0), "semantic_local": (None, 250.0), "semantic_cloud": (None, None)}


def latency_checks(measured: DataFrame, budgets: dict[str, tuple[float | None, float | None]] = BUDGETS) -> DataFrame:
    """``measured`` (layer, p50, p95 and so on) with ``passed``: whether both are within the layer's budget; null where the layer has none."""
    passed = F.lit(None).cast("boolean")
    for layer, limits in budgets.items():
        within = [F.col(c) <= limit + EPSILON for c, limit in zip(("p50", "p95"), limits, strict=True) if limit is not None]
        if within:
            passed = F.when(F.col("layer") == layer, reduce(lambda x, y: x & y, within)).otherwise(passed)
    return measured.withColumn("passed", passed)


def disqualification(build: Column, device: Column, low_power: Column, thermal: Column, region: Column, needs_build: str = "release", needs_device: str = "physical", needs_region: str | None = None) -> Column:
    """Why a measuring environment has no say (stale, not failed), null if it has: the first reason in this order."""
    out = F.when(~build.eqNullSafe(F.lit(needs_build)), "build configuration").when(~device.eqNullSafe(F.lit(needs_device)), "device class").when(F.coalesce(low_power, F.lit(False)), "low-power mode").when(~thermal.eqNullSafe(F.lit("nominal")), "thermal state")
    return out if needs_region is None else out.when(~region.eqNullSafe(F.lit(needs_region)), "region")


def disqualified(environment: dict[str, object], build: str = "release", device: str = "physical", region: str | None = None) -> str | None:
    """:func:`disqualification` of one environment on the driver."""
    if environment.get("build_configuration") != build:
        return "build configuration"
    if environment.get("device_class") != device:
        return "device class"
    if environment.get("low_power"):
        return "low-power mode"
    if environment.get("thermal_state", "nominal") != "nominal":
        return "thermal state"
    return "region" if region is not None and environment.get("provider_region") != region else None
