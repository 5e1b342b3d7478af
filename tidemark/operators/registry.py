"""Retrieval configurations and their roles, as a log of what was asked for and an ordered fold over it.

One configuration is in production, one at most is the candidate, all others are
drafts.  A promotion needs a pass of the gate for that very version.  The log is
append-only; roles, refusals and the history of promotions are read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..sources.deltas import DeltaTable

#: Events (create, nominate, promote, migrate, remove): ``config`` of a created or migrated record, the version and outcome that a promotion's verdict is about.
LOG = "registry string, seq long, kind string, version string, parent string, config string, verdict_version string, verdict_pass boolean"
_STATE = "struct<production:string,candidate:string,configs:map<string,string>,promoted:map<string,bigint>,error:string>"


def log_table(spark: SparkSession, path: str) -> DeltaTable:
    """The log as stored data: each ``write`` of events is a commit; an event is known by its registry and number."""
    return DeltaTable(spark, path, t.StructType.fromDDL("event_id string, " + LOG), "event_id", order="registry")


def append(log: DeltaTable, events: DataFrame) -> None:
    log.write(events.withColumn("event_id", F.concat_ws("/", "registry", F.col("seq").cast("string"))))


def _refusal(s: Column, e: Column) -> Column:
    """Why an event changes nothing; null if it does."""
    known = F.map_contains_key(s["configs"], F.coalesce(e["version"], F.lit("")))
    parent = F.map_contains_key(s["configs"], F.coalesce(e["parent"], F.lit("")))
    is_candidate, is_production = e["version"].eqNullSafe(s["candidate"]), e["version"].eqNullSafe(s["production"])
    return (
        F.when(e["kind"] == "create", F.when(~parent, "unknown_record").when(known | e["version"].isNull(), "version_exists"))
        .when(e["kind"] == "migrate", F.when(F.map_contains_key(s["promoted"], s["production"]), "was_promoted").when(F.element_at(s["configs"], s["production"]).eqNullSafe(e["config"]), "no_change"))
        .when(~known, "unknown_record")
        .when(e["kind"] == "nominate", F.when(is_production, "cannot_edit_production"))
        .when(
            e["kind"] == "promote",
            F.when(~is_candidate, "not_promotable").when(~e["verdict_version"].eqNullSafe(e["version"]), "verdict_for_another").when(~F.coalesce(e["verdict_pass"], F.lit(False)), "blocked_by_gate"),
        )
        .when(e["kind"] == "remove", F.when(is_candidate | is_production, "cannot_edit_production"))
        .otherwise("unknown_event")
    )


def _step(s: Column, e: Column) -> Column:
    error = _refusal(s, e)
    does = lambda kind: error.isNull() & (e["kind"] == kind)
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))
    candidate = F.when(does("nominate"), e["version"]).when(does("promote"), F.lit(None)).otherwise(s["candidate"])
    configs = (
        F.when(does("create"), put(s["configs"], e["version"], F.coalesce(e["config"], F.element_at(s["configs"], e["parent"]))))
        .when(does("migrate"), put(s["configs"], s["production"], e["config"]))
        .when(does("remove"), F.map_filter(s["configs"], lambda k, _: k != e["version"]))
        .otherwise(s["configs"])
    )
    promoted = F.when(does("promote"), put(s["promoted"], e["version"], e["seq"])).when(does("remove"), F.map_filter(s["promoted"], lambda k, _: k != e["version"])).otherwise(s["promoted"])
    return F.struct(F.when(does("promote"), e["version"]).otherwise(s["production"]).alias("production"), candidate.alias("candidate"), configs.alias("configs"), promoted.alias("promoted"), error.alias("error")).cast(_STATE)


def states(events: DataFrame, root: str, config: str) -> DataFrame:
    """Rows (registry, seq, kind, version, production, candidate, configs, promoted, error): every registry after each of its events, in order of ``seq``.

    A registry starts with ``root`` in production, never promoted.  Refused events change
    nothing and say why in ``error``.  A registry's events are what people did to it, so one
    row holds them; registries are folded side by side.
    """
    fields = [f.name for f in t.StructType.fromDDL(LOG) if f.name != "registry"]
    logs = events.groupBy("registry").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("log"))
    first = F.struct(F.lit(root).alias("production"), F.lit(None).cast("string").alias("candidate"), F.create_map(F.lit(root), F.lit(config)).alias("configs"), F.create_map().alias("promoted"), F.lit(None).cast("string").alias("error")).cast(_STATE)
    none = F.array().cast(f"array<{_STATE}>")

    def put(done: Column, e: Column) -> Column:
        return F.concat(done, F.array(_step(F.coalesce(F.try_element_at(done, F.lit(-1)), first), e)))

    folded = logs.select("registry", F.explode(F.arrays_zip("log", F.aggregate("log", none, put).alias("after"))).alias("x"))
    return folded.select("registry", "x.log.seq", "x.log.kind", "x.log.version", "x.after.*")


def history(after: DataFrame) -> DataFrame:
    """Rows (registry, version, promoted_at, is_production): the records of the last state that were ever promoted, latest first within a registry."""
    last = after.groupBy("registry").agg(F.max_by(F.struct("production", "promoted"), "seq").alias("s"))
    rows = last.select("registry", "s.production", F.explode("s.promoted").alias("version", "promoted_at"))
    return rows.select("registry", "version", "promoted_at", (F.col("version") == F.col("production")).alias("is_production"))
