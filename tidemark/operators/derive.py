"""Derived data kept in step with notes: work plans, stale-write decisions, consistency, index states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_han, has_latin

#: Units of time in a slice of a job log.
SLICE = 3600


def work_plan(chunks: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Rows (chunk_id, state): pending, up_to_date or orphan.

    ``chunks``: chunk_id, content_hash, strategy; ``stored``: chunk_id, content_hash,
    embedding_version, chunk_strategy.
    """
    s = stored.select("chunk_id", F.col("content_hash").alias("had"), "embedding_version", "chunk_strategy")
    c = chunks.select("chunk_id", "content_hash", "strategy")
    same = (F.col("had") == F.col("content_hash")) & (F.col("embedding_version") == version) & (F.col("chunk_strategy") == F.col("strategy"))
    state = F.when(F.col("content_hash").isNull(), "orphan").when(same, "up_to_date").otherwise("pending")
    return c.join(s, "chunk_id", "full").select("chunk_id", state.alias("state"))


def stale_decision(note_exists: Column, current_hash: Column, result_version: Column, current_version: Column, result_hash: Column) -> Column:
    """Whether a late result may be written; the first reason against it in this order."""
    return (
        F.when(~F.coalesce(note_exists, F.lit(False)), "note_deleted")
        .when(current_hash.isNull(), "block_deleted")
        .when(~result_version.eqNullSafe(current_version), "version_changed")
        .when(~result_hash.eqNullSafe(current_hash), "content_changed")
        .otherwise("accept")
    )


def guard(results: DataFrame, current: DataFrame) -> DataFrame:
    """``results`` (chunk_id, note_id, block_id, content_hash, embedding_version) with ``decision``, by ``current`` (note_id, block_id, current_hash, current_version)."""
    notes = current.select("note_id", F.lit(True).alias("note_exists"), "current_version").dropDuplicates(["note_id"])
    blocks = current.select("note_id", "block_id", "current_hash")
    decision = stale_decision(F.col("note_exists"), F.col("current_hash"), F.col("embedding_version"), F.col("current_version"), F.col("content_hash"))
    return results.join(notes, "note_id", "left").join(blocks, ["note_id", "block_id"], "left").withColumn("decision", decision)


def orphans(live: DataFrame, **derived: DataFrame) -> DataFrame:
    """Rows (note_id, origin): ids of derived tables that no note has."""
    out = None
    for origin, df in sorted(derived.items()):
        part = df.select("note_id").distinct().join(live.select("note_id"), "note_id", "left_anti").withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part)
    return out


def consistency(live: DataFrame, found: DataFrame) -> DataFrame:
    """One row: live notes, orphans, whether all is consistent, and whether it is safe to delete (never for an empty library)."""
    n = live.select("note_id").distinct().agg(F.count("*").alias("live_notes"))
    o = found.select("note_id").distinct().agg(F.count("*").alias("orphan_notes"))
    return n.join(F.broadcast(o)).select("*", (F.col("orphan_notes") == 0).alias("is_consistent"), (~((F.col("live_notes") == 0) & (F.col("orphan_notes") > 0))).alias("is_safe"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "created_at") -> DataFrame:
    """Stored and new rows, the latest of each key."""
    from pyspark.sql.window import Window

    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_n", latest).filter("_n = 1").drop("_n", "_new")


def remove(stored: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    return stored.join(gone.select(by).distinct(), by, "left_anti")


def cascade(gone: DataFrame, **derived: DataFrame) -> dict[str, DataFrame]:
    """What stays of each derived table (chunks, recognised text, index and so on) once the notes ``gone`` (note_id) are deleted."""
    return {name: remove(df, gone, "note_id") for name, df in derived.items()}


def start(load: Callable[[], DataFrame], live: DataFrame, delete: Callable[[DataFrame], None], scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The plan at startup: load what is stored, remove what belongs to no note (if that is safe), then scan what is left.

    Scanning first would take what is merely not loaded for pending work.
    """
    stored = load()
    lost = orphans(live, embeddings=stored)
    if consistency(live, lost).first().is_safe:
        delete(lost.select("note_id"))
        stored = load()
    return scan(stored)


def bring_up(chunks: DataFrame, load: Callable[[], DataFrame], delete: Callable[[DataFrame], None], embed: Callable[[DataFrame], DataFrame], commit: Callable[[DataFrame], None], version: str, clear: Callable[[], None] | None = None) -> None:
    """Indexes the whole library anew after a change: of the chunk strategy, or, with ``clear``, of the provider.

    Records of another provider's version are no use, so they all go first.  Records of another
    strategy have ids that no chunk has now: they are orphans of the plan, which are deleted
    before anything is embedded, so the store never holds both.
    """
    if clear is not None:
        clear()
    plan = work_plan(chunks, load(), version)
    delete(plan.filter("state = 'orphan'").select("chunk_id"))
    pending = chunks.join(plan.filter("state = 'pending'").select("chunk_id"), "chunk_id", "left_semi")
    commit(embed(pending).withColumn("embedding_version", F.lit(version)))


def state_totals(plans: DataFrame, running: DataFrame) -> DataFrame:
    """One row (total, pending, running) over the work plans (note_id, state) of all notes and the running jobs."""
    live = plans.filter("state <> 'orphan'")
    one = live.agg(F.count("*").alias("total"), F.count(F.when(F.col("state") == "pending", 1)).alias("pending"))
    return one.join(F.broadcast(running.agg(F.count("*").alias("running"))))


def script_flags(notes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (note_id, has_han, has_latin) over titles (the user's and the model's, not a placeholder), tags and all texts, recognised ones too.

    ``notes``: note_id, user_title, ai_title, tags; ``texts``: note_id, text.  A ``bool_or`` over the rows speaks for the corpus.
    """
    own = notes.select("note_id", F.explode(F.concat(F.array("user_title", "ai_title"), F.coalesce("tags", F.array().cast("array<string>")))).alias("text"))
    return own.unionByName(texts.select("note_id", "text")).groupBy("note_id").agg(F.bool_or(has_han(F.col("text"))).alias("has_han"), F.bool_or(has_latin(F.col("text"))).alias("has_latin"))


def provider(route: Column, local_ready: Column, cloud_ready: Column) -> Column:
    """The provider of a route, null where there is none: consent that is missing, or a service or model that isn't there."""
    return F.when(route.isin("local_chinese", "local_english") & local_ready, route).when((route == "cloud") & cloud_ready, "cloud")


def write_context(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (note_id, block_id, note_exists, current_hash) for blocks (note_id, block_id, text, content_hash); no hash without text."""
    known = notes.select("note_id", F.lit(True).alias("note_exists"))
    return blocks.join(known, "note_id", "left").select("note_id", "block_id", F.coalesce("note_exists", F.lit(False)).alias("note_exists"), F.when(F.coalesce("text", F.lit("")) != "", F.col("content_hash")).alias("current_hash"))


def index_state(total: Column, pending: Column, running: Column, has_embeddings: Column, failure: Column) -> Column:
    """struct(state, progress)."""
    of = lambda s, p=None: F.struct(F.lit(s).alias("state"), (F.lit(None).cast("double") if p is None else p).alias("progress"))
    done = F.when(total > 0, F.greatest(F.lit(0), total - pending) / total).otherwise(F.lit(0.0))
    return (
        F.when(failure.isNotNull() & (pending > 0), of("failed"))
        .when(pending == 0, of("ready"))
        .when(~has_embeddings, of("building", done.cast("double")))
        .when(running > 0, of("rebuilding"))
        .otherwise(of("stale"))
    )


def allows_vector(state: Column) -> Column:
    return state.isin("ready", "rebuilding", "stale")


def capability(state: Column, provider: Column, in_production: Column, offline: Column) -> Column:
    return (
        F.when(~in_production, "full").when(offline, "offline").when(~provider, "semantic_unavailable")
        .when(state == "ready", "full").when(state == "building", "index_building").when(state.isin("rebuilding", "stale"), "index_rebuilding").otherwise("semantic_unavailable")
    )


def embed_route(has_han: Column, chinese: Column, english: Column, cloud: Column, consent: Column) -> Column:
    local = F.when(has_han & chinese, "local_chinese").when(~has_han & english, "local_english")
    return F.when(cloud & consent, "cloud").otherwise(F.coalesce(local, F.when(cloud, "cloud_needs_consent").otherwise("unavailable")))


def offer_upgrade(route: Column, cloud: Column, consent: Column, has_han: Column, has_latin: Column, in_production: Column) -> Column:
    return in_production & cloud & ~consent & has_han & has_latin & route.isin("local_chinese", "local_english")


def skip_semantic(route: Column, query_has_han: Column) -> Column:
    return (route == "local_english") & query_has_han


def error_class(status: Column) -> Column:
    """HTTP statuses and what they mean for a retry; null for success."""
    return F.when(status.between(200, 299), None).when(status == 429, "rate_limited").when(status.between(400, 499), "rejected").otherwise("transport")


def retryable(error: Column) -> Column:
    return error.isin("rate_limited", "transport")


def allows_keyword(state: Column) -> Column:
    return F.lit(True)


def job_statistics(log: DataFrame) -> DataFrame:
    """One row of counts over a job log (at, job_key, event): submitted, deduplicated, attempts, succeeded, failed, cancelled, retried, and how many ran at most at once.

    A job runs from its first attempt until it has succeeded, failed or been cancelled.  The
    running number is cumulated within time slices and slices over the log, not in one task.
    """
    from pyspark.sql.window import Window

    names = ("submitted", "deduplicated", "attempt", "succeeded", "failed", "cancelled", "retried")
    counts = log.agg(*[F.count(F.when(F.col("event") == n, 1)).alias(n) for n in names])
    began = log.filter("event = 'attempt'").groupBy("job_key").agg(F.min("at").alias("at")).select("at", F.lit(1).alias("step"))
    ended = log.filter(F.col("event").isin("succeeded", "failed", "cancelled")).groupBy("job_key").agg(F.max("at").alias("at")).join(log.filter("event = 'attempt'").select("job_key").distinct(), "job_key", "left_semi").select("at", F.lit(-1).alias("step"))
    steps = began.unionByName(ended).groupBy("at").agg(F.sum("step").alias("step")).withColumn("slice", F.floor(F.col("at") / SLICE))
    slices = steps.groupBy("slice").agg(F.sum("step").alias("net"))
    base = slices.select("slice", F.coalesce(F.sum("net").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    peak = steps.join(base, "slice").select((F.col("base") + F.sum("step").over(Window.partitionBy("slice").orderBy("at"))).alias("running")).agg(F.coalesce(F.max("running"), F.lit(0)).alias("peak"))
    return counts.join(F.broadcast(peak))
