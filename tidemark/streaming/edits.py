"""Edits as a stream: debounce, incremental plans, deduplicated jobs, guarded writes, last traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators import derive
from ..operators.present import PATIENCE

DEBOUNCE = "600 milliseconds"


def debounce(edits: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds", per_note: bool = True) -> DataFrame:
    """Bursts of edits (note_id, ts), each ended by ``gap`` without one: by note, or of all notes together as one burst of notes.

    The watermark bounds the state; later edits than ``late`` are dropped by Spark.
    """
    marked = edits.withWatermark("ts", late) if edits.isStreaming else edits
    key = ["note_id"] if per_note else []
    burst = marked.groupBy(*key, F.session_window("ts", gap).alias("burst"))
    what = [F.count("*").alias("edits")] if per_note else [F.count("*").alias("edits"), F.array_sort(F.collect_set("note_id")).alias("notes")]
    return burst.agg(*what).select(*key, F.col("burst.start").alias("started"), F.col("burst.end").alias("flushed"), *[F.col(c) for c in (["edits"] if per_note else ["edits", "notes"])])


def deduplicate(jobs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One job for each key while it may be in flight: note, block, chunk, content and version together."""
    key = ["note_id", "block_id", "chunk_index", "content_hash", "embedding_version"]
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if jobs.isStreaming else jobs.dropDuplicates(key)


# The events that end a job; a submission of the same key is a new job only after one.
ENDS = ("succeeded", "failed", "cancelled")


class InFlight(StatefulProcessor):
    """Tells submissions that start a job from those that join the one in flight, which lasts until it has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted((at, n, event) for part in rows for at, n, event in zip(part["at"].tolist(), part["n"].tolist(), part["event"].tolist(), strict=True))
        running = self.started.get()[0] if self.started.exists() else None
        out = []
        for at, n, event in events:
            if event == "submitted":
                out.append((key[0], at, n, running is not None, at if running is None else running))
                running = at if running is None else running
            elif event in ENDS:
                running = None
        if running is None:
            self.started.clear()
        else:
            self.started.update((running,))
        yield pd.DataFrame(out, columns=["job_key", "at", "n", "deduplicated", "started"])

    def close(self) -> None:
        pass


def in_flight(log: DataFrame) -> DataFrame:
    """Rows (job_key, at, n, deduplicated, started), one for each submission in a job log (job_key, at, n, event); ``started`` is when its job began.

    A key is free again once its job has succeeded, failed or been cancelled; other events change
    nothing.  Events of a key are taken in order of ``at`` and ``n``; a stream keeps
    one number for each key in flight, and expects later batches to hold later events.
    """
    some = log.select("job_key", "at", "n", "event").filter(F.col("event").isin("submitted", *ENDS))
    if log.isStreaming:
        return some.groupBy("job_key").transformWithStateInPandas(InFlight(), "job_key string, at long, n long, deduplicated boolean, started long", "Append", "None")
    order = Window.partitionBy("job_key").orderBy("at", "n")
    # A job is in flight exactly if the event before was a submission, whether it began one or joined one.
    marked = some.withColumn("deduplicated", (F.col("event") == "submitted") & F.coalesce(F.lag("event").over(order) == "submitted", F.lit(False)))
    began = F.last(F.when((F.col("event") == "submitted") & ~F.col("deduplicated"), F.col("at")), ignorenulls=True).over(order)
    return marked.withColumn("started", began).filter("event = 'submitted'").select("job_key", "at", "n", "deduplicated", "started")


#: What a list that nobody has looked at for so long is kept, in milliseconds.
FORGOTTEN = 600_000


class TwoStage(StatefulProcessor):
    """The list of a search: keyword rows first; hybrid rows replace it while it is fresh, and are appended once it has been seen."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getListState("shown", "note_id string, appended boolean")
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived: dict[tuple, list] = {}
        for part in rows:
            for at, stage, rank, note in zip(part["at"].tolist(), part["stage"].tolist(), part["rank"].tolist(), part["note_id"].tolist(), strict=True):
                arrived.setdefault((at, stage != "keyword", stage), []).append((rank, note))
        shown = [tuple(r) for r in self.shown.get()] if self.shown.exists() else []
        since = self.since.get()[0] if self.since.exists() else None
        for (at, _, stage), found in sorted(arrived.items()):
            notes = [note for _, note in sorted(found)]
            if stage == "keyword":
                shown, since = [(n, False) for n in notes], at
            elif since is not None and at - since > self.patience:
                have = {n for n, _ in shown}
                shown += [(n, True) for n in notes if n not in have]
            else:
                shown = [(n, False) for n in notes]
        self.shown.put(shown)
        if since is not None:
            self.since.update((since,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + FORGOTTEN)
        yield pd.DataFrame([(key[0], i, n, a) for i, (n, a) in enumerate(shown, 1)], columns=["search_id", "place", "note_id", "appended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.shown.clear()
        self.since.clear()
        yield pd.DataFrame({"search_id": pd.Series([], dtype=str), "place": pd.Series([], dtype="int32"), "note_id": pd.Series([], dtype=str), "appended": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def two_stage(stages: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Streaming lists (search_id, place, note_id, appended) of searches, whole whenever one changes; ``stages``: search_id, stage (keyword or hybrid), at (milliseconds), rank, note_id.

    The rules are those of :func:`present.two_stage`.  A list is forgotten some minutes after its last change.
    """
    rows = stages.select("search_id", "stage", "at", "rank", "note_id")
    return rows.groupBy("search_id").transformWithStateInPandas(TwoStage(patience), "search_id string, place int, note_id string, appended boolean", "Update", "ProcessingTime")


def maintain(edited: DataFrame, current: Callable[[DataFrame], DataFrame], stored: Callable[[], DataFrame], delete: Callable[[DataFrame], None], embed: Callable[[DataFrame], DataFrame], commit: Callable[[DataFrame], None], version: str, checkpoint: str) -> StreamingQuery:
    """Keeps a store in step with a stream of edited note ids.

    For each batch: plan, delete orphans first, embed what is pending, hold the results
    against the notes as they are then, and write only what is accepted.  A batch that
    runs again plans again and finds the work done.
    """

    def step(batch: DataFrame, _: int) -> None:
        notes = batch.select("note_id").distinct()
        chunks = current(notes)
        mine = stored().join(notes, "note_id", "left_semi")
        plan = derive.work_plan(chunks, mine, version).cache()
        try:
            delete(plan.filter("state = 'orphan'").select("chunk_id"))
            pending = chunks.join(plan.filter("state = 'pending'").select("chunk_id"), "chunk_id", "left_semi")
            results = embed(pending).withColumn("embedding_version", F.lit(version))
            now = current(notes).select("note_id", "block_id", F.col("content_hash").alias("current_hash"), F.lit(version).alias("current_version")).dropDuplicates(["note_id", "block_id"])
            commit(derive.guard(results, now).filter("decision = 'accept'").drop("decision", "note_exists", "current_hash", "current_version"))
        finally:
            plan.unpersist()

    return edited.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LastN(StatefulProcessor):
    """The last ``n`` traces of each key, newest first; emits them whenever some arrive."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at long, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have = list(self.kept.get()) if self.kept.exists() else []
        for part in rows:
            have += list(zip(part["at"].tolist(), part["payload"].tolist(), strict=True))
            have = sorted(have, key=lambda x: (-x[0], x[1]))[: self.n]
        self.kept.put(have)
        yield pd.DataFrame({"key": [key[0]] * len(have), "place": range(1, len(have) + 1), "at": [x[0] for x in have], "payload": [x[1] for x in have]})

    def close(self) -> None:
        pass


def last_traces(traces: DataFrame, n: int = 20) -> DataFrame:
    """Streaming :class:`LastN` over traces (key, at, payload)."""
    return traces.groupBy("key").transformWithStateInPandas(LastN(n), "key string, place int, at long, payload string", "Update", "None")


def last_traces_by_batch(traces: DataFrame, n: int = 20) -> DataFrame:
    """The same over a table: (key, place, at, payload)."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), "payload"))
    return traces.select("key", place.alias("place"), "at", "payload").filter(F.col("place") <= n)


class RateLimitedError(Exception):
    """A service asks to come back later."""


#: What is worth another try: the way to the service failed, or it was too busy.  Anything else fails at once.
RETRYABLE = (ConnectionError, TimeoutError, RateLimitedError)
#: Tries, first wait in seconds, and how many tasks call a service at once.
ATTEMPTS, WAIT, RUNNING = 3, 0.2, 2


def run_jobs(jobs: DataFrame, work: Callable[[list[str]], list[list[float] | None]], attempts: int = ATTEMPTS, wait: float = WAIT, size: int = 64, running: int | None = RUNNING) -> DataFrame:
    """Rows (chunk_id, vector, tries, error): texts in batches of ``size``, tried again after doubling waits where ``work`` raises one of ``RETRYABLE``.

    Other errors fail the batch's rows at once; failed rows have no vector and the error's name.
    At most ``running`` tasks call the service at once; None leaves that to the cluster.
    """
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.iloc[lo : lo + size]
                out: list[list[float] | None] = [None] * len(part)
                tried, error = 0, None
                for tried in range(1, attempts + 1):
                    try:
                        out, error = work(part["text"].tolist()), None
                        break
                    except RETRYABLE as e:
                        error = type(e).__name__
                        if tried < attempts:
                            time.sleep(wait * 2 ** (tried - 1))
                    except Exception as e:
                        error = type(e).__name__
                        break
                yield pd.DataFrame({"chunk_id": part["chunk_id"].tolist(), "vector": out, "tries": tried, "error": error})

    some = jobs.select("chunk_id", "text")
    return (some if running is None else some.repartition(running)).mapInPandas(run, "chunk_id string, vector array<double>, tries int, error string")
