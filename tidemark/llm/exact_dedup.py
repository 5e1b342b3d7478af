"""Exact dedup with a log-structured merge index.

Entries (digest, id) come in memtables.  A memtable is flushed as a run: its tasks combine
equal digests, one exchange deals them to the index's buckets, and each bucket is written sorted
by digest, with the smallest id and the number of rows of each digest.  As all runs have
the same buckets, two runs are merged by one pass over each bucket, without exchange or sort.
Runs are merged whenever the one before is less than twice as large, so their sizes at least double from the
newest to the oldest, there are few of them, and a small batch doesn't rewrite a large run.
Each run has a filter, an array of bits sized by its entries.  A lookup asks all filters first,
so that most digests that the index doesn't hold never leave their task, and then all runs.
A digest that occurs more than once is only a hit: its texts are compared byte for byte before any
row is dropped, so two texts that share a digest stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, SPACE, cut, fresh, if_small, join_hot, parallelism, session_dir, table

#: Memtables that one table is dealt to.
MEMTABLES = 4
#: Bits of a filter for each entry: about one in eleven of other digests passes.
ENTRY_BITS = 10
#: A filter comes in slices of so many bits (128 KB), at most so many of them (64 MB, as each task holds all); a fuller one lets more digests through, never fewer.
SLICE_BITS, MAX_SLICES = 1 << 20, 512


def normalised(text: Column) -> Column:
    """Each run of white space becomes one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@dataclass
class Filter:
    """Bits on hashes of digests: ``rows`` (slice, bits), an array of ``SLICE_BITS / 64`` words for each slice."""

    rows: DataFrame
    slices: int

    @classmethod
    def of(cls, digests: DataFrame, entries: int) -> Filter:
        """The filter of ``digests``, sized for so many ``entries``."""
        slices = 1
        while slices < MAX_SLICES and slices * SLICE_BITS < ENTRY_BITS * entries:
            slices *= 2
        one = cls(digests, slices)
        at, words = one._place(F.col("digest")), SLICE_BITS // 64
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        found = digests.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("b"))
        every = digests.sparkSession.range(slices * words).select(F.col("id").alias("word")).join(found, "word", "left")
        ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
        one.rows = table(every.groupBy(F.floor(F.col("word") / words).cast("int").alias("slice")).agg(F.transform(ordered, lambda x: x["b"]).alias("bits")))
        return one

    def _place(self, digest: Column) -> Column:
        return F.xxhash64(digest).bitwiseAND(F.lit(self.slices * SLICE_BITS - 1))

    def passing(self, df: DataFrame, digest: str = "digest") -> DataFrame:
        """The rows of ``df`` whose digest the filter may hold; of those left out it holds none."""
        slice, bits = fresh(df, "slice", "bits")
        at = self._place(F.col(digest))
        word = F.get(F.col(bits), F.shiftright(at % SLICE_BITS, 6).cast("int"))
        held = F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        rows = F.broadcast(self.rows.select(F.col("slice").alias(slice), F.col("bits").alias(bits)))
        return df.join(rows, F.floor(at / SLICE_BITS).cast("int") == F.col(slice)).filter(held).select(*df.columns)


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Scans of tables whose buckets are one sorted file each count as sorted, while a merge is planned and run."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Run:
    """Sorted rows (digest, keep, n) in buckets by digest, and their filter."""

    def __init__(self, name: str, rows: DataFrame, entries: int):
        self.name, self.rows, self.entries = name, rows, entries
        self._filter: Filter | None = None

    @property
    def filter(self) -> Filter:
        """Made when a lookup first asks for it."""
        if self._filter is None:
            self._filter = Filter.of(self.rows.select("digest"), self.entries)
        return self._filter


class MergeIndex:
    """Digest index in a shared folder: ``flush`` adds a run, ``compact`` merges all, ``lookup`` asks for digests.

    ``runs`` are its runs, oldest and largest first; ``written`` counts the entries written so far.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{session_dir(spark)}/index-{uuid.uuid4().hex}"
        self.buckets = parallelism(spark)
        self.runs: list[Run] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> Run:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{name}").saveAsTable(name)
        stored = self.spark.table(name)
        run = Run(name, stored, stored.count())
        self.written += run.entries
        return run

    def flush(self, entries: DataFrame) -> None:
        """Adds the memtable ``entries`` (id, digest) as one run, and merges runs of like size."""
        run = self._write(entries.groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("n")))
        if not run.entries:
            self._forget(run)
            return
        self.runs.append(run)
        while len(self.runs) > 1 and self.runs[-2].entries < 2 * self.runs[-1].entries:
            self._merge_last()

    @staticmethod
    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        """Two runs as one: of each digest the smallest id and the number of rows."""
        a, b = old.alias("a"), new.alias("b")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        return a.join(b.hint("merge"), F.col("a.digest") == F.col("b.digest"), "full").select(F.coalesce("a.digest", "b.digest").alias("digest"), F.least("a.keep", "b.keep").alias("keep"), n.cast("long").alias("n"))

    def _merge_last(self) -> None:
        old, new = self.runs[-2:]
        with _sorted_scans(self.spark):
            run = self._write(self.merged(old.rows, new.rows))
        self.runs[-2:] = [run]
        self._forget(old), self._forget(new)

    def _forget(self, run: Run) -> None:
        """Takes a run out of the catalog; its files go with the session's folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")

    def compact(self) -> DataFrame:
        """Merges all runs into one, from the newest on; its rows (digest, keep, n)."""
        while len(self.runs) > 1:
            self._merge_last()
        return self.runs[0].rows if self.runs else self.spark.createDataFrame([], "digest binary, keep long, n long")

    def lookup(self, entries: DataFrame) -> DataFrame:
        """Rows (id, digest, keep, n) of those ``entries`` (id, digest) whose digest any run holds.

        All filters go to all tasks; only what passes one is held against the runs, each digest once.
        """
        entries = entries.select("id", "digest")
        if not self.runs:
            return entries.select("id", "digest", F.lit(None).cast("long").alias("keep"), F.lit(None).cast("long").alias("n")).limit(0)
        often = table(entries.groupBy("digest").agg(F.count("*").alias("times")))
        found = [run.filter.passing(often).join(run.rows, "digest") for run in self.runs]
        side = reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"), F.max("times").alias("times"))
        return join_hot(entries, cut(side), ["digest"], F.col("times") > HOT_ROWS).select("id", "digest", "keep", "n")


def _memtables(entries: DataFrame) -> DataFrame:
    """Writes ``entries`` into the session's folder, each task's into one of ``MEMTABLES`` folders, and reads them back with a column ``memtable``."""
    spark = entries.sparkSession
    path = f"{session_dir(spark)}/entries-{uuid.uuid4().hex}"
    dealt = entries.withColumn("memtable", F.spark_partition_id() % MEMTABLES)
    dealt.write.partitionBy("memtable").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def exact_groups(df: DataFrame, text: str = "text", id: str = "doc_id", digest: Callable[[Column], Column] = sha256, index: MergeIndex | None = None) -> DataFrame:
    """One row (id, digest, keep_id, group_size) for each row of ``df``.

    A null text is empty.  Rows with a null id are grouped like any other;
    ``keep_id`` is the smallest id that is not null, or null where a group has
    none.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    index = index or MergeIndex(spark)
    base = df.select(F.col(id).alias("id"), normalised(F.col(text)).alias("norm"))
    hashed = base.withColumn("digest", digest(F.col("norm")))
    entries = _memtables(hashed.select("id", "digest"))
    for i in range(MEMTABLES):
        index.flush(entries.filter(F.col("memtable") == i).select("id", "digest"))
    entries = entries.select("id", "digest")
    hits = index.compact().filter("n > 1").select("digest")

    # The texts of hits, and of the few others that pass the filter on hits, are read again.
    passed = Filter.of(hits, hits.count()).passing(hashed)
    # Grouping by the text itself compares all bytes; copies combine before the exchange.
    checked = passed.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    by_digest = cut(checked.groupBy("digest").agg(F.count("*").alias("variants"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).filter("group_size > 1"))

    out = join_hot(entries, by_digest, ["digest"], F.col("group_size") > HOT_ROWS, "left")
    plain = out.filter("variants is null or variants = 1").select(
        "id", "digest", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    )
    clash = by_digest.filter("variants > 1").select("digest")
    if clash.isEmpty():
        return plain
    apart = passed.join(if_small(clash), "digest", "left_semi")
    groups = apart.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return plain.unionByName(apart.join(groups, ["digest", "norm"]).select("id", "digest", "keep_id", "group_size"))


def drop_copies(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay: the smallest id of each group of equal texts.

    Rows whose id is null stay only if their group has no other id; of rows that
    repeat both id and text, one stays.  All columns are kept.
    """
    digest, gone_id, gone_digest = fresh(df, "digest", "gone_id", "gone_digest")
    groups = cut(exact_groups(df, text, id))
    gone = groups.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct()
    again = groups.filter(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1)).groupBy("id", "digest").count().filter("count > 1")
    hashed = df.withColumn(digest, sha256(normalised(F.col(text))))
    kept = hashed.join(if_small(gone), (F.col(digest) == F.col(gone_digest)) & F.col(id).eqNullSafe(F.col(gone_id)), "left_anti")
    if not again.isEmpty():
        kept = kept.dropDuplicates([id, digest])
    return kept.select(*df.columns)
