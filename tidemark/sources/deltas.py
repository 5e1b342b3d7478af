"""A keyed table as Parquet folders that are only ever added to, and a log that says which of them count.

A write adds one folder of rows and one of tombstones, in proportion to what is
written, and then one log entry, whose appearance is the commit: a driver that
dies before it leaves folders that nobody reads.  A reader takes the newest entry
and merges on read: rows of the base that were written again or deleted are left
out by anti joins with the small deltas, so the base is not exchanged.  Deltas of
like size are merged, and all of them go into a new base once they are half as
large as it, so a row is rewritten a few times in its life, whatever the size.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

SEQ = "_seq"
_DEAD = "by string, value string, _seq long"
#: So many deltas of like size are merged into one.
MERGED = 4
#: Rows of a file of the base.
FILE_ROWS = 1_000_000


class ConflictError(Exception):
    """Another writer has committed in the meantime."""


class DeltaTable:
    """Rows of ``schema``, one for each ``key``; they are deleted by their key or by another column of ``deleted_by``.

    ``order`` sorts the files, so that a filter on it skips most of them; ``partition`` parts
    them.  Columns of ``deleted_by`` are compared as strings.  One writer at a time: where two
    commit at once the later one raises.  Entries of the log stay readable by their number.
    """

    def __init__(self, spark: SparkSession, path: str, schema: t.StructType, key: str = "chunk_id", deleted_by: Iterable[str] = (), order: str | None = None, partition: str | None = None, files: int | None = None):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.deleted_by, self.order, self.partition, self.files = (key, *(c for c in deleted_by if c != key)), order or key, partition, files
        fields = [f for f in schema if f.name != partition] + [t.StructField(SEQ, t.LongType())] + [f for f in schema if f.name == partition]
        self._stored = t.StructType([t.StructField(f.name, f.dataType) for f in fields])
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # The log

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:012}.json"

    def versions(self) -> list[int]:
        """Numbers of the entries that can be read."""
        folder = self._hadoop.Path(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def entry(self, version: int | None = None) -> dict:
        """What the log says at a version, the newest one by default: base, deltas and notes of the writer."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "base": None, "deltas": [], "notes": {}}
        stream = self._fs.open(self._hadoop.Path(self._log(version)))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> dict:
        """Puts the entry in place by a rename, which is all or nothing."""
        to, temporary = self._hadoop.Path(self._log(entry["version"])), self._hadoop.Path(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(temporary, to):
            self._fs.delete(temporary, False)
            raise ConflictError(f"version {entry['version']} of {self.path} is there already")
        return entry

    # Reading

    def _rows_at(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._stored)
        read, paths = self.spark.read.schema(self._stored), [f"{self.path}/{f}" for f in folders]
        return reduce(DataFrame.unionByName, [read.parquet(p) for p in paths]) if self.partition else read.parquet(*paths)

    def _dead_at(self, deltas: list[dict]) -> DataFrame:
        """Rows (by, value, _seq): the latest tombstone of each value."""
        folders = [f"{self.path}/{d['dead']}" for d in deltas if d["dead"]]
        dead = self.spark.read.schema(_DEAD).parquet(*folders) if folders else self.spark.createDataFrame([], _DEAD)
        return dead.groupBy("by", "value").agg(F.max(SEQ).alias(SEQ))

    def _alive(self, rows: DataFrame, deltas: list[dict]) -> DataFrame:
        """``rows`` of deltas with ``_alive``: whether nothing later was said of their key or of what they were deleted by."""
        latest = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(SEQ))) == 1
        out = rows.withColumn("_alive", latest)
        dead = self._dead_at(deltas)
        for by in sorted({b for d in deltas for b in d["by"]}):
            said = dead.filter(F.col("by") == by).select(F.col("value").alias("_value"), F.col(SEQ).alias("_dead"))
            out = out.join(said, F.col(by).cast("string") == F.col("_value"), "left").withColumn("_alive", F.col("_alive") & (F.col("_dead").isNull() | (F.col(SEQ) > F.col("_dead")))).drop("_value", "_dead")
        return out

    def load(self, version: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """The rows at a version of the log, by default now."""
        entry = self.entry(version)
        columns = [*self.schema.names, *keep]
        base, deltas = entry["base"], entry["deltas"]
        rows = self._rows_at([base["rows"]] if base else [])
        if not deltas:
            return rows.select(columns)
        new = self._rows_at([d["rows"] for d in deltas if d["rows"]])
        rows = rows.join(new.select(self.key), self.key, "left_anti")
        dead = self._dead_at(deltas)
        for by in sorted({b for d in deltas for b in d["by"]}):
            rows = rows.join(dead.filter(F.col("by") == by).select(F.col("value").alias("_value")), F.col(by).cast("string") == F.col("_value"), "left_anti")
        return rows.select(columns).unionByName(self._alive(new, deltas).filter("_alive").select(columns))

    # Writing

    def companions(self, folder: str) -> list[str]:
        """Folders that stand beside one of rows; a subclass that writes some names them."""
        return []

    def _write(self, df: DataFrame, kind: str, version: int) -> tuple[str | None, int]:
        """Writes a new folder of the entry to come, ``version``; none for no rows.  Returns it and its number of rows."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(self.partition) if self.partition and kind != "dead" else w).parquet(f"{self.path}/{folder}")
        n = (self._rows_at([folder]) if kind != "dead" else self.spark.read.schema(_DEAD).parquet(f"{self.path}/{folder}")).count()
        return (folder, n) if n else (None, 0)

    def write(self, rows: DataFrame | None = None, gone: dict[str, DataFrame] | None = None, notes: dict | None = None) -> dict:
        """One commit: deletes what ``gone`` (a table of one column for each column to delete by) names, then puts ``rows`` in place of what their keys had.

        Each key occurs once in ``rows``.  ``notes`` are kept in the log; those of the last
        entry go on where they aren't given again.  Returns the log's entry.
        """
        last = self.entry()
        version, seq = last["version"] + 1, last["version"] * 2
        delta = {"rows": None, "dead": None, "n": 0, "by": []}
        if gone:
            for by in set(gone) - set(self.deleted_by):
                raise ValueError(f"rows aren't deleted by {by}")
            parts = [df.select(F.lit(by).alias("by"), F.col(by).cast("string").alias("value"), F.lit(seq).cast("long").alias(SEQ)) for by, df in gone.items()]
            dead = reduce(DataFrame.unionByName, parts).filter("value is not null").distinct()
            delta["dead"], n = self._write(dead, "dead", version)
            delta |= {"n": n, "by": sorted(gone) if n else []}
        if rows is not None:
            named = rows.select(*self.schema.names).withColumn(SEQ, F.lit(seq + 1).cast("long"))
            delta["rows"], n = self._write(named.sortWithinPartitions(self.order), "rows", version)
            delta["n"] += n
        if not delta["n"] and not notes:
            return last
        entry = {"version": version, "base": last["base"], "deltas": last["deltas"], "notes": last["notes"] | (notes or {})}
        if delta["rows"] and not last["base"] and not last["deltas"]:
            entry["base"] = {"rows": delta["rows"], "n": delta["n"]}
        elif delta["n"]:
            entry["deltas"] = [*last["deltas"], delta]
        return self._tidy(self._commit(entry))

    def clear(self) -> dict:
        """Leaves nothing, in one commit that writes no rows."""
        last = self.entry()
        return self._commit({"version": last["version"] + 1, "base": None, "deltas": [], "notes": {}})

    def _tidy(self, entry: dict) -> dict:
        """Merges what has grown enough: all into a base, or the last deltas of like size into one."""
        deltas, base = entry["deltas"], entry["base"]
        if not deltas:
            return entry
        if sum(d["n"] for d in deltas) * 2 > (base["n"] if base else 0) and (base or len(deltas) >= MERGED):
            return self.compact()
        tier = lambda d: int(math.log(max(d["n"], 1), MERGED))
        last = next((i for i, d in enumerate(reversed(deltas)) if tier(d) > tier(deltas[-1])), len(deltas))
        if last < MERGED:
            return entry
        some = deltas[-last:]
        marked = self._alive(self._rows_at([d["rows"] for d in some if d["rows"]]), some)
        # What was deleted here stays deleted in older folders, under its own key too.
        gone = marked.filter("not _alive").select(F.lit(self.key).alias("by"), F.col(self.key).cast("string").alias("value"), SEQ)
        dead = self._dead_at(some).unionByName(gone).groupBy("by", "value").agg(F.max(SEQ).alias(SEQ))
        one = {"rows": None, "dead": None, "by": sorted({b for d in some for b in d["by"]} | {self.key})}
        dealt = marked.filter("_alive").drop("_alive").repartitionByRange(self._files(sum(d["n"] for d in some)), self.order)
        one["rows"], n = self._write(dealt.sortWithinPartitions(self.order), "rows", entry["version"] + 1)
        one["dead"], m = self._write(dead, "dead", entry["version"] + 1)
        return self._commit(entry | {"version": entry["version"] + 1, "deltas": deltas[:-last] + [one | {"n": n + m}]})

    def _files(self, n: int) -> int:
        return self.files or max(1, -(-n // FILE_ROWS))

    def compact(self) -> dict:
        """Writes the rows as they are now as a new base, sorted by ``order``."""
        entry = self.entry()
        n = (entry["base"]["n"] if entry["base"] else 0) + sum(d["n"] for d in entry["deltas"])
        rows = self.load(entry["version"], keep=(SEQ,))
        by = [c for c in (self.partition, self.order) if c]
        folder, n = self._write(rows.repartitionByRange(self._files(n), *by).sortWithinPartitions(*by), "rows", entry["version"] + 1)
        return self._commit(entry | {"version": entry["version"] + 1, "base": {"rows": folder, "n": n} if folder else None, "deltas": []})

    def folders(self, version: int | None = None) -> list[str]:
        """Folders of rows that count at a version."""
        entry = self.entry(version)
        return ([entry["base"]["rows"]] if entry["base"] else []) + [d["rows"] for d in entry["deltas"] if d["rows"]]

    def vacuum(self, keep: int = 10) -> list[str]:
        """Drops all but the last ``keep`` entries of the log, and folders that no entry left names, those of commits that never came among them.  Not while someone writes."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop.Path(self._log(v)), False)
        used = {"log"}
        for v in versions[-keep:]:
            entry = self.entry(v)
            named = [f for d in [*entry["deltas"], entry["base"] or {}] for f in (d.get("rows"), d.get("dead")) if f]
            used |= {*named, *(c for f in named for c in self.companions(f)), *map(str, entry["notes"].values())}
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(self.path)) if s.getPath().getName() not in used]
        for name in gone:
            self._fs.delete(self._hadoop.Path(f"{self.path}/{name}"), True)
        return gone
