"""The chunk table and its index, kept in step with the files they are made from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..operators import grams
from ..operators.chunk import chunk
from ..operators.lexical import with_hay
from .deltas import DeltaTable

_FIELDS = "chunk_id string, note_id string, block_id string, ord int, source string, chunk_index int, text string, char_start int, char_end int, content_hash string, strategy string, file string, hay string, part long, place int"
#: Changed files that are read by name; beyond it all files are listed, and those that didn't change are skipped by a join.
NAMED = 10_000


class ChunkTable(DeltaTable):
    """Chunks of the blocks of a folder of Parquet files, with their folded text, and an index of its grams beside each folder of them.

    ``blocks`` makes rows (note_id, block_id, ord, source, text, content_hash, file) of the
    files' rows, which have ``file`` as well; block ids are unique.  A block is chunked again
    if its content changed or its file has another name.
    """

    def __init__(self, spark: SparkSession, path: str, blocks: Callable[[DataFrame], DataFrame], strategy: str = "fixed", *parameters: int):
        super().__init__(spark, path, t.StructType.fromDDL(_FIELDS), "chunk_id", ("block_id",), order="part")
        self.blocks, self.strategy, self.parameters = blocks, strategy, parameters

    def companions(self, folder: str) -> list[str]:
        return [f"grams-{folder}"]

    def _write(self, df: DataFrame, kind: str, version: int) -> tuple[str | None, int]:
        """Rows get new places whenever they are written, and an index of those."""
        if kind == "dead":
            return super()._write(df, kind, version)
        folder, n = super()._write(grams.numbered(df, version), kind, version)
        if folder:
            grams.build(self._rows_at([folder])).write.parquet(f"{self.path}/grams-{folder}")
        return folder, n

    def index(self, version: int | None = None) -> DataFrame:
        """The index of all chunks at a version; it may name places whose chunk is gone."""
        paths = [f"{self.path}/grams-{f}" for f in self.folders(version)]
        df = self.spark.read.schema(grams._INDEX)
        return df.parquet(*paths) if paths else self.spark.createDataFrame([], grams._INDEX)

    def refresh(self, source: str) -> dict:
        """Brings the table in step with the files at ``source`` in one commit; reads no text if none of them changed.

        Files are told apart by name, length and time of change.  Returns the entry of the log.
        """
        m = F.col("_metadata")
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_modification_time"].cast("string").alias("changed"))
        mark = F.xxhash64("file", "size", "changed")
        found = listed.agg(F.count("*").alias("files"), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first()
        digest = "-".join(map(str, found))
        last = self.entry()
        if last["notes"].get("digest") == digest:
            return last
        manifest = f"manifest-{uuid.uuid4().hex}"
        listed.write.parquet(f"{self.path}/{manifest}")
        now = self.spark.read.schema(listed.schema).parquet(f"{self.path}/{manifest}")
        rows = self.spark.read.parquet(source).withColumn("file", m["file_path"])
        gone = None
        if "manifest" in last["notes"]:
            before = self.spark.read.schema(listed.schema).parquet(f"{self.path}/{last['notes']['manifest']}")
            same = ["file", "size", "changed"]
            new, lost = now.join(before, same, "left_anti").select("file"), before.join(now, same, "left_anti").select("file")
            names = [r.file for r in new.limit(NAMED + 1).collect()]
            rows = rows.filter(F.col("file").isin(names)) if len(names) <= NAMED else rows.join(new, "file", "left_semi")
            have = self.load(last["version"]).select("block_id", "content_hash", "file").distinct().join(lost, "file", "left_semi")
            current = self.blocks(rows)
            key = ["block_id", "content_hash", "file"]
            gone = {"block_id": have.join(current.select(*key), key, "left_anti").select("block_id")}
            current = current.join(have, key, "left_anti")
        else:
            current = self.blocks(rows)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if found.files < tasks:  # a few large files would keep a few tasks busy
            current = current.repartition(tasks)
        made = with_hay(chunk(current, self.strategy, *self.parameters, keep=("file",)))
        places = {"part": F.lit(None).cast("long"), "place": F.lit(None).cast("int")}
        return self.write(made.withColumns(places), gone, {"digest": digest, "manifest": manifest})


