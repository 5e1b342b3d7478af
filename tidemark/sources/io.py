"""Reading and writing notes: tables, JSON datasets, text files, exports, derived stores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

from ..functions.text import trim
from .deltas import DeltaTable

# The fields of an evaluation dataset and the file types that have text.
_note = "struct<id:string,title:string,content:string,source:string,language:string,role:string,cluster:string>"
_case = (
    "struct<id:string,query:string,note:string,style:string,expectedNoteIDs:array<string>,queryLanguage:string,expectedLanguage:string,scope:string,"
    "category:string,difficulty:string,split:string,relevance:map<string,int>,hardNegativeNoteIDs:array<string>,isRegression:boolean>"
)
_negative = "struct<id:string,query:string,reason:string,split:string>"
DATASET = f"version string, checksum string, notes array<{_note}>, candidates array<{_case}>, negatives array<{_negative}>"
TEXT_TYPES = ("txt", "md", "markdown")
RELEVANT = 2


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; only local sessions may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        _drop_at_exit(spark, sc.getCheckpointDir())  # a folder of this session's own within the named one
    return sc.getCheckpointDir()


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)


_made: set[str] = set()


def session_dir(spark: SparkSession) -> str:
    """A folder of this session in the shared one, deleted when the driver ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/tidemark-{sc.applicationId}"
    if path not in _made:
        _made.add(path)
        _drop_at_exit(spark, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder of the session and read back: computed once for all uses within a query, and not kept for another."""
    path = new_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """One row by its id; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).json(path, multiLine=True)


def dataset_notes(dataset: DataFrame) -> DataFrame:
    return dataset.select(F.explode("notes").alias("n")).select("n.*")


def dataset_cases(dataset: DataFrame, split: str | None = None) -> DataFrame:
    """Cases of a dataset, negatives with no expected notes.

    Where notes are graded, those of grade 2 and above are expected; a case without a
    split belongs to development.
    """
    graded = F.map_keys(F.map_filter("c.relevance", lambda _, g: g >= RELEVANT))
    expected = F.when(F.size("c.relevance") > 0, F.array_sort(graded)).otherwise(F.coalesce("c.expectedNoteIDs", F.array().cast("array<string>")))
    regression = F.coalesce("c.isRegression", F.lit(False))
    cases = dataset.select(F.explode("candidates").alias("c")).select(
        F.col("c.id").alias("case_id"), "c.query", expected.alias("expected"), F.coalesce("c.scope", F.lit("in_scope")).alias("scope"), F.when(regression, "regression").otherwise("golden").alias("origin"),
        "c.category", F.coalesce("c.split", F.lit("development")).alias("split"),
    )
    negatives = dataset.select(F.explode("negatives").alias("c")).select(
        F.col("c.id").alias("case_id"), "c.query", F.array().cast("array<string>").alias("expected"), F.lit("in_scope").alias("scope"), F.lit("golden").alias("origin"), F.lit("negative").alias("category"),
        F.coalesce("c.split", F.lit("development")).alias("split"),
    )
    both = cases.unionByName(negatives)
    return both if split is None else both.filter(F.col("split") == split)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file_name, file_type, extracted_text, extraction_unavailable) of a folder; files of other types have no text."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    has = kind.isin(*TEXT_TYPES)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), kind.alias("file_type"), F.when(has, F.decode("content", "UTF-8")).alias("extracted_text"), (~has).alias("extraction_unavailable"))


def write_exports(exports: DataFrame, path: str) -> None:
    """One file of text a partition, notes parted by their ids: ``exports`` has note_id and text."""
    exports.select("note_id", "text").write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str, part: str | None = None) -> None:
    """One JSON object a row; with ``part``, a folder for each value of that column."""
    w = df.write.mode("overwrite")
    (w.partitionBy(part) if part else w).json(path)


def ocr_text(blocks: DataFrame, overlay: DataFrame, check_hash: bool = True) -> DataFrame:
    """Blocks with ``ocr`` from an overlay (note_id, block_id, content_hash, text), only where the hash is still that of the block unless told otherwise."""
    o = overlay.select("note_id", "block_id", F.col("content_hash").alias("_h"), F.col("text").alias("_ocr"))
    j = blocks.join(o, ["note_id", "block_id"], "left")
    ok = (F.col("_h") == F.col("content_hash")) if check_hash else F.lit(True)
    return j.withColumn("ocr", F.when(ok & (trim(F.col("_ocr")) != ""), F.col("_ocr"))).drop("_h", "_ocr")


class DerivedStore:
    """Embedding records as a :class:`DeltaTable`, parted by version and sorted by note.

    A write costs what it writes, at any size of the store; each is one commit.  A load of one
    version or note reads little of the others.  ``buckets``: files of a rewritten base.
    """

    def __init__(self, spark: SparkSession, path: str, schema: t.StructType, buckets: int | None = None):
        self.spark = spark
        self.table = DeltaTable(spark, path, schema, "chunk_id", ("block_id", "note_id"), order="note_id", partition="embedding_version", files=buckets)

    def load(self, version: str | None = None, note_id: str | None = None, at: int | None = None) -> DataFrame:
        """All records, those of an embedding version, or those of a note; as they are now or were at an entry of the log."""
        df = self.table.load(at)
        df = df if version is None else df.filter(F.col("embedding_version") == version)
        return df if note_id is None else df.filter(F.col("note_id") == note_id)

    def upsert(self, new: DataFrame) -> None:
        """Writes records, each in place of what its chunk had, of any version; of several for a chunk the latest by ``created_at``."""
        latest = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("created_at")))
        self.table.write(new.withColumn("_n", latest).filter("_n = 1").drop("_n"))

    def delete(self, gone: DataFrame, by: str = "chunk_id") -> None:
        """Removes records by chunk_id, block_id or note_id."""
        self.table.write(gone={by: gone})

    def clear(self) -> None:
        """Removes everything, as after a change of strategy or provider."""
        self.table.clear()

    def chunk_ids(self, block_id: str | None = None) -> DataFrame:
        """Chunk ids in the store, or those of a block, in order."""
        df = self.load()
        return (df if block_id is None else df.filter(F.col("block_id") == block_id)).select("chunk_id").orderBy("chunk_id")

    def note_ids(self) -> DataFrame:
        return self.load().select("note_id").distinct()
