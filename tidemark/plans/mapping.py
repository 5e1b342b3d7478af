"""The note model over the corpus tables: which table stands for notes, blocks, cases and events."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, retrievable
from ..operators.lexical import containing
from ..sources.io import session_dir
from ..sources.maintained import ChunkTable

BLOCK_COLUMNS = ("text", "image_caption", "image_asset_ref", "transcript", "audio_asset_ref", "file_name", "file_type", "extracted_text", "url", "link_title", "link_description")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each document, of the kind that its id gives."""
    return blocks_of(read(spark, sf_dir, "documents"))


def blocks_of(d: DataFrame, *keep: str) -> DataFrame:
    """:func:`document_blocks` of some rows; columns in ``keep`` come along."""
    k = F.col("doc_id") % 5
    n = F.col("doc_id").cast("string")
    when = lambda i, c: F.when(k == i, c)
    return d.select(
        F.concat(F.lit("n"), n).alias("note_id"), F.concat(F.lit("b"), n).alias("block_id"), F.lit(0).alias("ord"),
        F.element_at(F.array(*map(F.lit, ("text", "audio", "image", "file", "link"))), (k + 1).cast("int")).alias("kind"),
        when(0, F.col("text")).alias("text"), when(2, F.col("text")).alias("image_caption"), when(2, F.concat(F.lit("img"), n)).alias("image_asset_ref"),
        when(1, F.col("text")).alias("transcript"), when(1, F.concat(F.lit("aud"), n)).alias("audio_asset_ref"),
        when(3, F.concat(F.lit("f"), n, F.lit(".txt"))).alias("file_name"), when(3, F.col("lang")).alias("file_type"), when(3, F.col("text")).alias("extracted_text"),
        when(4, F.concat(F.lit("https://example.org/"), n)).alias("url"), when(4, F.col("source")).alias("link_title"), when(4, F.col("text")).alias("link_description"),
        F.lit(False).alias("extraction_unavailable"), *keep,
    )


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of several blocks: a conversation's turns, users as text, assistants as audio, others as files."""
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "audio").otherwise("file")
    note, block = F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat_ws("-", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    when = lambda k, c: F.when(kind == k, c)
    none = F.lit(None).cast("string")
    return c.select(
        note.alias("note_id"), block.alias("block_id"), F.col("turn").cast("int").alias("ord"), kind.alias("kind"), when("text", F.col("text")).alias("text"), none.alias("image_caption"), none.alias("image_asset_ref"),
        when("audio", F.col("text")).alias("transcript"), when("audio", block).alias("audio_asset_ref"), when("file", F.lit("system.txt")).alias("file_name"), when("file", F.lit("txt")).alias("file_type"),
        when("file", F.col("text")).alias("extracted_text"), none.alias("url"), none.alias("link_title"), none.alias("link_description"), F.lit(False).alias("extraction_unavailable"),
    )


def texts(blocks: DataFrame, *keep: str) -> DataFrame:
    """(note_id, block_id, ord, source, text, content_hash) of the blocks that have text to search."""
    b = {c: F.col(c) for c in blocks.columns if c not in keep}
    made = blocks.select("note_id", "block_id", "ord", retrievable(b).alias("r"), content_hash(b).alias("content_hash"), *keep)
    return made.filter("r is not null").select("note_id", "block_id", "ord", "r.source", "r.text", "content_hash", *keep)


def chunk_table(spark: SparkSession, sf_dir: str, strategy: str = "fixed", *parameters: int) -> ChunkTable:
    """Chunks of all documents with their folded text and their index, in step with the files as they are now; kept in the session's folder."""
    name = "-".join(["chunks", hashlib.md5(sf_dir.encode()).hexdigest(), strategy, *map(str, parameters)])
    made = ChunkTable(spark, f"{session_dir(spark)}/{name}", lambda rows: texts(blocks_of(rows, "file"), "file"), strategy, *parameters)
    made.refresh(f"{sf_dir}/documents.parquet")
    return made


def corpus(spark: SparkSession, sf_dir: str, strategy: str = "fixed", *parameters: int) -> DataFrame:
    """The chunk table's rows."""
    return chunk_table(spark, sf_dir, strategy, *parameters).load()


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each benchmark item: its first five words as query, expected the notes that contain it whole."""
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    met = containing(docs, items.select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern")))
    held = met.groupBy(F.col("pattern_id").alias("item_id")).agg(F.array_sort(F.collect_list("text_id")).alias("expected"))
    words = F.slice(F.split("text", r"\s+"), 1, 5)
    return items.join(held, "item_id", "left").select(
        F.col("item_id").cast("string").alias("case_id"), F.array_join(words, " ").alias("query"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"),
        F.when(F.col("item_id") % 4 == 0, "cross_language").otherwise("in_scope").alias("scope"), F.when(F.col("item_id") % 3 == 0, "regression").otherwise("golden").alias("origin"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query."""
    return vectors(spark, sf_dir).filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("label").alias("query_label"))
