"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, packing, simhash, toxicity
from tidemark.llm.common import fresh, table
from tidemark.llm.queries import default_tokenizer


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the network learns from labelled documents outside the held-out third."""
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = tuple(fresh(docs, "score", "predicted"))
    net = toxicity.fit(docs, labels, ~held_out)
    return toxicity.score(docs, net, names=names).filter(F.col(names[1]) == 0).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates: texts that share 0.8 of their five-word shingles."""
    return simhash.drop_near(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.repeat_by_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all documents into sequences; a null text is one end mark, equal rows may change places."""
    pieces = packing.tokenize(docs, default_tokenizer())
    digests = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, ["doc_id", "piece", "start", "ids_crc32"])


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("simhash near-dedup", near), ("source mix", mix), ("best-fit packing", pack)]

#: The network's scores and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
