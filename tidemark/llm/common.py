"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import session_dir, shared_dir

#: White space as all contracts here define it: blank and the bytes 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch that carries whole texts.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have at most ``TEXT_ROWS`` rows, as each holds a whole text: ten times as many take over 100 MB on both sides of a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the session's shared folder and reads it back: a compressed :func:`cut`."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids and digests (some 50 bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most so many rows; else as it is, for a join that shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key from which on a join treats the key as hot.
HOT_ROWS = 10_000
#: Places that a hot key is spread over where hot keys are too many to broadcast.
SALTS = 16


def join_hot(df: DataFrame, side: DataFrame, on: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``df`` joined to ``side``, which has one row for each key of ``on`` (no nulls); ``how``: inner or left.

    Rows of ``df`` whose key is ``hot`` (a condition on ``side``) stay where they are: the
    rows of ``side`` for those keys, at most one for each ``HOT_ROWS`` rows of ``df``, are
    broadcast if their number allows; else each of them meets its rows in ``SALTS`` places,
    told apart by all columns of ``df``.  All other rows are exchanged by the key.
    """
    seen, salt = fresh(df, "seen", "salt")
    few = side.filter(hot).withColumn(seen, F.lit(True))
    if few.isEmpty():
        return df.join(side, on, how)
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = df.join(F.broadcast(few), on, "left")
    else:
        spread = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = df.withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")).join(spread, [*on, salt], "left").drop(salt)
    met = marked.filter(F.col(seen)).drop(seen)
    rest = marked.filter(F.col(seen).isNull()).select(*df.columns).join(side.filter(~hot), on, how)
    return met.unionByName(rest)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of ``text`` as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each changed until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
