"""Differences between a note's blocks and the snapshot of its last summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TEXT_CHARS = 12


def snapshot_diff(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows (note_id, block_id, change, kind, brief, delta): added, modified and deleted blocks.

    Both sides have note_id, block_id, hash, kind, brief and text_length; ``delta`` is
    by how many characters text grew or shrank.
    """
    old = snapshot.select("note_id", "block_id", *[F.col(c).alias("old_" + c) for c in ("hash", "kind", "brief", "text_length")])
    both = current.join(old, ["note_id", "block_id"], "full")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("old_hash"), "modified")
    delta = F.abs(F.coalesce("text_length", F.lit(0)) - F.coalesce("old_text_length", F.lit(0)))
    return both.select("note_id", "block_id", change.alias("change"), F.coalesce("kind", "old_kind").alias("kind"), F.coalesce("brief", "old_brief").alias("brief"), delta.alias("delta")).filter("change is not null")


def significance(diff: DataFrame, min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Rows (note_id, significant): any deletion or change of another kind than text, or enough changed text."""
    other = (F.col("change") == "deleted") | (F.col("kind") != "text")
    text = F.sum(F.when((F.col("change") != "deleted") & (F.col("kind") == "text"), F.col("delta")).otherwise(0))
    return diff.groupBy("note_id").agg((F.bool_or(other) | (text >= min_chars)).alias("significant"))


def next_snapshot(current: DataFrame, snapshot: DataFrame, found: DataFrame) -> DataFrame:
    """The snapshot after a run: current blocks of notes whose difference is significant or that had none; others keep theirs, so small edits add up."""
    accepted = found.filter("significant").select("note_id")
    first = current.select("note_id").distinct().join(snapshot.select("note_id").distinct(), "note_id", "left_anti")
    renewed = accepted.union(first).distinct()
    kept = snapshot.join(accepted, "note_id", "left_anti")
    return kept.unionByName(current.join(renewed, "note_id", "left_semi").select(snapshot.columns))
