"""Chunking of block text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graphemes import clusters, is_simple
from ..functions.text import TERMINATORS, trim

SPANS = "array<struct<s:int,e:int>>"


def fixed_chunks(df: DataFrame, size: int = 240, overlap: int = 40, text: str = "text") -> DataFrame:
    """``df`` with a row for each piece of its text that isn't blank: columns chunk_index, s, e and t (trimmed) in place of the text.

    Pieces are windows [s, e) of ``size`` characters that end after a terminator within the
    last quarter, if there is one; the next begins ``overlap`` before.  Characters are
    graphemes: one of several code points counts once and is never cut.

    One pass of Arrow batches emits the rows.  A fold over built-in functions says the same,
    but looks up each window from the start of the text, which takes quadratic time on long texts.
    """
    rest = [c for c in df.columns if c != text]
    ends = re.compile(f"[{re.escape(TERMINATORS)}]")
    back = max(1, size // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest))
            lo, held = 0, 0
            for i in range(len(texts)):
                held += len(texts[i].as_py() or "") if len(texts) > 1 else 0
                if held > 1 << 20:
                    yield rows(batch.slice(lo, i + 1 - lo))
                    lo, held = i + 1, 0
            if lo < len(texts):
                yield rows(batch.slice(lo))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, index, starts, stops, pieces = [], [], [], [], []
        for i, text in enumerate(batch.column(len(rest)).to_pylist()):
            text = text or ""
            # A text, or its graphemes: both are cut by place, and only the latter are joined again.
            units = text if is_simple(text) else clusters(text)
            marks = None if units is text else [n + 1 for n, u in enumerate(units) if u in TERMINATORS]
            n, start, k = len(units), 0, 0
            while start < n:
                stop = hard = min(start + size, n)
                if hard < n:
                    # Exclusive bounds: the last quarter without its first place, and never the first of the window.
                    low = max(hard - back + 1, start + 1)
                    if marks is None:
                        at = [m.end() for m in ends.finditer(text, low, hard)]
                    else:
                        at = marks[bisect_right(marks, low) : bisect_right(marks, hard)]
                    stop = at[-1] if at else hard
                piece = (units[start:stop] if marks is None else "".join(units[start:stop])).strip(" \t\n\v\f\r")
                if piece:
                    owner.append(i), index.append(k), starts.append(start), stops.append(stop), pieces.append(piece)
                    k += 1
                if stop >= n:
                    break
                start = max(start + 1, stop - overlap)
        kept = batch.take(pa.array(owner, pa.int64())).columns[: len(rest)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(index, pa.int32()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(pieces, pa.string())], names=[*rest, "chunk_index", "s", "e", "t"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.select(*rest, text).mapInArrow(run, fields + ", chunk_index int, s int, e int, t string")


def _with_text(pieces: Column, text: Column, strip: bool = True) -> Column:
    part = lambda p: F.substring(text, p["s"] + 1, p["e"] - p["s"])
    return F.transform(pieces, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), (trim(part(p)) if strip else text).alias("t")))


def sentence_pieces(text: Column, size: int = 240) -> Column:
    """Whole sentences, as many as fit into ``size`` characters; a longer sentence stands alone."""
    sentences = F.regexp_extract_all(text, F.lit(f"(?s)[^{TERMINATORS}]*[{TERMINATORS}]|[^{TERMINATORS}]+$"), F.lit(0))

    def step(state: Column, sentence: Column) -> Column:
        end = state["end"] + F.length(sentence)
        split = (state["end"] > state["start"]) & (end - state["start"] > size)
        done = F.concat(state["pieces"], F.array(F.struct(state["start"].alias("s"), state["end"].alias("e"))))
        return F.struct(F.when(split, state["end"]).otherwise(state["start"]).alias("start"), end.alias("end"), F.when(split, done).otherwise(state["pieces"]).alias("pieces"))

    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast(SPANS).alias("pieces"))
    spans = F.aggregate(sentences, first, step, lambda s: F.when(s["end"] > s["start"], F.concat(s["pieces"], F.array(F.struct(s["start"].alias("s"), s["end"].alias("e"))))).otherwise(s["pieces"]))
    return _with_text(spans, text)


def block_pieces(text: Column) -> Column:
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("e"))).cast(SPANS)
    return _with_text(whole, text, strip=False)


STRATEGIES = {"sentence": sentence_pieces, "block": lambda text, *_: block_pieces(text)}


def chunk(blocks: DataFrame, strategy: str = "fixed", *parameters: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of ``blocks`` (note_id, block_id, ord, source, text, content_hash), one row each; columns in ``keep`` come along.

    Blank pieces are left out before numbering, so ids are dense; offsets are those of
    the untrimmed piece.  The id is note/block/number.
    """
    name = strategy if strategy == "block" else f"{strategy}-{'-'.join(map(str, parameters or ((240, 40) if strategy == 'fixed' else (240,))))}"
    some = blocks.filter(F.length("text") > 0).select("note_id", "block_id", "ord", "source", "content_hash", *keep, "text")
    if strategy == "fixed":
        rows = fixed_chunks(some, *parameters)
    else:
        pieces = F.filter(STRATEGIES[strategy](F.col("text"), *parameters), lambda p: p["t"] != "")
        rows = some.select("*", F.posexplode(pieces).alias("chunk_index", "p")).select("note_id", "block_id", "ord", "source", "content_hash", *keep, "chunk_index", "p.s", "p.e", "p.t")
    return rows.select(
        F.concat_ws("/", "note_id", "block_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "note_id", "block_id", "ord", "source", "chunk_index",
        F.col("t").alias("text"), F.col("s").alias("char_start"), F.col("e").alias("char_end"), "content_hash", F.lit(name).alias("strategy"), *keep,
    )
