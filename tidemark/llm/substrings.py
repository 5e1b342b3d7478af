"""Substring dedup by content-defined chunking.

A gear hash rolls over the words of a text (white space apart); a word end is a
cut where two bits of the hash, which see the last 16 bytes only, are zero.
Of cuts that follow each other every other one is dropped.  In long gaps a weaker
condition cuts as well, and in those that are left a word whose hash is the least around; all
rules look at nothing but nearby text, so an insertion moves only the cuts around it,
and repeated words are cut as any others.  As single chunks of common words recur
by chance, a digest covers ``WINDOW`` chunks in a row.  Windows with equal digests,
in several documents or in one, are repeats, and runs of adjacent repeats of at least
``min_words`` words, less those that its edges may lose, are the passages to remove,
all but their first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_ROWS, cut, fresh, join_hot, parallelism, table, text_batches

#: Words of a passage, and how many of them the chunks at its edges may lose.
MIN_WORDS, EDGE = 34, 10
LONG_GAP = 8
#: In gaps that are long still, a word is a cut if its hash is the least of so many words to either side.
NEAR = 4
#: Adjacent chunks under one digest.
WINDOW = 3
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint32)


def cut_points(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with single blanks, the ends of its words in it, and the numbers of the words after which it is cut, the last one included."""
    norm = b" ".join(text.split()) + b" "
    codes = np.frombuffer(norm, np.uint8)
    ends = np.flatnonzero(codes == 32)
    if len(norm) == 1:
        return b"", ends[:0], ends[:0]
    h = _GEAR[codes]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint32(width)
    at = h[ends]
    padded = np.pad(at, NEAR, mode="edge")
    least = np.lib.stride_tricks.sliding_window_view(padded, 2 * NEAR + 1).min(axis=1)
    cuts = np.array([len(ends) - 1])
    for candidates in ((at >> 13) & 3 == 0, (at >> 12) & 1 == 0, at == least):
        edges = np.concatenate([[-1], cuts])
        some = _thinned(np.flatnonzero(candidates))
        wide = np.diff(edges)[np.minimum(np.searchsorted(edges, some) - 1, len(cuts) - 1)] > (LONG_GAP if len(cuts) > 1 else 0)
        cuts = np.union1d(cuts, some[wide])
    return norm, ends, cuts


def _thinned(some: np.ndarray) -> np.ndarray:
    """Every other of numbers that follow each other, the first of them included: where all words are candidates, too, cuts are two words apart."""
    first = np.diff(some, prepend=-9) > 1
    turn = np.arange(len(some)) - np.maximum.accumulate(np.where(first, np.arange(len(some)), 0)) if len(some) else some
    return some[turn % 2 == 0]


def chunks(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, doc, start, span, digest): each window of chunks of each text by its first word, its number of words and its digest.

    ``doc`` is a digest of the text, which tells rows of one id (or of none) apart.  A text
    of fewer chunks than a window has one window, a null text or one without words has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            row, start, span, out, doc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                norm, ends, cuts = cut_points(t or b"")
                if len(cuts):
                    first = np.concatenate([[0], cuts + 1])
                    place = np.concatenate([[0], ends[cuts] + 1]).tolist()
                    w = min(WINDOW, len(cuts))
                    m = len(cuts) - w + 1
                    row.append(np.full(m, i)), start.append(first[:m]), span.append((first[w:] - first[:-w])[:m]), doc.append(np.full(m, digest(norm), np.uint64))
                    out += [digest(norm[a:b]) for a, b in zip(place[:m], place[w:], strict=True)]
            if row:
                columns = [pa.array(np.concatenate(x).astype(np.int32)) for x in (start, span)]
                named = [pa.array(x.view(np.int64)) for x in (np.concatenate(doc), np.array(out, np.uint64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), named[0], *columns, named[1]], names=["id", "doc", "start", "span", "digest"])

    text_batches(df.sparkSession)
    return df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, doc long, start int, span int, digest long")


def repeated_spans(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, doc, start_word, n_words, kept, first_id): the parts of each repeated passage.

    ``kept`` parts are where their text comes first (by id, null last, then place); the others
    are to be removed and ``first_id`` names the smallest id that has them.  A passage that
    a text repeats within itself counts too.  Null texts have no words.  Rows that share an
    id, or have none, are told apart by ``doc``, a digest of the text (null where ids are
    all there and all different); rows that repeat both are one document.  An empty table
    gives an empty result.
    """
    # Most windows occur once.  They are told from the repeats by narrow rows: digest, id, and start and words in one number.
    one = (F.shiftleft(F.col("start").cast("long"), 31) + F.col("span")).alias("place")
    plain = df.groupBy(F.col(id).cast("long").alias("id")).count().filter("count > 1 or id is null").isEmpty()
    every = table(chunks(df, text, id).select("digest", "id", *([] if plain else ["doc"]), one))
    if not plain:
        every = every.distinct()
    first = F.min("id") if plain else F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc"))
    found = cut(every.groupBy("digest").agg(first.alias("first"), F.count("*").alias("times")).filter("times > 1"))
    met = join_hot(every, found, ["digest"], F.col("times") > HOT_ROWS)
    at = [F.shiftright("place", 31).cast("int").alias("start"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("span")]
    mine = F.col("id") == F.col("first") if plain else F.struct(F.col("id").isNull().alias("none"), "id", "doc") == F.col("first")
    first_id = F.col("first") if plain else F.col("first.id")
    doc = F.lit(None).cast("long").alias("doc") if plain else F.col("doc")
    # One exchange, by document, serves all that follows.
    who = ["id"] if plain else ["id", "doc"]
    marked = met.select("id", doc, "digest", *at, first_id.alias("first_id"), mine.alias("mine")).repartition(parallelism(df.sparkSession), *who)
    again = F.row_number().over(Window.partitionBy(*who, "digest").orderBy("start"))
    marked = marked.withColumn("kept", F.col("mine") & (again == 1))
    # Windows overlap; those that touch or overlap make a run.
    by = Window.partitionBy(*who).orderBy("start")
    end = F.col("start") + F.col("span")
    reached = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    whole = Window.partitionBy(*who, "run")
    runs = runs.withColumn("words", F.max(end).over(whole) - F.min("start").over(whole)).filter(F.col("words") >= min_words - EDGE)
    in_run = whole.orderBy("start")
    parts = runs.withColumn("turn", F.when(F.lag("kept").over(in_run) == F.col("kept"), 0).otherwise(1)).withColumn("part", F.sum("turn").over(in_run))
    return parts.groupBy(*who, "run", "part").agg(
        F.first("doc").alias("text_digest"), F.min("start").alias("start_word"), (F.max(end) - F.min("start")).cast("int").alias("n_words"), F.first("kept").alias("kept"), F.min("first_id").alias("first_id")
    ).select("id", F.col("text_digest").alias("doc"), "start_word", "n_words", "kept", "first_id")


def remove_spans(df: DataFrame, spans: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``df`` with the words of the spans that are not kept taken out, unless a kept span has them too.

    Texts without such spans, null ones too, stay as they are; so do rows whose digest is not
    that of the span's ``doc``.  All columns and rows are kept.
    """
    other, cut, of = fresh(df, "other", "cut", "of")
    some = spans.filter("not kept").select("id", "doc").distinct().withColumnsRenamed({"id": other, "doc": of})
    same = spans["id"].eqNullSafe(some[other]) & spans["doc"].eqNullSafe(some[of])
    span = F.struct("kept", "start_word", (F.col("start_word") + F.col("n_words")).alias("end_word"), F.col("doc"))
    # One row for each id: what its texts lose, each by its digest.
    gone = spans.join(some, same, "left_semi").groupBy(F.col("id").alias(other)).agg(F.sort_array(F.collect_list(span)).alias(cut))

    @F.pandas_udf("string")
    def without(texts, gone):
        out = []
        for t, spans in zip(texts, gone, strict=True):
            if t is None or spans is None:
                out.append(t)
                continue
            words = t.encode().split()
            norm = b" ".join(words) + b" "
            mine = int(np.uint64(xxhash.xxh3_64_intdigest(norm)).view(np.int64))
            keep = np.ones(len(words), bool)
            hit = False
            for s in spans:
                if s["doc"] is None or s["doc"] == mine:
                    keep[s["start_word"] : s["end_word"]] = s["kept"]
                    hit = True
            out.append(b" ".join(w for w, k in zip(words, keep, strict=True) if k).decode() if hit else t)
        return type(texts)(out)

    joined = df.join(gone, F.col(id).cast("long").eqNullSafe(F.col(other)), "left")
    return joined.withColumn(text, without(F.col(text), F.col(cut))).select(*df.columns)
