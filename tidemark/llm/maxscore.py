"""Ranked lexical search with MaxScore in shards of an inverted index.

One pass over the texts makes shards: a row holds the documents of a shard and,
term by term, their postings, for the terms that the queries have.  Counts over
all shards give the weights.  The search then reads the shards only.  Within a
shard a query's lists are ordered by their upper bounds; the lists that could
lift a document past the score to beat by themselves are essential and name the
candidates, and all others are probed only for candidates that can still get
there.  A task carries its best documents of each query from shard to shard, so
the score to beat rises as it goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table
from .words import coded_words, groups

#: Documents and postings of a shard at most (one document at least): a row has some 8 MB.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Terms of the queries that one pass over the texts looks for; more queries take several passes.
TERMS_A_PASS = 500_000
#: The saturation of a term's count and how far the length of a document counts, in hundredths.
K1_X8, LENGTH_PART = 8, 90

_SHARD = "ids array<long>, lengths array<int>, terms array<int>, ends array<int>, docs array<int>, counts array<int>"
#: What each byte counts as: letters, digits and all bytes of other alphabets are kept, A to Z in lower case, the rest parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def coded_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """As :func:`coded_words`, for terms: runs of letters, digits and anything beyond ASCII, A to Z in lower case."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = bytes(texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]) if texts.buffers()[2] else b"").translate(_FOLD)
    return coded_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(folded)))


def query_terms(queries: DataFrame, text: str = "text", id: str = "item_id") -> DataFrame:
    """Rows (item, term), each once: the terms of each query; rows of one id are one query, and a null text has no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in groups(batch.column(1)):
                codes, distinct, offsets = coded_terms(part)
                item = np.repeat(np.arange(lo, lo + len(part)), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), distinct.take(pa.array(codes, pa.int64()))], names=["item", "term"])

    return queries.select(F.col(id).cast("long").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, "item long, term string").distinct()


def shards(docs: DataFrame, vocabulary: list[str], text: str = "text", id: str = "doc_id", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row for each shard: its documents that have terms, and the postings of the terms of ``vocabulary``.

    ``terms`` are places in the vocabulary, ascending; ``ends`` says where each one's postings
    end in ``docs`` (places within the shard, ascending) and ``counts``.  Null texts have no terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        ids, lengths, postings, n_docs, n_postings = [], [], [], 0, 0
        for batch in batches:
            for lo, part in groups(batch.column(1)):
                codes, distinct, offsets = coded_terms(part)
                length = np.diff(offsets)
                some = np.flatnonzero(length)
                place = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(some)), length[some])
                term = place[codes] if len(codes) else np.zeros(0, np.int64)
                pairs, count = np.unique((term * len(part) + doc)[term >= 0], return_counts=True)
                ids.append(batch.column(0).take(pa.array(lo + some)))
                lengths.append(length[some])
                postings.append((pairs // len(part), pairs % len(part) + n_docs, count))
                n_docs, n_postings = n_docs + len(some), n_postings + len(pairs)
                if n_docs >= shard_docs or n_postings >= shard_postings:
                    yield _shard(ids, lengths, postings)
                    ids, lengths, postings, n_docs, n_postings = [], [], [], 0, 0
        if n_docs:
            yield _shard(ids, lengths, postings)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _SHARD)


def _shard(ids: list[pa.Array], lengths: list[np.ndarray], postings: list[tuple]) -> pa.RecordBatch:
    term, doc, count = (np.concatenate([p[i] for p in postings]) for i in range(3))
    order = np.argsort(term, kind="stable")  # documents come in their order already
    terms, n = np.unique(term, return_counts=True)
    columns = [pa.concat_arrays(ids), pa.array(np.concatenate(lengths), pa.int32()), *[pa.array(x, pa.int32()) for x in (terms, np.cumsum(n), doc[order], count[order])]]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["ids", "lengths", "terms", "ends", "docs", "counts"])


@dataclass
class Lists:
    """The postings of a shard with what each one adds to a score."""

    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    adds: np.ndarray
    bounds: np.ndarray
    n_docs: int


def lists_of(lengths: np.ndarray, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> Lists:
    """``weights`` by place in the vocabulary; documents and terms of the whole table give the mean length."""
    m = 100 - LENGTH_PART + (LENGTH_PART * lengths.astype(np.int64) * n_docs) // n_terms
    tf = counts.astype(np.int64)
    starts = np.append(0, ends).astype(np.int64)
    adds = np.repeat(weights[terms], np.diff(starts)) * ((1_000_000_000 * tf) // (1000 * tf + K1_X8 * m[docs]))
    return Lists(terms, starts, docs, adds, np.maximum.reduceat(adds, starts[:-1]) if len(terms) else adds, len(lengths))


def best_of(lists: Lists, wanted: np.ndarray, k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the shard, among them all that are of its ``k`` best and score ``beat`` or more.

    ``wanted``: the places of a query's terms in the vocabulary.
    """
    at = np.flatnonzero(np.isin(lists.terms, wanted) & (lists.bounds > 0))
    at = at[np.argsort(-lists.bounds[at], kind="stable")]
    # What the lists from here on can add up to; lists whose rest cannot reach the score to beat are not essential.
    rest = np.append(np.cumsum(lists.bounds[at][::-1])[::-1], 0)
    score = np.zeros(lists.n_docs, np.int64)
    i = 0
    while i < len(at) and rest[i] >= beat:
        part = slice(lists.starts[at[i]], lists.starts[at[i] + 1])
        score[lists.docs[part]] += lists.adds[part]
        i += 1
        if i & (i - 1) == 0:
            beat = max(beat, _kth(score[score > 0], k))
    candidates = np.flatnonzero(score)
    for j in range(i, len(at)):
        mine = score[candidates]
        beat = max(beat, _kth(mine, k))
        candidates = candidates[mine + rest[j] >= beat]
        if not len(candidates):
            break
        part = slice(lists.starts[at[j]], lists.starts[at[j] + 1])
        docs = lists.docs[part]
        place = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
        met = docs[place] == candidates
        score[candidates[met]] += lists.adds[part][place[met]]
    mine = score[candidates]
    enough = mine >= max(beat, _kth(mine, k), 1)
    return candidates[enough], mine[enough]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th highest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


_LAST = np.iinfo(np.int64).max


def _search(index: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The ``k`` best documents of each item within each task: (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Scores, ids (null as the last), and whether the id is null, best first.
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0)[r].values
                lists = lists_of(*[batch.column(c)[r].values.to_numpy() for c in range(1, 6)], weights, n_docs, n_terms)
                key, none = ids.fill_null(_LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                for q, (_, wanted) in enumerate(items):
                    scores, keys, nones = best[q]
                    docs, found = best_of(lists, wanted, k, int(scores[-1]) if len(scores) == k else 0)
                    if len(docs):
                        scores, keys, nones = np.append(scores, found), np.append(keys, key[docs]), np.append(nones, none[docs])
                        order = np.lexsort((nones, keys, -scores))[:k]
                        best[q] = scores[order], keys[order], nones[order]
        for lo in range(0, len(items), 1000):
            part = best[lo : lo + 1000]
            item = [i for (i, _), (s, *_) in zip(items[lo : lo + 1000], part, strict=True) for _ in s]
            scores, keys, nones = (np.concatenate([p[c] for p in part]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(keys, mask=nones), pa.array(scores)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", id: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each query; ties by ascending id, null last.

    Scores are whole numbers: with N documents that have terms and L terms in them, a term's
    weight is floor(1000 ln((2 N + 2) / (2 df + 1))), and a document of n terms, tf of them this
    one, gets weight * (10^9 tf div (1000 tf + 8 m)) for it, m = 10 + 90 n N div L.  Queries are
    taken in blocks of some ``TERMS_A_PASS`` terms, each with one pass over the texts; a
    query without terms, or whose terms no document has, has no rows, nor has an empty table.
    """
    asked = table(query_terms(queries, text, query_id))
    n_blocks = max(1, -(-asked.count() // TERMS_A_PASS))
    out = None
    for b in range(n_blocks):
        block = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)
        some = _block(docs, block, k, text, id)
        out = some if out is None else out.unionByName(some)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(query_id), "rank", "doc_id", "score")


def _block(docs: DataFrame, asked: DataFrame, k: int, text: str, id: str) -> DataFrame:
    rows = asked.groupBy("item").agg(F.collect_list("term").alias("terms")).orderBy("item").collect()
    vocabulary = sorted({t for r in rows for t in r.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    items = [(r.item, np.sort(np.array([place[t] for t in r.terms], np.int64))) for r in rows]
    index = table(shards(docs, vocabulary, text, id), compression="zstd")
    whole = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("l")).first()
    sizes = F.transform(F.col("ends"), lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    held = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), sizes.alias("df"))).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weighed = held.select("term", F.floor(F.log((2 * F.lit(whole.n) + 2) / (2 * F.col("df") + 1)) * 1000).cast("long").alias("w")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in weighed:
        weights[r.term] = r.w
    return cut(_search(index, items, weights, whole.n, max(whole.l, 1), k))
