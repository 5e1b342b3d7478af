"""Scores of a Brown class-based bigram model.

    P(word | previous word) = P(class | previous class) * P(unit | class) * P(word | unit)

Units are what exchange clustering sorts into classes: every word that occurs often
enough in training is one (the most frequent ``OWN_UNITS`` if there are more), and the
rarer words share units by their last three characters, so that every word has a class.
Clustering moves units to the class that raises the likelihood of the class bigrams
most, over and over, until that gains little.  Tasks hold a part of the units each, with all
their neighbours; only classes and counts of class bigrams, of bounded size, go to and fro.
Word counts cover all training text and stay in a distributed table; texts look
up their rarer words there by a join, the ``HEAD`` most frequent ones locally.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, table, text_batches
from .words import coded_words, groups

#: Words whose counts are sent to all tasks (a bound, whatever the corpus); the others are joined.
HEAD = 1 << 17
#: A word is a unit of its own from so many occurrences on, up to so many words; the classes go to all tasks.
OWN_COUNT, OWN_UNITS = 8, 1 << 13
#: Units that the other words share.
ENDING_UNITS = 512
#: Sweeps of the clustering at most; it ends when one gains less than this share of the likelihood.
ROUNDS, LEAST_GAIN = 14, 1e-4
#: Weight of the class unigram in a class transition, in counts.
PRIOR = 4.0
#: Different bigrams that a task holds before it sends them on.
HELD = 1_000_000
#: Neighbours that a task looks at at a time.
LOOKED_AT = 500_000


def class_number(units: int) -> int:
    """More classes for more units: 27 where none is a word's own, 62 for 8,192 words."""
    return 16 + math.isqrt(units) // 2


def _lowered(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    return coded_words(pc.ascii_lower(texts))


def units_of(distinct: pa.Array, own: pa.Array) -> np.ndarray:
    """The unit of each word: its place in ``own``, or from ``len(own)`` on the one of its ending."""
    unit = pc.fill_null(pc.index_in(distinct, value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rest = np.flatnonzero(unit < 0)
    if len(rest):
        endings = pc.utf8_slice_codeunits(distinct.take(pa.array(rest)), -3).dictionary_encode()
        to = np.array([len(own) + zlib.crc32(e.encode()) % ENDING_UNITS for e in endings.dictionary.to_pylist()], np.int64)
        unit[rest] = to[endings.indices.to_numpy(zero_copy_only=False)]
    return unit


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, n) over all of ``texts`` (one column, text); null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in groups(batch.column(0)):
                codes, distinct, _ = _lowered(part)
                n = np.bincount(codes, minlength=len(distinct))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(some)).cast(pa.string()), pa.array(n[some])], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)


def unit_bigrams(texts: DataFrame, own: pa.Array) -> DataFrame:
    """Rows (a, b, n): how often unit b follows unit a; unit ``len(own) + ENDING_UNITS`` stands before and after each text."""
    end = len(own) + ENDING_UNITS
    m = end + 1

    def rows(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(code), 100_000):
            c = code[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((c // m).astype(np.int32)), pa.array((c % m).astype(np.int32)), pa.array(n[lo : lo + 100_000])], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for _, part in groups(batch.column(0)):
                word, distinct, offsets = _lowered(part)
                unit = units_of(distinct, own)[word] if len(distinct) else np.zeros(0, np.int64)
                seq = np.concatenate([[end], np.insert(unit, offsets[1:], end)])
                code, n = np.unique(seq[:-1] * m + seq[1:], return_counts=True)
                codes.append(code), counts.append(n)
                if sum(map(len, codes)) > 2 * HELD:
                    code, n = _added(codes, counts)
                    codes, counts = [code], [n]
                    if len(code) > HELD:
                        yield from rows(code, n)
                        codes, counts = [], []
        if codes:
            yield from rows(*_added(codes, counts))

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def neighbours(bigrams: DataFrame) -> DataFrame:
    """One row (unit, after, before) for each unit, with arrays of (unit, n) as long as there are units at most."""
    both = bigrams.select(F.col("a").alias("unit"), F.lit(True).alias("ahead"), F.struct(F.col("b").alias("u"), "n").alias("x")).union(bigrams.select("b", F.lit(False), F.struct(F.col("a").alias("u"), "n")))
    pick = lambda ahead: F.collect_list(F.when(F.col("ahead") == ahead, F.col("x")))
    return both.groupBy("unit").agg(pick(True).alias("after"), pick(False).alias("before"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of :func:`neighbours` in slices of about ``LOOKED_AT`` neighbours."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LOOKED_AT, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _contexts(column: pa.Array, of: np.ndarray, k: int) -> np.ndarray:
    """Counts (row, class) of the neighbours in a column of arrays of (unit, n)."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(row * k + of[flat.field(0).to_numpy()], weights=flat.field(1).to_numpy(), minlength=len(lengths) * k).reshape(len(lengths), k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def gains(after: np.ndarray, before: np.ndarray, mine: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the likelihood gains, up to a constant a row, if the unit of each row goes to each class; it is taken out of its class first.

    Exact but for a unit that follows itself.
    """
    k = len(c) - 1
    both = np.hstack([after, before])
    have = np.hstack([c[:k], c[:, :k].T])
    out = np.zeros((len(both), k))
    for lo in range(0, len(both), 2048):
        u, x = np.nonzero(both[lo : lo + 2048])
        own = mine[lo + u]
        n = both[lo + u, x]
        of = x % (k + 1)
        held = have[:, x].T.copy()
        held[np.arange(len(u)), own] -= n
        # Counts of its own class have lost what the unit adds to them from the other side.
        for here, other in ((x <= k, before), (x > k, after)):
            here = here & (of == own)
            held[here] -= other[lo + u[here], :k]
        value = _xlogx(held + n[:, None]) - _xlogx(held)
        inner = np.flatnonzero(of < k)
        value[inner, of[inner]] = 0
        first = np.flatnonzero(np.diff(u, prepend=-1))
        if len(u):
            out[lo + u[first]] = np.add.reduceat(value, first, axis=0)
    inside = np.arange(k) == mine[:, None]
    # A class beside itself gets both sides at once.
    added = after[:, :k] + before[:, :k]
    held = np.diag(c)[:k] - inside * added
    out += _xlogx(held + added) - _xlogx(held)
    for side, total in ((after.sum(1), c.sum(1)[:k]), (before.sum(1), c.sum(0)[:k])):
        held = total - inside * side[:, None]
        out -= _xlogx(held + side[:, None]) - _xlogx(held)
    return out


def exchange(units: DataFrame, n_units: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the counts of class bigrams (the last class stands for the end of a text).

    ``units``: :func:`neighbours`, stored.  Each round counts the class bigrams, then moves a
    half of the units, taken in turn, to their best class; the best assignment met is returned.
    """
    k = class_number(n_units)
    of = np.append(np.arange(n_units) % k, k)
    best, last = (-np.inf, of, np.zeros((k + 1, k + 1))), None
    for r in range(rounds + 1):

        def count(batches: Iterator[pa.RecordBatch], of: np.ndarray = of) -> Iterator[pa.RecordBatch]:
            c = np.zeros((k + 1, k + 1))
            for batch in _pieces(batches):
                np.add.at(c, of[batch.column(0).to_numpy()], _contexts(batch.column(1), of, k + 1))
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c.ravel()[at].astype(np.int64))], names=["at", "n"])

        c = np.zeros((k + 1) ** 2)
        for b in units.select("unit", "after").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():
            c[b.column(0).to_numpy()] = b.column(1).to_numpy()
        c = c.reshape(k + 1, k + 1)
        likelihood = _xlogx(c).sum() - _xlogx(c.sum(1)).sum() - _xlogx(c.sum(0)).sum()
        if likelihood > best[0]:
            best = (likelihood, of.copy(), c)
        if r == rounds or (last is not None and r > 3 and likelihood - last < LEAST_GAIN * abs(likelihood)):
            break
        last = likelihood

        def move(batches: Iterator[pa.RecordBatch], of: np.ndarray = of, c: np.ndarray = c, r: int = r) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                unit = batch.column(0).to_numpy()
                moving = np.flatnonzero((unit < n_units) & ((unit.astype(np.int64) * 2654435761 >> 7) % 2 == r % 2))
                some = batch.take(pa.array(moving))
                unit = unit[moving]
                to = gains(_contexts(some.column(1), of, k + 1), _contexts(some.column(2), of, k + 1), of[unit], c).argmax(1) if len(unit) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(to.astype(np.int32))], names=["unit", "to"])

        of = of.copy()
        for b in units.mapInArrow(move, "unit int, to int").toArrow().to_batches():
            of[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return best[1], best[2]


@dataclass
class Model:
    """What tasks need to score texts; its size doesn't grow with the corpus."""

    head: pa.Array
    head_n: np.ndarray
    own: pa.Array  # the first of ``head``, which are units of their own
    tokens: int
    types: int
    documents: int
    unit_class: np.ndarray
    transition: np.ndarray  # log10 P(class | previous class)
    unit: np.ndarray  # log10 P(unit | class) and, for shared units, less log10 of the counts and types they hold


def most_frequent(counts: DataFrame, most: int = HEAD, bins: int = 1024) -> DataFrame:
    """The ``most`` most frequent words of ``counts`` (word, n), of equally frequent ones those of greater hash.

    The least of them is found by histograms over ever smaller ranges, so that no task gathers
    candidates.  Words alike in count and in 20 bits of their hash are all left out where they don't all fit.
    """
    key = F.col("n") * (1 << 20) + F.xxhash64("word").bitwiseAND(F.lit((1 << 20) - 1))
    keyed = counts.withColumn("key", key)
    top = keyed.agg(F.max("key").alias("top"), F.count("*").alias("words")).first()
    if top.words <= most:
        return counts
    lo, hi, left = 0, top.top + 1, most  # all from ``hi`` on are taken, none below ``lo``
    while left and lo < hi:
        step = -(-(hi - lo) // bins)
        found = keyed.filter(F.col("key").between(lo, hi - 1)).groupBy(F.call_function("div", F.col("key") - lo, F.lit(step)).alias("bin")).count().collect()
        start, end = lo, hi
        lo = hi
        for r in sorted(found, key=lambda r: -r.bin):
            if r["count"] > left:
                lo, hi = start + r.bin * step, min(end, start + (r.bin + 1) * step)
                break
            left -= r["count"]
            hi = start + r.bin * step
        else:
            break
        if step == 1:
            break
    return keyed.filter(F.col("key") >= hi).select("word", "n")


def fit(counts: DataFrame, texts: DataFrame, head: int = HEAD) -> Model:
    """``counts``: :func:`word_counts` of ``texts``, as a stored table; ``head``: how many words tasks know themselves."""
    top = most_frequent(counts, head).orderBy(F.desc("n"), "word").toArrow()
    words, head_n = pa.concat_arrays(top.column(0).chunks or [pa.array([], pa.string())]), top.column(1).to_numpy()
    own = words.slice(0, min(OWN_UNITS, int((head_n >= OWN_COUNT).sum())))
    n_units = len(own) + ENDING_UNITS
    spread = max(parallelism(texts.sparkSession), n_units // 256)
    of, c = exchange(table(neighbours(unit_bigrams(texts, own)).repartition(spread, "unit")), n_units)
    k = len(c) - 1

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units_of(batch.column(0), own)
            n = np.bincount(unit, weights=batch.column(1).to_numpy(), minlength=n_units).astype(np.int64)
            types = np.bincount(unit, minlength=n_units)
            some = np.flatnonzero(types)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(types[some])], names=["unit", "n", "types"])

    unit_n, unit_types = np.zeros(n_units), np.zeros(n_units)
    for r in counts.select("word", "n").mapInArrow(held, "unit long, n long, types long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toArrow().to_batches():
        unit_n[r.column(0).to_numpy()], unit_types[r.column(0).to_numpy()] = r.column(1).to_numpy(), r.column(2).to_numpy()
    documents = int(c[:, k].sum())
    share = (c.sum(0) + 1e-9 + 1) / (c.sum() + 1e-9 * (k + 1) + k + 1)
    transition = np.log10((c + PRIOR * share) / (c.sum(1, keepdims=True) + PRIOR))
    # Half a count more for each unit, so that a shared unit not seen in training has some weight too.
    members = np.bincount(of[:n_units], minlength=k)
    unit = np.log10((unit_n + 0.5) / (np.bincount(of[:n_units], weights=unit_n, minlength=k) + 0.5 * members)[of[:n_units]])
    shared = np.arange(n_units) >= len(own)
    unit -= np.where(shared, np.log10(unit_n + unit_types + 1), 0)
    return Model(words, head_n, own, int(unit_n.sum()) + documents, int(unit_types.sum()) + (documents > 0), documents, of, transition, np.append(unit, 0.0))


def _local(model: Model, docs: DataFrame) -> DataFrame:
    """What a text's score has without its rarer words, and these words with their numbers."""
    log_head = np.log10(model.head_n + 1.0)
    own, n_own = model.own, len(model.own)
    end = n_own + ENDING_UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in groups(batch.column(2)):
                codes, distinct, offsets = _lowered(part)
                d = len(part)
                doc = np.repeat(np.arange(d), np.diff(offsets))
                place = pc.fill_null(pc.index_in(distinct, value_set=model.head), -1).to_numpy(zero_copy_only=False)
                unit_of_word = units_of(distinct, own) if len(distinct) else np.zeros(0, np.int64)
                unit = unit_of_word[codes]
                log_word = np.where(place >= 0, log_head[np.maximum(place, 0)] if len(log_head) else 0.0, 0.0)
                sums = lambda x: np.bincount(doc, weights=x, minlength=d).astype(np.float64)
                base = sums(log_word[codes])
                known = sums((place >= 0)[codes])
                seq = np.concatenate([[end], np.insert(unit, offsets[1:], end)])
                cls = model.unit_class[seq]
                step = model.transition[cls[:-1], cls[1:]] + model.unit[seq[1:]]
                # Step j leads to token j of the text, the last one to its end.
                fixed = np.bincount(np.repeat(np.arange(d), np.diff(offsets) + 1), weights=step, minlength=d)
                fixed += sums(np.where(unit_of_word >= n_own, log_word, 0.0)[codes])
                rare = np.flatnonzero(place[codes] < 0)
                pairs, times = np.unique(doc[rare] * np.int64(len(distinct) + 1) + codes[rare], return_counts=True)
                owner, word = pairs // (len(distinct) + 1), pairs % (len(distinct) + 1)
                bounds = np.searchsorted(owner, np.arange(d + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, d), batch.column(1).slice(lo, d), pa.array(np.diff(offsets) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(fixed),
                        pa.ListArray.from_arrays(bounds, distinct.take(pa.array(word)).cast(pa.string())), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                    ],
                    names=["row", "id", "n_tokens", "known", "base", "fixed", "words", "times"],
                )

    return docs.mapInArrow(run, "row long, id long, n_tokens long, known long, base double, fixed double, words array<string>, times array<int>")


def score(df: DataFrame, training: F.Column, text: str = "text", id: str = "doc_id", head: int = HEAD) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score, perplexity), one for each row of ``df``.

    The model learns from the rows for which ``training`` is true.  Scores are log10
    probabilities of the text and its end; a word not in training counts as one more type
    of its unit.  A null text is empty and scores its end alone.  Without any training
    rows all types are unknown.  An empty table gives an empty result.
    """
    text_batches(df.sparkSession)
    texts = df.filter(training).select(F.col(text).alias("text"))
    counts = table(word_counts(texts))
    model = fit(counts, texts, head)
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    local = table(_local(model, docs))
    rare = local.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = (
        rare.join(counts, "word")  # a word not in training adds nothing: its log10(0 + 1) is 0
        .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    end = float(np.log10(model.documents + 1.0))
    per_token = float(np.log10(max(model.tokens, 0) + 1.0 * (model.types + 1)))
    total = F.col("fixed") + more
    return local.select("row", "id", "n_tokens", "known", "base", "fixed").join(found, "row", "left").select(
        "id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(model.documents > 0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + more + F.lit(end) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
