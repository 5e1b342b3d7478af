"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word's input joins its own vector (words seen often enough in training) and
the mean vector of its hashed character trigrams (any word).  The network reads
overlapping windows of words in both directions, attention weighs its states,
and a text scores as its most toxic window.  Labels belong to whole texts, so
training takes, in each epoch, the windows that score highest now.  All of it
is numpy: training on a bounded sample of labelled texts, scoring in the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .words import coded_words, groups

WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
CHAR_BUCKETS = 8192
MIN_TEXTS = 4
MARKS = ".,;:!?\"'()[]{}<>*%$&#|/\\_-+=~`…"
#: Labelled texts of each label that training takes at most, each of them whole.
SAMPLE = 1000
#: Epochs, more of them if they have few steps.
EPOCHS, STEPS = 6, 250
BATCH = 128
#: Pull of the vectors of words and trigrams to zero.
DECAY = 1e-4
THRESHOLD = 0.7
#: Texts are scored in groups of about so many bytes.
SCORED_BYTES = 1 << 20
_f = np.float32


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """As :func:`coded_words`, in lower case and without marks at either end."""
    codes, distinct, offsets = coded_words(texts)
    clean = pc.utf8_trim(pc.utf8_lower(distinct), characters=MARKS).dictionary_encode()
    return clean.indices.to_numpy(zero_copy_only=False)[codes] if len(distinct) else codes, clean.dictionary, offsets


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): buckets of the byte trigrams of ``^word$``, word after word."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(size + 2)[:-1]]) if len(size) else np.zeros(0, np.int64)
    joined = pc.binary_join_element_wise(pa.scalar(b"^"), words.cast(pa.binary()), pa.scalar(b"$"), pa.scalar(b""))
    codes = np.frombuffer(b"".join(joined.to_pylist()), np.uint8).astype(np.uint32)
    h = codes * np.uint32(0x9E3779B1)
    h[:-1] += codes[1:] * np.uint32(0x85EBCA6B)
    h[:-2] += codes[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    keep = np.ones(len(codes), bool)
    ends = starts + size + 2
    keep[ends - 1] = False
    keep[(ends - 2)[size > 0]] = False
    return (h >> np.uint32(19)).astype(np.int64)[keep], np.concatenate([[0], np.cumsum(np.maximum(size, 1))[:-1]]) if len(size) else starts


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each window; neighbours overlap and every word is in one at least; a text without words has one empty window."""
    n = np.diff(offsets)
    count = np.where(n <= WINDOW, 1, 1 + -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[text] + k * STRIDE
    return text, first, np.minimum(WINDOW, offsets[text + 1] - first)


@dataclass
class Network:
    vocabulary: pa.Array
    p: dict[str, np.ndarray]

    def inputs(self, distinct: pa.Array, part: int = 16_384) -> np.ndarray:
        """The input vector of each distinct word, and last that of no word."""
        x = np.zeros((len(distinct) + 1, WORD_DIM + CHAR_DIM), _f)
        for lo in range(0, len(distinct), part):
            words = distinct.slice(lo, part)
            place = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), len(self.vocabulary)).to_numpy(zero_copy_only=False)
            buckets, starts = trigrams(words)
            x[lo : lo + len(words), :WORD_DIM] = self.p["word"][place]
            x[lo : lo + len(words), WORD_DIM:] = np.add.reduceat(self.p["char"][buckets], starts, axis=0) / np.diff(np.append(starts, len(buckets)))[:, None]
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _project(p: dict[str, np.ndarray], table: np.ndarray, side: str) -> np.ndarray:
    """Projected inputs; gates are halved, for a sigmoid by tanh, and the row of no word closes the update gate, which keeps the state."""
    x = table @ p["w_" + side] + p["b_" + side]
    x[:, : 2 * HIDDEN] *= _f(0.5)
    x[-1, :HIDDEN] = -40
    return x


def _gru(x: np.ndarray, ids: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [T, H, B] of a gated recurrent layer; ``ids`` [T, B] are rows of the projected inputs ``x``."""
    t, b = ids.shape
    u_g, u_c = np.ascontiguousarray(u[:, : 2 * HIDDEN].T) * _f(0.5), np.ascontiguousarray(u[:, 2 * HIDDEN :].T)
    h = np.zeros((HIDDEN, b), _f)
    out = np.empty((t, HIDDEN, b), _f)
    for i in range(t):
        xi = np.ascontiguousarray(x.take(ids[i], axis=0).T)
        gates = u_g @ h
        gates += xi[: 2 * HIDDEN]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= _f(0.5)
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        c = u_c @ (r * h)
        c += xi[2 * HIDDEN :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((h, z, r, c))
        new = c - h
        new *= z
        new += h
        out[i] = h = new
    return out


def forward(p: dict[str, np.ndarray], table: np.ndarray, ids: np.ndarray, keep: dict | None = None, projected: tuple | None = None) -> np.ndarray:
    """Logits of windows; ``ids`` [B, T] are rows of ``table``, the last row where there is no word."""
    ids = np.ascontiguousarray(ids.T)
    x_f, x_b = projected or (_project(p, table, "f"), _project(p, table, "b"))
    traces: tuple[list, list] | tuple[None, None] = ([], []) if keep is not None else (None, None)
    ahead = _gru(x_f, ids, p["u_f"], traces[0])
    back = _gru(x_b, ids[::-1], p["u_b"], traces[1])[::-1]
    a = np.matmul(p["att"][:HIDDEN], ahead) + np.matmul(p["att"][HIDDEN:], back)
    a -= (ids == len(x_f) - 1) * _f(1e4)
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    pooled = [np.einsum("tb,thb->hb", a, s) for s in (ahead, back)]
    if keep is not None:
        keep.update(ids=ids, traces=traces, ahead=ahead, back=back, a=a, pooled=pooled)
    return p["out"][:HIDDEN] @ pooled[0] + p["out"][HIDDEN:] @ pooled[1] + p["bias"][0]


def _scatter(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows that go to each of n places."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _gru_back(d_out: np.ndarray, trace: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs [T, 3H, B] (before halving) and of ``u``."""
    t, _, b = d_out.shape
    d_xw, d_u, d_h = np.zeros((t, 3 * HIDDEN, b), _f), np.zeros_like(u), np.zeros((HIDDEN, b), _f)
    for i in reversed(range(t)):
        h, z, r, c = trace[i]
        d = d_out[i] + d_h
        d_c = d * z * (1 - c * c)
        d_rh = u[:, 2 * HIDDEN :] @ d_c
        d_xw[i, :HIDDEN], d_xw[i, HIDDEN : 2 * HIDDEN], d_xw[i, 2 * HIDDEN :] = d * (c - h) * z * (1 - z), d_rh * h * r * (1 - r), d_c
        d_u[:, : 2 * HIDDEN] += h @ d_xw[i, : 2 * HIDDEN].T
        d_u[:, 2 * HIDDEN :] += (r * h) @ d_c.T
        d_h = d * (1 - z) + d_rh * r + u[:, : 2 * HIDDEN] @ d_xw[i, : 2 * HIDDEN]
    return d_xw, d_u


def gradients(p: dict[str, np.ndarray], table: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean log loss by parameter and by row of ``table``, and the loss."""
    k: dict = {}
    q = _sigmoid(forward(p, table, ids, k))
    d = ((q - labels) / len(labels)).astype(_f)
    g = {"out": np.concatenate([x @ d for x in k["pooled"]]), "bias": np.array([d.sum()], _f)}
    sides = (("f", k["ahead"], p["out"][:HIDDEN], p["att"][:HIDDEN]), ("b", k["back"], p["out"][HIDDEN:], p["att"][HIDDEN:]))
    d_a = sum(np.matmul(o, s) for _, s, o, _ in sides) * d
    d_s = k["a"] * (d_a - (k["a"] * d_a).sum(axis=0))
    g["att"] = np.concatenate([np.einsum("tb,thb->h", d_s, s) for _, s, _, _ in sides])
    rows = np.zeros_like(table)
    for n, (side, _, o, att) in enumerate(sides):
        d_state = k["a"][:, None, :] * (o[:, None] * d)[None] + d_s[:, None, :] * att[None, :, None]
        at = k["ids"] if n == 0 else k["ids"][::-1]
        d_xw, g["u_" + side] = _gru_back(d_state if n == 0 else d_state[::-1], k["traces"][n], p["u_" + side])
        d_table = _scatter(len(table), at.ravel(), d_xw.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
        d_table[-1] = 0
        g["w_" + side], g["b_" + side] = table.T @ d_table, d_table.sum(axis=0)
        rows += d_table @ p["w_" + side].T
    return g, rows, float(-np.mean(np.where(labels > 0, np.log(q + 1e-9), np.log(1 - q + 1e-9))))


def window_ids(codes: np.ndarray, first: np.ndarray, size: np.ndarray, none: int) -> np.ndarray:
    at = first[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, codes[np.minimum(at, max(len(codes) - 1, 0))] if len(codes) else none, none)


def train(texts: list[str], labels: list[int], seed: int = 5) -> Network:
    """Fits the network to labelled texts (1: toxic).  Without both labels the score is their constant share."""
    rng = np.random.default_rng(seed)
    codes, distinct, offsets = words_of(pa.array(texts, pa.string()))
    y = np.array(labels, _f)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.unique(doc * np.int64(len(distinct) + 1) + codes)
    owner, word = pairs // (len(distinct) + 1), pairs % (len(distinct) + 1)
    n_texts = np.bincount(word, minlength=len(distinct))
    n_toxic = np.bincount(word, weights=y[owner] if len(owner) else None, minlength=len(distinct))
    known = np.flatnonzero(n_texts >= MIN_TEXTS)
    dim = WORD_DIM + CHAR_DIM
    p = {
        "word": rng.normal(0, 0.1, (len(known) + 1, WORD_DIM)), "char": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR_DIM)),
        "w_f": rng.normal(0, 0.3, (dim, 3 * HIDDEN)), "w_b": rng.normal(0, 0.3, (dim, 3 * HIDDEN)), "u_f": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), "u_b": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)),
        "b_f": np.zeros(3 * HIDDEN), "b_b": np.zeros(3 * HIDDEN), "att": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1),
    }
    p = {k: v.astype(_f) for k, v in p.items()}
    net = Network(distinct.take(pa.array(known)), p)
    share = float(y.mean()) if len(y) else 0.0
    p["bias"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
    if share in (0.0, 1.0):
        p["out"][:] = 0
        return net
    # A first guess for one input: how much more often a word's texts are toxic.
    odds = np.log((n_toxic[known] + 1) / (n_texts[known] + 2)) - np.log((y.sum() + 1) / (len(y) + 2))
    p["word"][:-1, 0] = np.clip(odds * np.minimum(1, n_texts[known] / 20), -1, 2)
    held = np.ones(WORD_DIM, _f)
    held[0] = 0
    for side, o in (("w_f", 0), ("w_b", HIDDEN)):
        p[side][0, 2 * HIDDEN] = p["out"][o] = p["att"][o] = 2
    place = np.full(len(distinct), len(known))
    place[known] = np.arange(len(known))
    buckets, starts = trigrams(distinct)
    lengths = np.diff(np.append(starts, len(buckets)))
    text, first, size = windows(offsets)
    ids = window_ids(codes, first, size, len(distinct))
    picked = _hottest(text, np.append(p["word"][place, 0], 0)[ids].max(axis=1), len(texts), 1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(len(picked), 1)))
    for epoch in range(epochs):
        order = rng.permutation(picked)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            used, local = np.unique(np.append(ids[some].ravel(), len(distinct)), return_inverse=True)
            table = np.zeros((len(used), dim), _f)
            real = used[:-1]
            table[:-1, :WORD_DIM] = p["word"][place[real]]
            each = lengths[real]
            begin = np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64)
            flat = np.repeat(starts[real] - begin, each) + np.arange(each.sum())
            if len(real):
                table[:-1, WORD_DIM:] = np.add.reduceat(p["char"][buckets[flat]], begin, axis=0) / each[:, None]
            g, rows, _ = gradients(p, table, local[:-1].reshape(len(some), WINDOW), y[text[some]])
            g["word"] = _scatter(len(p["word"]), place[real], rows[:-1, :WORD_DIM]) + _f(DECAY) * p["word"] * held
            g["char"] = _scatter(CHAR_BUCKETS, buckets[flat], np.repeat(rows[:-1, WORD_DIM:] / each[:, None], each, axis=0)) + _f(DECAY) * p["char"]
            step += 1
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= _f(0.01) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + _f(1e-6))
        if epoch + 1 < epochs and (epoch + 1) % max(1, epochs // EPOCHS) == 0:
            table = net.inputs(distinct)
            logits = _logits(net, table, ids)
            picked = _hottest(text, logits, len(texts), 1)
    return net


def _logits(net: Network, table: np.ndarray, ids: np.ndarray, batch: int = 2048) -> np.ndarray:
    projected = _project(net.p, table, "f"), _project(net.p, table, "b")
    return np.concatenate([forward(net.p, table, ids[a : a + batch], projected=projected) for a in range(0, len(ids), batch)])


def _hottest(text: np.ndarray, value: np.ndarray, n: int, most: int) -> np.ndarray:
    """The windows of highest value of each text."""
    order = np.lexsort((-value, text))
    rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    return order[rank < most]


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The score of each text, that of its most toxic window; all windows are scored."""
    out = np.zeros(len(texts))
    for lo, part in groups(texts, SCORED_BYTES):
        codes, distinct, offsets = words_of(part)
        table = net.inputs(distinct)
        text, first, size = windows(offsets)
        logit = _logits(net, table, window_ids(codes, first, size, len(distinct)))
        top = np.full(len(part), -np.inf)
        np.maximum.at(top, text, logit)
        out[lo : lo + len(part)] = _sigmoid(top)
    return out


def sample(docs: DataFrame, labels: DataFrame, use: Column, per_label: int = SAMPLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (body, label): whole texts of at most ``per_label`` ids of each label, those of smallest hash among the rows of ``labels`` for which ``use`` holds.

    Ids are picked on the labels alone, so the documents are only read, not exchanged.
    Of labels that disagree the larger counts; nulls and ids without a document give nothing.
    """
    marks = labels.filter(use).select(F.col(id).alias("marked"), F.col("toxic").alias("label")).dropna().groupBy("marked").agg(F.max("label").alias("label"))
    first = [marks.filter(F.col("label") == y).orderBy(F.xxhash64("marked"), "marked").limit(per_label) for y in (0, 1)]
    texts = docs.select(F.col(id).alias("named"), F.col(text).alias("body"))
    return texts.join(F.broadcast(first[0].union(first[1])), F.col("named") == F.col("marked")).select(F.coalesce("body", F.lit("")).alias("body"), F.col("label").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, use: Column, per_label: int = SAMPLE) -> Network:
    """Trains on the bounded sample, in one task; only the parameters come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if y is not None)
        net = train([t for _, t in rows], [y for y, _ in rows])
        names = list(net.p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([list(net.p[k].shape) for k in names], pa.list_(pa.int64())), pa.array([net.p[k].tobytes() for k in names], pa.binary()), pa.array([net.vocabulary.to_pylist() if k == "word" else [] for k in names], pa.list_(pa.string()))],
            names=["name", "shape", "data", "words"],
        )

    text_batches(docs.sparkSession)
    found = sample(docs, labels, use, per_label)
    one_more = found.sparkSession.range(1).select(F.lit(None).cast("string").alias("body"), F.lit(None).cast("int").alias("label"))  # an empty sample trains as well
    rows = found.union(one_more).repartition(1).mapInArrow(run, "name string, shape array<long>, data binary, words array<string>").collect()
    return Network(pa.array(next(r["words"] for r in rows if r["name"] == "word"), pa.string()), {r["name"]: np.frombuffer(bytes(r["data"]), _f).reshape(r["shape"]).copy() for r in rows})


def score(df: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All rows and columns of ``df`` plus, under ``names``, the score (0 to 1) and the prediction (1 from ``threshold`` on).

    Null and empty texts score as an empty window.  Columns with these names are replaced.
    """

    text_batches(df.sparkSession)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(net, texts))

    return df.drop(*names).withColumn(names[0], run(F.col(text))).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
