"""Language identification by a convolutional network on bytes.

A text in lower case is cut into windows of equal length that overlap by the
widest filter.  Filters of several widths slide over the bytes of a window, each
keeps its highest value (max pooling), and a softmax over these names the
language.  Bytes come one-hot, so a filter is a table of one number for each
offset and byte: a convolution is a sum of looked-up rows, and its gradient
touches only the bytes under each filter's best place.  All of it is numpy:
training on a bounded sample of labelled texts, prediction in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh
from .words import groups

#: Bytes of a window, and how many filters there are of each width.
WINDOW = 96
WIDTHS, FILTERS = (2, 3, 4), 16
STRIDE = WINDOW - max(WIDTHS) + 1
#: Labelled texts of each language that training takes at most, and windows of each, evenly spread over the whole text.
PER_LANGUAGE, WINDOWS_A_TEXT = 400, 12
#: Parts of a language whose smallest hashes are found side by side.
SAMPLE_PARTS = 32
EPOCHS, STEPS, BATCH, RATE = 6, 300, 64, 0.01
UNKNOWN = "und"
#: Texts are read in slices of about so many bytes, and windows scored so many at a time.
SCORED_BYTES, SCORED_WINDOWS = 1 << 20, 256
_f = np.float32


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bytes): the windows of all texts, one row of ``WINDOW`` bytes each, zeros after the end.

    Every run of bytes as long as the widest filter lies whole in one window; an
    empty text has one empty window.
    """
    lower = pc.utf8_lower(texts.cast(pa.string()))
    ends = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    data = np.frombuffer(lower.buffers()[2], np.uint8) if lower.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(ends)
    count = np.where(size <= WINDOW, 1, 1 + -(-(size - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(size)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[ends[text] + first]
    left = size[text] - first
    short = np.flatnonzero(left < WINDOW)
    rows[short] *= np.arange(WINDOW) < left[short, None]
    return text, rows


@dataclass
class Network:
    languages: list[str]
    p: dict[str, np.ndarray]


def pooled(p: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest value of every filter in each window, not below 0, and its place."""
    values, at = [], []
    for w in WIDTHS:
        table = p[f"w{w}"]
        n = WINDOW - w + 1
        x = table[0][rows[:, :n]]
        for j in range(1, w):
            x += table[j][rows[:, j : j + n]]
        best = x.argmax(axis=1)
        at.append(best)
        values.append(np.take_along_axis(x, best[:, None], axis=1)[:, 0])
    return np.maximum(np.concatenate(values, axis=1) + p["b"], 0), np.concatenate(at, axis=1)


def paired(p: dict[str, np.ndarray]) -> list[list[np.ndarray]]:
    """Tables for :func:`probabilities`, by width: one for each two bytes of a filter, and one for the last byte of an odd width."""
    out = []
    for w in WIDTHS:
        table = p[f"w{w}"]
        pairs = [(table[j][:, None, :] + table[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
        out.append(pairs + [table[w - 1]] * (w % 2))
    return out


def probabilities(p: dict[str, np.ndarray], tables: list[list[np.ndarray]], rows: np.ndarray) -> np.ndarray:
    """Softmax over the languages for each window; the same sums as in :func:`pooled`, looked up two bytes at a time."""
    single = rows.astype(np.intp)
    double = single[:, :-1] * 256 + single[:, 1:]
    values = []
    for w, parts in zip(WIDTHS, tables, strict=True):
        n = WINDOW - w + 1
        x = parts[0].take(double[:, :n], axis=0)
        for k, part in enumerate(parts[1:], 1):
            x += part.take((double if len(part) > 256 else single)[:, 2 * k : 2 * k + n], axis=0)
        values.append(x.max(axis=1))
    z = np.maximum(np.concatenate(values, axis=1) + p["b"], 0) @ p["out"] + p["bias"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def gradients(p: dict[str, np.ndarray], rows: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the mean log loss, and the loss."""
    h, at = pooled(p, rows)
    z = h @ p["out"] + p["bias"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    q = z / z.sum(axis=1, keepdims=True)
    loss = float(-np.log(q[np.arange(len(q)), labels] + 1e-9).mean())
    d = q.copy()
    d[np.arange(len(q)), labels] -= 1
    d /= len(q)
    g = {"out": h.T @ d, "bias": d.sum(axis=0)}
    d_h = (d @ p["out"].T) * (h > 0)
    g["b"] = d_h.sum(axis=0)
    filters = np.arange(FILTERS)
    for i, w in enumerate(WIDTHS):
        mine = d_h[:, i * FILTERS : (i + 1) * FILTERS]
        best = at[:, i * FILTERS : (i + 1) * FILTERS]
        g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
        for j in range(w):
            np.add.at(g[f"w{w}"][j], (np.take_along_axis(rows, best + j, axis=1), filters), mine)
    return g, loss


def train(texts: list[str], labels: list[str], seed: int = 11) -> Network:
    """Fits the network to labelled texts, each of which is at most a window long once cut; without texts it knows no language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    p = {f"w{w}": rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)) for w in WIDTHS}
    p |= {"b": np.zeros(len(WIDTHS) * FILTERS), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "bias": np.zeros(len(languages))}
    p = {k: v.astype(_f) for k, v in p.items()}
    if len(languages) < 2:
        return Network(languages, p)
    owner, rows = windows(pa.array(texts, pa.string()))
    y = np.searchsorted(languages, labels)[owner]
    # A language is seen as often as any other, however few texts it has.
    share = np.bincount(y, minlength=len(languages))
    chance = 1 / share[y] / len(languages)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, max(STEPS, EPOCHS * len(rows) // BATCH) + 1):
        some = rng.choice(len(rows), BATCH, p=chance)
        x = rows[some]
        # Half of what is seen is cut short, as many texts are.
        left = np.where(rng.random(BATCH) < 0.5, WINDOW, np.exp(rng.uniform(np.log(4), np.log(WINDOW), BATCH)).astype(int))
        g, _ = gradients(p, x * (np.arange(WINDOW) < left[:, None]).astype(np.uint8), y[some])
        for k, v in p.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            s += 0.001 * (g[k] ** 2 - s)
            v -= _f(RATE) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + _f(1e-6))
    return Network(languages, p)


def predict_texts(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place in the languages, score) of each text: the language of highest mean probability over all its windows."""
    best, score, tables = np.zeros(len(texts), np.int64), np.zeros(len(texts)), paired(net.p)
    for lo, part in groups(texts, SCORED_BYTES):
        owner, rows = windows(part)
        q = np.concatenate([probabilities(net.p, tables, rows[a : a + SCORED_WINDOWS]) for a in range(0, len(rows), SCORED_WINDOWS)])
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        mean = np.add.reduceat(q, starts, axis=0) / np.diff(np.append(starts, len(owner)))[:, None]
        best[lo : lo + len(part)], score[lo : lo + len(part)] = mean.argmax(axis=1), mean.max(axis=1)
    return best, np.clip(score, 0, 1)


def sample(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows (lang, piece) to learn from: windows of at most ``per_language`` different texts of each language among the rows for which ``use`` holds.

    Of each language the texts with a letter of smallest hash are taken; what picks them is
    exchanged without the texts.  Null languages and texts give nothing.
    """
    known = docs.filter(use & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text, lang).alias("key"), F.col(text).alias("body"))
    # The smallest of each of some parts of a language, then of all of it, so that no task has more rows of one than these.
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("key"))
    keys = known.select("lang", "key", F.pmod("key", F.lit(SAMPLE_PARTS)).alias("part")).distinct()
    least = keys.withColumn("rank", rank("part")).filter(F.col("rank") <= per_language)
    picked = cut(least.withColumn("rank", rank()).filter(F.col("rank") <= per_language).select("lang", "key"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in groups(batch.column(2)):
                lower = [t.encode() for t in pc.utf8_lower(part).to_pylist()]
                rows = []
                for i, t in enumerate(lower):
                    n = min(WINDOWS_A_TEXT, 1 + max(0, len(t) - WINDOW) // STRIDE)
                    at = np.linspace(0, max(0, len(t) - WINDOW), n).astype(int)
                    rows += [(lo + i, t[a : a + WINDOW].decode("utf-8", "ignore")) for a in at]
                own = pa.array([i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array([t for _, t in rows], pa.string())], names=["lang", "key", "piece"])

    # At most ``per_language`` keys of each language: what is broadcast depends on the languages alone.
    found = known.join(F.broadcast(picked), ["lang", "key"]).select("lang", "key", "body").mapInArrow(pieces, "lang string, key long, piece string")
    return found.distinct().select("lang", "piece")


def fit(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Network:
    """Trains on the bounded sample, in one task; only the parameters come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if y is not None)
        net = train([t for _, t in rows], [y for y, _ in rows])
        names = list(net.p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([list(net.p[k].shape) for k in names], pa.list_(pa.int64())), pa.array([net.p[k].astype(_f).tobytes() for k in names], pa.binary()), pa.array([net.languages if k == "bias" else [] for k in names], pa.list_(pa.string()))],
            names=["name", "shape", "data", "languages"],
        )

    one_more = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("piece"))  # an empty sample trains as well
    rows = sample(docs, use, text, lang, per_language).union(one_more).repartition(1).mapInArrow(run, "name string, shape array<long>, data binary, languages array<string>").collect()
    return Network(next(list(r["languages"]) for r in rows if r["name"] == "bias"), {r["name"]: np.frombuffer(bytes(r["data"]), _f).reshape(r["shape"]).copy() for r in rows})


def identify(df: DataFrame, net: Network, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``df`` plus, under ``names``, the language and its mean probability over all windows of the text.

    A null text and one without a letter are ``und`` with score 0, as are all texts if nothing
    was learned.  Columns with these names are replaced.
    """
    languages = pa.array(net.languages, pa.string())

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        best, score = predict_texts(net, texts)
        return pa.StructArray.from_arrays([languages.take(pa.array(best)), pa.array(score)], names=["lang", "score"])

    df = df.drop(*names)
    said = fresh(df, "said")[0]
    has = F.col(text).rlike(r"\p{L}") if net.languages else F.lit(False)
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    found = df.withColumn(said, F.when(has, run(F.col(text))) if net.languages else none)
    return found.withColumns({names[0]: F.coalesce(F.col(said)["lang"], F.lit(UNKNOWN)), names[1]: F.coalesce(F.col(said)["score"], F.lit(0.0))}).drop(said)
