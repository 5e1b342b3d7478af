import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T


def texts(n, seed):
    random.seed(seed)
    plain, bad = [f"word{i}" for i in range(400)], ["vile", "wretch", "scum"]
    out = []
    for i in range(n):
        w = random.choices(plain, k=random.randrange(0, 150))
        if i % 4 == 0:
            for _ in range(2):
                w.insert(random.randrange(len(w) + 1), random.choice(bad) + random.choice(["", ",", "."]))
        out.append((" ".join(w), int(i % 4 == 0)))
    return out


def test_gradients(monkeypatch):
    monkeypatch.setattr(T, "_f", np.float64)
    rng = np.random.default_rng(0)
    h, d = T.HIDDEN, T.WORD_DIM + T.CHAR_DIM
    shapes = {"w_f": (d, 3 * h), "w_b": (d, 3 * h), "u_f": (h, 3 * h), "u_b": (h, 3 * h), "b_f": 3 * h, "b_b": 3 * h, "att": 2 * h, "out": 2 * h, "bias": 1}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    table = rng.normal(0, 1, (6, d))
    table[-1] = 0
    ids, y = rng.integers(0, 6, (5, 7)), np.array([0, 1, 1, 0, 1.0])
    g, rows, _ = T.gradients(p, table, ids, y)
    for x, grad in [*((p[k], g[k]) for k in p), (table[:-1], rows[:-1])]:
        i = tuple(rng.integers(0, s) for s in x.shape)
        old, e = x[i], 1e-5
        x[i] = old + e
        up = T.gradients(p, table, ids, y)[2]
        x[i] = old - e
        down = T.gradients(p, table, ids, y)[2]
        x[i] = old
        assert abs((up - down) / 2 / e - grad[i]) < 1e-6


def test_windows_cover_all_words():
    offsets = np.cumsum([0, 0, 1, 31, 32, 33, 56, 57, 500])
    text, first, size = T.windows(offsets)
    for i in range(len(offsets) - 1):
        seen = set()
        for f, s in zip(first[text == i], size[text == i], strict=True):
            seen |= set(range(f, f + s))
        assert seen == set(range(offsets[i], offsets[i + 1]))
    assert (np.bincount(text) >= 1).all()


def test_finds_toxic_texts(spark, docs):
    train, held = texts(600, 1), texts(400, 2)
    net = T.train([t for t, _ in train], [y for _, y in train])
    score = T.score_texts(net, pa.array([t for t, _ in held]))
    y = np.array([v for _, v in held])
    assert ((score >= 0.7) == y).mean() > 0.97
    far = T.score_texts(net, pa.array(["word1 " * 5000 + "vile scum " + "word2 " * 5000, "word1 " * 10_000]))
    assert far[0] >= 0.7 > far[1]
    odd = docs((1, None), (2, ""), (3, "vile scum"), (None, "word1")).withColumns({"score": F.lit("x"), "label": F.lit(1)})
    out = T.score(odd, net, names=("s", "p"))
    assert out.columns == [*odd.columns, "s", "p"]
    got = {r.doc_id: (r.s, r.p) for r in out.collect()}
    assert got[3][1] == 1 and got[1] == got[2] and all(0 <= s <= 1 for s, _ in got.values())
    assert T.score(odd.limit(0), net).count() == 0


def test_fit_takes_whole_texts(spark, docs):
    lead = "word1 " * 6000
    d = docs(*[(i, lead + ("vile scum" if i % 2 else "word2 word3")) for i in range(16)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, toxic int")
    assert all(r[0].endswith("vile scum" if r.label else "word3") for r in T.sample(d, labels, F.lit(True)).collect())
    assert {"vile", "scum"} <= set(T.fit(d, labels, F.lit(True)).vocabulary.to_pylist())


def test_fit_takes_a_bounded_sample(spark, docs):
    d = docs(*[(i, t) for i, (t, _) in enumerate(texts(80, 3))], (900, None))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(900, 0), (901, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    y = [r.label for r in T.sample(d, labels, F.lit(True), 15).collect()]
    net = T.fit(d, labels, F.lit(True), 15)
    assert len(net.vocabulary) == len(net.p["word"]) - 1 and set(net.p) == set(T.train([], []).p)
    assert len(T.fit(d, labels.limit(0), F.lit(True)).vocabulary) == 0
    assert y.count(0) == 15 and y.count(1) in (14, 15)  # one id has no document
    lone = T.train(["a b", "c"], [0, 0])
    assert T.score_texts(lone, pa.array(["a b", "z"]))[0] < 0.01
    assert len(T.train([], []).vocabulary) == 0


def test_forward_equals_plain_loops():
    """The network by its formulas, one window and one word at a time."""
    rng = np.random.default_rng(8)
    h, dim = T.HIDDEN, T.WORD_DIM + T.CHAR_DIM
    p = {"w_f": rng.normal(size=(dim, 3 * h)), "w_b": rng.normal(size=(dim, 3 * h)), "u_f": rng.normal(size=(h, 3 * h)), "u_b": rng.normal(size=(h, 3 * h)), "b_f": rng.normal(size=3 * h), "b_b": rng.normal(size=3 * h), "att": rng.normal(size=2 * h), "out": rng.normal(size=2 * h), "bias": rng.normal(size=1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    table = np.vstack([rng.normal(size=(20, dim)), np.zeros(dim)]).astype(np.float32)
    ids = rng.integers(0, 20, (5, 7))
    ids[1, 3:] = 20
    ids[2, 1:] = 20
    s = lambda x: 1 / (1 + np.exp(-x))

    def states(row, side):
        state, out = np.zeros(h), []
        for i in row:
            if i < 20:
                x = table[i] @ p["w_" + side] + p["b_" + side]
                g = state @ p["u_" + side][:, : 2 * h]
                z, r = s(x[:h] + g[:h]), s(x[h : 2 * h] + g[h:])
                c = np.tanh(x[2 * h :] + (r * state) @ p["u_" + side][:, 2 * h :])
                state = (1 - z) * state + z * c
            out.append(state)
        return np.array(out)

    want = []
    for row in ids:
        both = np.hstack([states(row, "f"), states(row[::-1], "b")[::-1]])
        a = both @ p["att"]
        a = np.where(row < 20, np.exp(a - a[row < 20].max()), 0)
        want.append((a / a.sum()) @ both @ p["out"] + p["bias"][0])
    assert np.allclose(T.forward(p, table, ids), want, atol=1e-4)
