"""The network against plain loops, and its handling of odd texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language as L


def small(seed, languages=3):
    rng = np.random.default_rng(seed)
    p = {f"w{w}": rng.normal(0, 0.3, (w, 256, L.FILTERS)) for w in L.WIDTHS}
    return p | {"b": rng.normal(0, 0.1, len(L.WIDTHS) * L.FILTERS), "out": rng.normal(0, 0.3, (len(L.WIDTHS) * L.FILTERS, languages)), "bias": rng.normal(0, 0.1, languages)}


def plain(p, window):
    """Probabilities of one window, filter by filter and place by place."""
    h = []
    for w in L.WIDTHS:
        for f in range(L.FILTERS):
            h.append(max(sum(p[f"w{w}"][j, window[i + j], f] for j in range(w)) for i in range(len(window) - w + 1)))
    z = np.maximum(np.array(h) + p["b"], 0) @ p["out"] + p["bias"]
    return np.exp(z) / np.exp(z).sum()


def test_windows_hold_every_run_of_bytes():
    texts = ["", "a", "É" * 200, "x" * L.WINDOW, "x" * (L.WINDOW + 1), None, "".join(chr(97 + i * i % 26) for i in range(5000))]
    owner, rows = L.windows(pa.array(texts).fill_null(""))
    assert rows.shape[1] == L.WINDOW and sorted(set(owner.tolist())) == list(range(len(texts)))
    w = max(L.WIDTHS)
    for i, t in enumerate(texts):
        b = (t or "").lower().encode()
        mine = [bytes(r) for r in rows[owner == i]]
        assert all(any(b[a : a + w] in m for m in mine) for a in range(max(1, len(b) - w + 1)))
        assert sum(len(m.rstrip(b"\0")) for m in mine) - (len(mine) - 1) * (L.WINDOW - L.STRIDE) == len(b)


def test_forward_equals_plain_loops():
    p = small(1)
    _, rows = L.windows(pa.array(["short", "", "Größe und Maß " * 12]))
    got = L.probabilities(p, L.paired(p), rows)
    assert np.allclose(got, [plain(p, r) for r in rows])


def test_gradients_equal_differences():
    p, rng = small(2), np.random.default_rng(3)
    rows, labels = rng.integers(97, 103, (5, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    g, _ = L.gradients(p, rows, labels)
    for name, v in p.items():
        flat, got = v.reshape(-1), g[name].reshape(-1)
        for at in {int(np.abs(got).argmax()), *rng.integers(0, len(flat), 4).tolist()}:
            old, h = flat[at], 1e-5
            flat[at] = old + h
            up = L.gradients(p, rows, labels)[1]
            flat[at] = old - h
            down = L.gradients(p, rows, labels)[1]
            flat[at] = old
            assert got[at] == pytest.approx((up - down) / (2 * h), abs=1e-4)


TALK = {"en": "the thing with and that of the which", "de": "der und nicht ein über schön die straße", "ru": "это что как не он на я с"}


def corpus(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        lang = ["en", "de", "ru"][i % 3]
        rows.append((i, " ".join(rng.choice(TALK[lang].split(), rng.integers(2, 60))), lang, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_odd_texts_and_clashing_columns(spark):
    docs = corpus(spark)
    net = L.fit(docs, F.lit(True))
    assert net.languages == ["de", "en", "ru"]
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "THE THING WITH THAT"), (5, "это"), (6, "der und die " * 20_000), (None, "nicht über"), (7, "日本語"), (4, "THE THING WITH THAT")]
    df = spark.createDataFrame([(i, t, "x", "y", 9) for i, t in odd], "doc_id long, text string, Score string, said string, n int").repartition(2)
    out = L.identify(df, net)
    assert sorted(out.columns) == sorted(["doc_id", "text", "said", "n", "lang_pred", "score"])
    rows = sorted(out.collect(), key=str)
    got = {(r.doc_id, r.lang_pred) for r in rows}
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 and r.said == "y" for r in rows)
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "ru"), (6, "de"), (None, "de")} < got
    assert all(r.score == 0 for r in rows if r.lang_pred == "und") and {r.lang_pred for r in rows if r.doc_id == 7} <= {"de", "en", "ru"}
    # A text is told by its own bytes: the others in its batch change nothing.
    one = L.identify(df.filter("doc_id = 6"), net).first()
    assert (one.lang_pred, pytest.approx(one.score)) == next((r.lang_pred, r.score) for r in rows if r.doc_id == 6)


def test_learns_from_what_it_may(spark):
    """The rows that are not to be learned from, and null languages, leave no trace; one language is learned as well as none."""
    docs = corpus(spark)
    use = F.col("doc_id") % 2 == 0
    other = docs.withColumn("lang", F.when(use, F.col("lang")).otherwise("xx"))
    a, b = L.fit(docs, use), L.fit(other, use)
    assert a.languages == b.languages and all(np.array_equal(a.p[k], b.p[k]) for k in a.p)
    assert L.fit(docs.withColumn("lang", F.lit(None).cast("string")), use).languages == []
    one = L.fit(docs.filter("lang = 'de'"), use)
    assert {r.lang_pred for r in L.identify(docs.limit(5), one).collect()} == {"de"}


def test_sample_is_bounded(spark):
    docs = corpus(spark).union(spark.createDataFrame([(1000 + i, "the same text " * 500, "en", "hot") for i in range(500)], "doc_id long, text string, lang string, source string"))
    rows = L.sample(docs, F.lit(True), per_language=20).collect()
    by = {lang: sum(r.lang == lang for r in rows) for lang in TALK}
    assert all(0 < n <= 20 * L.WINDOWS_A_TEXT for n in by.values()) and len(rows) == len(set(rows))


def test_empty_table(spark):
    docs = corpus(spark).limit(0)
    net = L.fit(docs, F.lit(True))
    assert L.identify(docs, net).collect() == []
    assert [(r.lang_pred, r.score) for r in L.identify(corpus(spark).limit(1), net).collect()] == [("und", 0.0)]
