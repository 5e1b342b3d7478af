import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import class_lm as L


def rows_of(seed, n=160):
    random.seed(seed)
    languages = [[f"{a}{i}{e}" for i in range(60) for a in "xy"] for e in ("ung", "tion", "mente")]
    out = []
    for i in range(n):
        lang = languages[i % 3]
        out.append((i, " ".join(random.choices(lang, weights=[1 / (k + 1) for k in range(len(lang))], k=random.randrange(5, 60)))))
    return out


def test_scores(spark, docs):
    rows = rows_of(1) + [(500, None), (501, ""), (502, "Never seen WORDS"), (None, "x0ung"), (0, "repeated id")]
    out = L.score(docs(*rows), F.coalesce(F.col("doc_id"), F.lit(-1)) % 7 != 2).collect()
    count, n_docs = Counter(), 0
    for i, t in rows:
        if (i if i is not None else -1) % 7 != 2:
            count.update((t or "").lower().split())
            n_docs += 1
    count[None] = n_docs
    n, v = sum(count.values()), len(count)
    want = Counter((i, len((t or "").split()) + 1, sum(count[w] > 0 for w in [*(t or "").lower().split(), None]), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*(t or "").lower().split(), None]), 6)) for i, t in rows)
    assert Counter((r.id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n}
    held = [r for r in out if r.id is not None and r.id % 7 == 2 and r.id < 500]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and r.perplexity > 1 for r in out)


def test_rare_words_are_looked_up(spark, docs):
    rows = rows_of(2, 60)
    few = L.most_frequent(L.word_counts(docs(*rows).select("text")), 50)
    assert 0 < few.count() <= 50
    full, joined = ({r.id: r for r in L.score(docs(*rows), F.lit(True), head=n).collect()} for n in (L.HEAD, 50))
    for i, r in full.items():
        assert joined[i].n_known == r.n_known == r.n_tokens and abs(joined[i].base_score - r.base_score) < 1e-6
        assert joined[i].score < 0


def test_probabilities_add_up(spark, docs):
    rows = rows_of(3, 60)
    texts = docs(*rows).select("text")
    counts = L.word_counts(texts).cache()
    m = L.fit(counts, texts)
    words = [r.word for r in counts.collect()]
    import pyarrow as pa

    units, k = L.units_of(pa.array(words), m.own), len(m.transition) - 1
    n = {r.word: r.n for r in counts.collect()}
    for previous in (k, m.unit_class[0]):
        total = 10 ** m.transition[previous, k]
        for w, u in zip(words, units, strict=True):
            total += 10 ** (m.transition[previous, m.unit_class[u]] + m.unit[u] + (math.log10(n[w] + 1) if u >= len(m.own) else 0))
        assert 0.8 < total <= 1 + 1e-9
    assert np.allclose((10**m.transition).sum(1), 1)


def test_edges(spark, docs):
    assert L.score(docs((1, "a")).limit(0), F.lit(True)).count() == 0
    none = L.score(docs((1, "a b"), (2, None)), F.lit(False)).orderBy("id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in none] == [(3, 0, 0), (1, 0, 0)]


def test_the_most_frequent_words_are_found_at_any_count(spark):
    rows = [(f"w{i}", n) for i, n in enumerate([10**9, 10**9, 10**12, 5, 5, 5, 1, 200_000, 150_000, 150_001])]
    counts = spark.createDataFrame(rows, "word string, n long")
    order = sorted((n for _, n in rows), reverse=True)
    for most in range(1, 11):
        for bins in (2, 1024):
            assert sorted((r.n for r in L.most_frequent(counts, most, bins).collect()), reverse=True) == order[:most]
    assert L.most_frequent(counts, 0).count() == 0


def test_exchange_gains_equal_brute_force():
    rng = np.random.default_rng(3)
    n, k = 12, 4
    big = rng.integers(0, 6, (n + 1, n + 1)).astype(float)
    np.fill_diagonal(big, 0)  # a unit beside itself is counted by its class of before
    of = np.append(rng.integers(0, k, n), k)

    def table(of):
        c = np.zeros((k + 1, k + 1))
        np.add.at(c, (of[:, None].repeat(n + 1, 1), of[None, :].repeat(n + 1, 0)), big)
        return c

    def likelihood(c):
        return L._xlogx(c).sum() - L._xlogx(c.sum(1)).sum() - L._xlogx(c.sum(0)).sum()

    hot = np.eye(k + 1)[of]
    got = L.gains((big @ hot)[:n], (big.T @ hot)[:n], of[:n], table(of))
    for u in range(n):
        for b in range(k):
            moved = of.copy()
            moved[u] = b
            want = likelihood(table(moved)) - likelihood(table(of))
            assert abs(got[u, b] - got[u, of[u]] - want) < 1e-6


def test_classes_beat_frequencies_on_held_out_text(spark, docs):
    rows = rows_of(5, 300)
    out = [r for r in L.score(docs(*rows), F.col("doc_id") % 7 != 2).collect() if r.id % 7 == 2]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)


def test_edge_texts(spark, docs):
    long = "alpha beta " * 60_000
    df = docs((1, long), (2, None), (3, ""), (4, "Alpha"), (4, "Alpha")).withColumns({"row": F.lit(1), "word": F.lit("x"), "n": F.lit(2), "words": F.lit(3), "times": F.lit(4)})
    out = L.score(df, F.lit(True)).collect()
    assert sorted((r.id, r.n_tokens) for r in out) == [(1, 120_001), (2, 1), (3, 1), (4, 2), (4, 2)] and all(r.score < 0 for r in out)

