"""The search against a plain loop over all documents."""

import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import maxscore

QUERY = "item_id long, text string"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))


def brute(docs, queries, k):
    """(item, rank, doc, score) by scoring every document for every query."""
    known = [(i, terms_of(t)) for i, t in docs]
    known = [(i, t) for i, t in known if t]
    n, total = len(known), sum(len(t) for _, t in known)
    df = {}
    for _, t in known:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, t in known:
            m = 100 - 90 + (90 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in wanted if x in t)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


WORDS = ["the", "of", "Der", "élan", "x9", "rare", "ÉLAN", "zu", "a", "b", "c", "once"]


def corpus(seed, n=300):
    rng = random.Random(seed)
    weights = [40, 30, 20, 6, 3, 1, 2, 9, 5, 5, 5, 0.3]
    rows = [(i, rng.choice([" ", ", ", "\n", "_"]).join(rng.choices(WORDS, weights, k=rng.choice([0, 1, 3, 8, 40, 200])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "..!"), (None, "rare once"), (None, "rare the"), (5, "rare once"), *[(1000 + i, "the rare élan") for i in range(30)], (2000, "rare the of " * 20_000)]


QUERIES = [(0, "the rare ÉLAN"), (1, "Once, once; ONCE"), (2, None), (3, "nowhere to be found"), (4, "the of der"), (5, " ".join(WORDS)), (6, "a"), (6, "b c"), (None, "x9"), (8, "?")]


@pytest.mark.parametrize("k", [1, 10, 500])
def test_equals_a_plain_loop(spark, k):
    docs = corpus(k)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string").repartition(5)
    assert found(maxscore.search(df, spark.createDataFrame(QUERIES, QUERY), k)) == brute(docs, QUERIES, k)


def test_small_shards_and_blocks_of_queries(spark, monkeypatch):
    docs = corpus(7)
    monkeypatch.setattr(maxscore, "TERMS_A_PASS", 5)
    monkeypatch.setattr(maxscore.shards, "__defaults__", ("text", "doc_id", 7, 20))
    monkeypatch.setattr(maxscore, "groups", lambda texts: ((lo, texts.fill_null("").slice(lo, 3)) for lo in range(0, len(texts), 3)))
    assert found(maxscore.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(QUERIES, QUERY), 3)) == brute(docs, QUERIES, 3)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked, nothing = spark.createDataFrame(QUERIES, QUERY), spark.createDataFrame([], QUERY)
    assert maxscore.search(none, asked).collect() == [] == maxscore.search(some, nothing).collect()


@pytest.mark.parametrize("seed", range(20))
def test_no_document_is_lost_to_a_bound(seed):
    """``best_of`` holds every document of the k best at or above the score to beat, whatever that is, and whole scores only."""
    rng = np.random.default_rng(seed)
    n, v, k = 200, 30, 5
    counts = rng.poisson(rng.random((v, 1)) * 0.8, (v, n)) * rng.integers(1, 4, (v, n))
    counts[rng.integers(v)] = 0
    terms = np.flatnonzero(counts.any(axis=1))
    docs = [np.flatnonzero(counts[t]) for t in terms]
    lengths, weights = rng.integers(1, 400, n), rng.integers(0, 5000, v)
    lists = maxscore.lists_of(lengths, terms, np.cumsum([len(d) for d in docs]), np.concatenate(docs), np.concatenate([counts[t][d] for t, d in zip(terms, docs)]), weights, n, int(lengths.sum()))
    wanted = np.sort(rng.choice(v, 12, replace=False))
    m = 10 + (90 * lengths * n) // lengths.sum()
    whole = sum(weights[t] * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in wanted)
    for beat in (0, int(np.sort(whole)[-3]), int(np.median(whole)), int(whole.max()), int(whole.max()) + 1):
        got = dict(zip(*(x.tolist() for x in maxscore.best_of(lists, wanted, k, beat))))
        assert all(whole[d] == s for d, s in got.items())
        need = max(beat, int(np.sort(whole)[-k]), 1)
        assert set(got) == set(np.flatnonzero(whole >= need).tolist())
