"""Searches by the index against scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.segment import Policy, groups
from tidemark.operators import grams, lexical

LETTERS = "组会改到周四下午讨论abc de"
QUERIES = ["组会改到周四", "周四 ab", "a b c de", "讨", "讨 a", "aa a", "", None, "ab", "会改 下午讨论", "，四下", "abcab", "cab de", "nowhere", "论abc", "de de", "a", "😀b", "abcabcabc"]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(grams, "PLACES", 16)


@pytest.fixture
def chunks(spark, small):
    random.seed(12)
    texts = ["".join(random.choices(LETTERS, k=random.randrange(90))) for _ in range(150)] + ["", "aaaa", "é😀b", "abcab" * 30, "周四 abcabcabc"]
    rows = [(f"c{i:03}", f"n{i}", "b", random.choice(list(lexical.SOURCE_WEIGHT)), x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id string, note_id string, block_id string, source string, text string").repartition(3)
    return grams.numbered(lexical.with_hay(df), 5)


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def ranked(df):
    return [(r.rank, r.chunk_id, round(r.score, 9)) for r in df.orderBy("rank").collect()]


def test_places_of_parts():
    hays = ["abab", "", "b é", "😀a"]
    names, ends, places = grams.part_grams(hays, np.array([3, 4, 7, 9]))
    got, lo = {}, 0
    for name, hi in zip(names, ends, strict=True):
        got[name] = places[lo:hi].tolist()
        lo = hi
    want = {}
    for h, p in zip(hays, (3, 4, 7, 9)):
        for n in (1, 2, 3):
            for i in range(len(h) - n + 1):
                want.setdefault(h[i : i + n], set()).add(p)
    assert got == {g: sorted(p) for g, p in want.items()}


def test_many_letters(monkeypatch):
    """An alphabet so large that a gram and a place do not fit into one number."""
    monkeypatch.setattr(grams, "PLACES", 1 << 40)
    names, ends, places = grams.part_grams(["abc", "bcd"], np.array([0, 9]))
    assert dict(zip(names, np.diff(np.append(0, ends)).tolist()))["bc"] == 2 and set(names) == {"a", "b", "c", "d", "ab", "bc", "cd", "abc", "bcd"}


def test_grams_of_terms(spark):
    terms = ["a", "ab", "abc", "abcd", "aaaaa", "周四下"]
    got = {r.t: r.g for r in spark.createDataFrame([(x,) for x in terms], "t string").select("t", grams.grams(F.col("t")).alias("g")).collect()}
    assert got == {x: grams.grams_of(x) for x in terms} and grams.grams_of("aaaaa") == ["aaa"]


def test_single_searches_equal_scans(spark, tmp_path, chunks, monkeypatch):
    c = stored(spark, chunks, tmp_path / "c")
    index = stored(spark, grams.build(c), tmp_path / "i")
    assert c.select("part").distinct().count() >= 9 and c.count() == c.select("part", "place").distinct().count()
    for share, some in ((1e9, QUERIES), (0.2, QUERIES[:3])):
        monkeypatch.setattr(grams, "SCANNED", share)
        for q in some:
            assert ranked(grams.indexed_search(c, index, q or "", 7)) == ranked(lexical.keyword_search(c, q or "", 7)), q
    # Candidates are what matches, and little else.
    wanted = groups("abcab de")
    assert grams.candidates(index, wanted).count() <= grams.most_matches(index, wanted)


def brute(rows, queries, k, policy, digits):
    """(query, rank, chunk id, score), query by query and chunk by chunk."""
    out = []
    for q, text in enumerate(queries):
        wanted, hits = groups(text or "", policy), []
        for c in rows if wanted else []:
            tf = {t: min(3, c.hay.count(t)) for g in wanted for t in g.terms}
            if all(sum(tf[t] > 0 for t in g.terms) >= g.min_matched for g in wanted):
                pairs = [sum(tf[t] > 0 for t in g.terms) / len(g.terms) for g in wanted if g.is_bigram]
                score = sum(tf[t] for g in wanted for t in g.terms) / max(1, len(c.text)) ** 0.5 * (sum(pairs) / len(pairs) if pairs else 1) * lexical.SOURCE_WEIGHT[c.source]
                hits.append((-(round(score, digits) if digits else score), c.chunk_id))
        out += [(q, r, c, round(-s, 9)) for r, (s, c) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("policy", [Policy(), Policy(0.5, 1, False)])
def test_batches_equal_plain_loops(spark, tmp_path, chunks, policy):
    c = stored(spark, chunks, tmp_path / "c")
    index = stored(spark, grams.build(c), tmp_path / "i")
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    found = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    for k, digits in ((3, 6), (200, 6)):
        assert found(grams.indexed_batch(c, index, q, k, policy, digits)) == brute(c.collect(), QUERIES, k, policy, digits)
    # Chunks that are gone from the table are still in the index.
    fewer = c.filter("note_id < 'n5'")
    assert found(grams.indexed_batch(fewer, index, q, 5, policy, 6)) == brute(fewer.collect(), QUERIES, 5, policy, 6)
    assert grams.indexed_batch(c, index, q.limit(0), 3).count() == 0 == grams.indexed_batch(c.limit(0), index.limit(0), q, 3).count()
