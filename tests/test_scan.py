"""Searches for many queries at once: what they return, and that texts and vectors are not stored or sent again and again."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.segment import Policy
from tidemark.operators import grams, lexical, scan, vector
from tidemark.plans import queries as Q
from tidemark.sources import io

LETTERS = "组会改到周四下午讨论abc de"
QUERIES = ["组会改到周四", "周四 ab", "a b c de", "讨", "讨 a", "aa a", "", None, "ab", "会改 下午讨论", "aba ba", "abab ab b", "nowhere", "é", "a"]
DATA = "/root/testdata/sf0.001"


def folders(spark):
    path = io.session_dir(spark).removeprefix("file:")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


@pytest.mark.parametrize("policy", [Policy(), Policy(0.5, 1, False)])
def test_scans_equal_plain_loops(spark, monkeypatch, policy):
    """Several passes, slices of a few texts, and a memory of a few words; nothing is stored on the way."""
    from test_grams import brute

    random.seed(3)
    texts = ["".join(random.choices(LETTERS, k=random.randrange(90))) for _ in range(200)] + ["", None, "aaaa", "É😀b", "abab" * 30, "ababab abab aba　ab", "ab\nab\tab"] + ["ab 周四 de"] * 40
    rows = [(f"c{i:03}", f"n{i}", "b", random.choice([*lexical.SOURCE_WEIGHT, "other"]), x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id string, note_id string, block_id string, source string, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    held = lexical.with_hay(df).filter("text is not null").collect()
    monkeypatch.setitem(lexical.SOURCE_WEIGHT, "other", 0.0)
    before = folders(spark)
    for k, few in ((3, True), (30, False)):
        for name, value in (("QUERIES", 4), ("COUNTS", 100), ("WORDS", 5)) if few else ():
            monkeypatch.setattr(scan, name, value)
        found = grams.keyword_batch(df, q, k, policy, 9, keep=("note_id", "text"))
        assert found.columns == ["query_id", "chunk_id", "note_id", "text", "score", "rank"]
        got = found.collect()
        assert sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in got) == brute(held, QUERIES, k, policy, 9)
        assert all((r.note_id, r.text) == (f"n{int(r.chunk_id[1:])}", texts[int(r.chunk_id[1:])]) for r in got)
    assert folders(spark) == before


def test_best_so_far_are_settled(monkeypatch):
    """Far more hits than are kept: the bound that earlier chunks set loses nothing, ties by id included."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choices(["ab", "cd", "abab", "x"], k=rng.randrange(1, 9))) for _ in range(900)]
    best = scan._Best([(0, ("ab", "x"), 1, False), (1, ("cd",), 1, False)], 5, 9)
    ids = [f"c{rng.random():.12f}" for _ in texts]
    for lo in range(0, 900, 100):
        some = slice(lo, lo + 100)
        best.see(pa.array(texts[some]), np.array([len(t) for t in texts[some]]), ["text"] * 100, pa.table({"chunk_id": ids[some]}))
        best.settle()
        assert len(best.q) <= 10 and best.rows[0].num_rows <= 10
    for q, terms in ((0, ("ab", "x")), (1, ("cd",))):
        want = sorted((-round(sum(min(3, t.count(x)) for x in terms) / len(t) ** 0.5, 9), i) for t, i in zip(texts, ids) if any(x in t for x in terms))[:5]
        mine = best.q == q
        assert [(-s, best.rows[0].column("chunk_id")[int(r)].as_py()) for s, r in zip(best.score[mine], best.row[mine])] == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_arms_make_no_index(spark):
    """No chunk table and no index of its grams, which took more disk than 4 x the input."""
    before = folders(spark)
    Q._arms(spark, DATA)
    assert {n.split("-")[0] for n in folders(spark) - before} == {"kept"}


def test_vectors_are_sent_once_a_group(spark, monkeypatch):
    """Vectors without groups, so that nearly all blocks are looked at: not a row for each query and block, but for each group of blocks."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    x[100:104] = x[3]
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    queries = index.filter("id % 20 = 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    for name, value in (("BLOCK", 5), ("DIRECT", 0), ("GROUP", 400), ("MANY_GROUPS", 3), ("TOGETHER", 16)):
        monkeypatch.setattr(vector, name, value, raising=False)
    stored = []
    monkeypatch.setattr(vector, "kept", lambda df: stored.append(io.kept(df)) or stored[-1])
    got = {}
    for r in vector.nearest(index, queries, 7, digits=9).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(3, 1200, 20):
        assert [got[q][r] for r in range(1, 8)] == np.lexsort((np.arange(1200), -np.round(u @ u[q], 9)))[:7].tolist()
    looked = sum(r.visited for r in vector.visits(index, queries, 7).collect())
    assert looked > 60 * 100 and max(s.count() for s in stored if "v" in s.columns and "block" not in s.columns) <= 60 * 4
    assert all(s.schema["v"].dataType.simpleString() == "array<float>" for s in stored if "v" in s.columns)


def test_sets_of_trigrams_are_sent_as_digests(spark):
    """Long texts: what is stored and exchanged for the classes doesn't grow with them."""
    from tidemark.operators import evaluate

    rng = random.Random(4)
    long = ["".join(rng.choices("abcdefghij klmno\n", k=3000)) for _ in range(30)]
    texts = [*long, *(x.upper().replace(" ", " \t") for x in long[:10]), long[0] + long[0][-3:], "a", "A ", "ab", "a\0", "a\0\0", "\0a", "", " ", None, "abab", "ababab", "aba", "😀😀😀", "😀😀", "😀 😀😀😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, query string").repartition(3)
    norm = ["".join((x or "").lower().split()) for x in texts]
    sets = {i: frozenset(x[k : k + 3] for k in range(len(x) - 2)) or frozenset([x]) for i, x in enumerate(norm) if x}
    before = folders(spark)
    got = evaluate.query_classes(df)
    assert {(r.id, r.rep) for r in got.collect()} == {(i, min(j for j, h in sets.items() if h == g)) for i, g in sets.items()}
    path = io.session_dir(spark).removeprefix("file:")
    made = [os.path.getsize(f"{path}/{n}/{f}") for n in folders(spark) - before for f in os.listdir(f"{path}/{n}")]
    assert made and sum(made) < 30_000 and "array" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_as_many_counts_tie(spark):
    """Three and one of two terms score as two and two do, and ties go by id; summed term by term they differ in the last bit."""
    n = next(n for n in range(40, 240) if 3 / n**0.5 + 1 / n**0.5 < 4 / n**0.5)
    made = lambda a, b: ("chi " * a + "ungein " * b).ljust(n, "x")
    df = spark.createDataFrame([("c1", made(3, 1), "text"), ("c2", made(2, 2), "text"), ("c3", made(1, 1), "text")], "chunk_id string, text string, source string")
    found = lexical.keyword_search(df, "chi ungein verlich", 3, summed=True).collect()
    assert [r.chunk_id for r in sorted(found, key=lambda r: r.rank)] == ["c1", "c2", "c3"] and len({r.score for r in found}) == 2
    chunks = grams.numbered(lexical.with_hay(df), 1)
    found = grams.indexed_search(chunks, grams.build(chunks), "chi ungein verlich", 3, summed=True).collect()
    assert [r.chunk_id for r in sorted(found, key=lambda r: r.rank)] == ["c1", "c2", "c3"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_policies_are_swept_in_one_scan(spark):
    from tidemark.plans import upkeep_queries as U

    before = folders(spark)
    plan = U.segmentation_sweep(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents") <= 1 and plan.count("_n#") and plan.count("MapInArrow run(hay") == 1 and folders(spark) == before
