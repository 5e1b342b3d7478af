"""The contract queries against their SQL or plain Python on the smallest tables."""

import os
import zlib

import duckdb
import pytest

from test_oracles import same_rows
from tidemark.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    same_rows(QUERIES[name](spark, DATA), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op1_simhash_bitsliced", "op2_entropy_mix", "op5_histogram_shards", "op6_class_bigrams", "op8_bigru_toxicity", "op10_closed_syncmers", "op11_byte_cnn_language"])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, DATA).collect()) == ids


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_shards_keep_their_contract(spark):
    texts, rows = texts_of(spark), rows_of(spark, "op5_histogram_shards")
    sizes, slots, of = {}, {}, {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["grown_shard"] is None
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault(t, set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most, mean = max(len(t.encode()) + 16 for t in texts.values()), sum(sizes.values()) / 40
    assert all(abs(sizes.get(s, 0) - mean) <= 2 * most for s in range(40))
    assert all(len(s) == 1 for s in of.values())


def test_mix_keeps_its_contract(spark):
    docs = {r.doc_id: (len((r.text or "").split()), r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    by = {}
    for r in rows_of(spark, "op2_entropy_mix"):
        n, source = docs[r["doc_id"]]
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n
        s = by.setdefault(source, [0, 0, r["source_size"], r["target"]])
        s[0], s[1] = s[0] + n, s[1] + r["taken"]
    assert all(size == said for size, _, said, _ in by.values())
    assert sum(abs(taken - target) for _, taken, _, target in by.values()) <= 0.02 * sum(s[0] for s in by.values())


def test_packing_keeps_its_contract(spark):
    texts, ends, filled, pieces = texts_of(spark), {}, {}, {}
    for r in rows_of(spark, "op9_best_fit_pack"):
        assert 1 <= r["length"] <= 2048 and r["start"] == 2048 * r["piece"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for p in pieces.values():
        assert [k for k, _ in sorted(p)] == list(range(len(p))) and all(n == 2048 for _, n in sorted(p)[:-1])
    for s in filled.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(n for p in pieces.values() for _, n in p)
    assert len(filled) <= total / 2048 * 1.02 + 1


def test_passages_lie_in_their_texts(spark):
    texts = texts_of(spark)
    rows = rows_of(spark, "op3_chunk_dedup")
    assert rows and {"doc_id", "start_word", "n_words", "kept", "first_doc_id"} == set(rows[0])
    held = {}
    for r in rows:
        words = texts[r["doc_id"]].split()
        assert 0 <= r["start_word"] < r["start_word"] + r["n_words"] <= len(words)
        if not r["kept"] and r["first_doc_id"] != r["doc_id"]:
            held.setdefault(r["first_doc_id"], []).append(" ".join(words[r["start_word"] : r["start_word"] + r["n_words"]]))
    first = [t in " ".join(texts[i].split()) for i, of in held.items() for t in of]
    assert sum(first) >= 0.8 * len(first)  # a part may hold passages of several documents


def test_scores_are_told_apart(spark):
    """Held-out documents labelled toxic score higher than others, on a table that is large enough to learn from."""
    data = os.environ.get("TEST_LEARN_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_bigru_toxicity"](spark, data).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    bad, good = [r.score for r in rows if labels[r.doc_id] == 1], [r.score for r in rows if labels[r.doc_id] == 0]
    assert len(bad) > 5 and sum((b > g) + 0.5 * (b == g) for b in bad for g in good) >= 0.8 * len(bad) * len(good)


def test_held_out_languages(spark):
    data = os.environ.get("TEST_LEARN_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_cnn_language"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
