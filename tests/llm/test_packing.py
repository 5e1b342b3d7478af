import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing

PATH = "/opt/tokenizers/word_bpe_49k.json"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@needs_tokenizer
def test_ids_are_the_tokenizers():
    random.seed(1)
    alphabet = "abcdefgthiABCÀÉéñüßøŁłŉſİıǅμΣσ'.,!-—’%|012 \t\n \u0085́中文😀"
    texts = ["á b  <|endoftext|>x it's I'M", "", "\x1c \x85 a", "aaaaaaaaaaaaa aaa aaaa", "x" * 50, "the " * 5000] + ["".join(random.choices(alphabet, k=random.randrange(40))) for _ in range(4000)]
    ids, sizes = bpe.encode(pa.array(texts), PATH)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tok = bpe.vocabulary(PATH).tokenizer
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@needs_tokenizer
def test_ids_of_a_whole_table(spark, monkeypatch):
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    monkeypatch.setattr(bpe, "LONGEST", 9)  # longer words go through the tokenizer itself
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    tok = bpe.vocabulary(PATH).tokenizer
    for lo in range(0, len(texts), 60):
        part = texts[lo : lo + 60]
        ids, sizes = bpe.encode(pa.array(part, pa.string()).fill_null(""), PATH)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [tok.encode(t or "", add_special_tokens=False).ids for t in part]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=12))
def test_bins_hold_everything(counts):
    classes = packing.plan_bins(counts, 30)
    held: dict[int, int] = {}
    for holds, bins in classes:
        assert bins > 0 and sum(k * q for k, q in holds) <= 30 and sum(q for k, q in holds if 3 * k > 30) <= 2
        for k, q in holds:
            held[k] = held.get(k, 0) + q * bins
    assert held == {k: v for k, v in counts.items() if v}
    used, total = sum(b for _, b in classes), sum(k * v for k, v in counts.items())
    large = sum(v for k, v in counts.items() if 2 * k > 30) + (counts.get(15, 0) + 1) // 2
    assert used <= max(large, 1.5 * total / 30 + 1)


@needs_tokenizer
def test_pack_of_documents(spark, docs):
    random.seed(3)
    rows = [(i, "".join(random.choices("ab cd. ", k=random.choice([0, 3, 40, 300, 9000])))) for i in range(150)] + [(200, None), (None, ""), (5, "same"), (5, "same")]
    pieces = packing.tokenize(docs(*rows), PATH, capacity=64).cache()
    tok = bpe.vocabulary(PATH).tokenizer
    back = {}
    for r in pieces.collect():
        assert r.start == r.piece * 64 and r.length == len(r.ids) // 4 <= 64
        back.setdefault(r.id, []).append((r.piece, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for i, t in rows:
        if i not in (None, 5):
            assert sum((x for _, x in sorted(back[i])), []) == tok.encode(t or "", add_special_tokens=False).ids + [0]
    out = packing.pack(pieces.withColumns({"salt": F.lit(1), "offset": F.lit(7)}), ["id", "piece"], capacity=64)
    bins: dict[int, list] = {}
    for r in out.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, bins.values())) == pieces.count() and "salt" in out.columns
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= 1.05 * total / 64 + 2


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "id long, length long"), ["id"]).count() == 0
