"""The delta table against a plain dictionary, and what a driver that dies leaves behind."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tidemark.operators import grams, lexical
from tidemark.plans import mapping as M
from tidemark.plans.queries import QUERIES
from tidemark.sources import deltas, io
from tidemark.sources.maintained import ChunkTable

DDL = "chunk_id string, note_id string, block_id string, content_hash string, embedding_version string, created_at int"


def rows(spark, *found):
    return spark.createDataFrame([(c, n, "b" + c, "h", v, at) for c, n, v, at in found], DDL)


def table(spark, path, **more):
    return deltas.DeltaTable(spark, str(path), t.StructType.fromDDL(DDL), deleted_by=("block_id", "note_id"), **more)


def held(df):
    return {r.chunk_id: (r.note_id, r.embedding_version, r.created_at) for r in df.collect()}


@pytest.mark.parametrize("more", [{}, {"order": "note_id", "partition": "embedding_version"}])
def test_any_sequence_of_writes(spark, tmp_path, more):
    """Small writes, deletes of all kinds and both, with merges in between; every version reads as it was."""
    rng = random.Random(3)
    store, want, seen = table(spark, tmp_path / "t", **more), {}, {}
    for step in range(14):
        gone = {}
        if step % 3:
            by = rng.choice(["chunk_id", "note_id", "block_id"])
            value = rng.choice([f"c{i}" for i in range(9)] if by == "chunk_id" else [f"n{i}" for i in range(3)] if by == "note_id" else [f"bc{i}" for i in range(9)])
            gone = {by: spark.createDataFrame([(value,), (None,)], f"{by} string")}
            want = {c: w for c, w in want.items() if {"chunk_id": c, "note_id": w[0], "block_id": "b" + c}[by] != value}
        new = {f"c{i}": (f"n{rng.randrange(3)}", rng.choice(["e1", "e2"]), step) for i in rng.sample(range(9), rng.randrange(4))} if step % 4 != 3 else {}
        want = want | new
        entry = store.write(rows(spark, *[(c, *w) for c, w in new.items()]) if new or step % 2 else None, gone)
        seen[entry["version"]] = dict(want)
        assert held(store.load()) == want
    assert len(store.versions()) > 14  # some were merged
    assert all(held(store.load(v)) == w for v, w in seen.items())
    store.compact()
    assert held(store.load()) == want and not store.entry()["deltas"]
    dropped = store.vacuum(2)
    assert dropped and held(store.load()) == want and len(store.versions()) == 2
    store.clear()
    assert held(store.load()) == {} and held(store.load(store.versions()[-2])) == want


def test_a_write_costs_what_it_writes(spark, tmp_path):
    store = io.DerivedStore(spark, str(tmp_path / "s"), t.StructType.fromDDL(DDL))
    store.upsert(rows(spark, *[(f"c{i}", f"n{i % 500}", "e1", 1) for i in range(5000)]))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "s") for f in names)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "s") for f in names}
    first, before, sizes = size(), files(), []
    for i in range(3):
        had = size()
        store.upsert(rows(spark, *[(f"c{j}", f"n{j % 500}", "e2", 2 + i) for j in range(10 * i, 10 * i + 10)]))
        store.delete(spark.createDataFrame([(f"n{400 + i}",)], "note_id string"), "note_id")
        sizes.append(size() - had)
    assert before <= files() and max(sizes) < first / 3
    assert store.load("e2").count() == 30 and store.load().count() == 5000 - 3 * 10 and store.load(note_id="n400").count() == 0
    assert store.load(at=1).count() == 5000


def test_a_driver_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    store = table(spark, tmp_path / "t")
    store.write(rows(spark, ("a", "n", "e", 1), ("b", "m", "e", 1)))

    def dies(self, entry):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(deltas.DeltaTable, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            store.write(rows(spark, ("a", "n", "x", 2)), {"note_id": spark.createDataFrame([("m",)], "note_id string")})
    again = table(spark, tmp_path / "t")
    assert held(again.load()) == {"a": ("n", "e", 1), "b": ("m", "e", 1)}
    assert len(again.vacuum()) == 2 and held(again.load()) == {"a": ("n", "e", 1), "b": ("m", "e", 1)}
    # A merge that dies after the commit it follows leaves that commit.
    commit = deltas.DeltaTable._commit
    monkeypatch.setattr(deltas.DeltaTable, "compact", dies)
    monkeypatch.setattr(deltas.DeltaTable, "_commit", commit)
    with pytest.raises(TypeError):
        again.write(rows(spark, ("a", "n", "y", 3), ("c", "n", "y", 3)))
    assert held(table(spark, tmp_path / "t").load())["a"] == ("n", "y", 3)


def test_two_writers(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    store.write(rows(spark, ("a", "n", "e", 1)))
    late = store.entry()
    store.write(rows(spark, ("b", "n", "e", 1)))
    with pytest.raises(deltas.ConflictError):
        store._commit(late | {"version": late["version"] + 1})
    with pytest.raises(ValueError):
        store.write(gone={"created_at": spark.range(1)})
    assert set(held(store.load())) == {"a", "b"}


# The chunk table

LONG = "word " * 200


def documents(spark, path, *docs):
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(str(path))


def chunked(spark, df):
    return {(r.chunk_id, r.text, r.hay) for r in df.collect()}


def scanned(spark, folder):
    from tidemark.operators.chunk import chunk

    return chunked(spark, lexical.with_hay(chunk(M.texts(M.document_blocks(spark, str(folder))))))


def test_chunk_table_follows_its_files(spark, tmp_path, monkeypatch):
    made = []
    source = tmp_path / "documents.parquet"
    documents(spark, source, *[(i, f"first {i} " + LONG) for i in range(20)])
    blocks = lambda df: (made.append(sorted(r.doc_id for r in df.select("doc_id").collect())), M.texts(M.blocks_of(df, "file"), "file"))[1]
    store = ChunkTable(spark, str(tmp_path / "chunks"), blocks)
    store.refresh(str(source))
    assert chunked(spark, store.load()) == scanned(spark, tmp_path) and made == [list(range(20))]
    first = chunked(spark, store.load())
    # Nothing changed: nothing is read and nothing written.
    entry = store.refresh(str(source))
    assert len(made) == 1 and entry["version"] == 1
    # Another file: only its rows are read.
    documents(spark, source, (100, "second " + LONG), (101, None), (102, " "))
    entry = store.refresh(str(source))
    assert made[1:] == [[100, 101, 102]] and chunked(spark, store.load()) == scanned(spark, tmp_path)
    assert chunked(spark, store.load(1)) == first  # an older version stays readable
    # A file rewritten in place: of its blocks, the changed one is chunked again, those that went go.
    (name,) = [f for f in os.listdir(source) if f.endswith(".parquet") and 20 == spark.read.parquet(str(source / f)).count()]
    part = tmp_path / "part"
    documents(spark, part, *[(i, f"{'changed' if i == 3 else 'first'} {i} " + LONG) for i in range(15)])
    (new,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
    for old in (source / name, source / f".{name}.crc"):
        old.unlink()
    shutil.copy(part / new, source / name)
    counts = []
    monkeypatch.setattr("tidemark.sources.maintained.chunk", lambda df, *a, **k: (counts.append({r.note_id for r in df.collect()}), __import__("tidemark.operators.chunk", fromlist=["chunk"]).chunk(df, *a, **k))[1])
    store.refresh(str(source))
    assert chunked(spark, store.load()) == scanned(spark, tmp_path) and counts == [{"n3"}]
    # The index follows: what it finds is what a scan finds.
    for q in ("changed first", "second", "first 17", "word"):
        got = grams.indexed_search(store.load(), store.index(), q, 1000)
        assert {r.chunk_id for r in got.collect()} == {r.chunk_id for r in lexical.keyword_search(store.load(), q, 1000).collect()}


def test_queries_answer_from_the_files_as_they_are(spark, tmp_path):
    """Today's question over a folder whose file was replaced in the same session."""
    folder = tmp_path / "documents.parquet"
    documents(spark, folder, *[(i, "the thing of another " + "x" * i) for i in range(30)])
    assert QUERIES["keyword_topk"](spark, str(tmp_path)).count() == 20
    shutil.rmtree(folder)
    documents(spark, folder, *[(i, "the thing of another") for i in range(3)])
    assert QUERIES["keyword_topk"](spark, str(tmp_path)).count() == 3 == QUERIES["note_rows"](spark, str(tmp_path)).count()
