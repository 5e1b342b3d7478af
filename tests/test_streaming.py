import datetime

from pyspark.sql import functions as F

from tidemark.operators import derive
from tidemark.sources import io
from tidemark.streaming import edits


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def rows_of(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_debounce(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(0.3)), ("b", at(0.5)), ("a", at(2)), ("a", at(60))]
    batch = edits.debounce(spark.createDataFrame(rows, "note_id string, ts timestamp"))
    assert sorted((r.note_id, r.edits) for r in batch.collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
    together = edits.debounce(spark.createDataFrame(rows, "note_id string, ts timestamp"), per_note=False).orderBy("started").collect()
    assert [(r.edits, r.notes) for r in together] == [(3, ["a", "b"]), (1, ["a"]), (1, ["a"])]
    s = edits.debounce(stream(spark, str(tmp_path / "e"), rows, "note_id string, ts timestamp"))
    assert sorted((r.note_id, r.edits) for r in rows_of(spark, s, "debounced")) == [("a", 1), ("a", 2), ("b", 1)]  # the last burst may still grow


def test_deduplicate(spark, tmp_path):
    schema = "note_id string, block_id string, chunk_index int, content_hash string, embedding_version string, ts timestamp"
    rows = [("n", "b", 0, "h", "e", at(i)) for i in range(3)] + [("n", "b", 0, "h2", "e", at(1))]
    assert len(rows_of(spark, edits.deduplicate(stream(spark, str(tmp_path / "j"), rows, schema)), "deduplicated")) == 2


def test_last_traces(spark, tmp_path):
    rows = [("k", i, f"p{i}") for i in range(30)] + [("m", 1, "x")]
    want = {("k", i + 1, f"p{29 - i}") for i in range(5)} | {("m", 1, "x")}
    df = spark.createDataFrame(rows, "key string, at long, payload string")
    assert {(r.key, r.place, r.payload) for r in edits.last_traces_by_batch(df, 5).collect()} == want


def appended(spark, path, df_rows, schema):
    spark.createDataFrame(df_rows, schema).coalesce(1).write.mode("append").parquet(path)


def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_jobs_in_flight(spark, tmp_path):
    """A key is taken until its job ends, across batches as within one; the batch form says the same."""
    schema = "job_key string, at long, n long, event string"
    first = [("k", 1, 0, "submitted"), ("k", 2, 0, "submitted"), ("k", 3, 0, "attempt"), ("m", 1, 0, "failed"), ("m", 2, 0, "submitted"), ("m", 3, 0, "cancelled"), ("m", 3, 1, "submitted")]
    second = [("k", 9, 0, "submitted"), ("k", 10, 0, "succeeded"), ("k", 11, 0, "submitted"), ("k", 12, 0, "submitted"), ("m", 8, 0, "submitted")]
    want = {("k", 1, False, 1), ("k", 2, True, 1), ("k", 9, True, 1), ("k", 11, False, 11), ("k", 12, True, 11), ("m", 2, False, 2), ("m", 3, False, 3), ("m", 8, True, 3)}
    rows = lambda found: {(r.job_key, r.at, r.deduplicated, r.started) for r in found}
    assert rows(edits.in_flight(spark.createDataFrame(first + second, schema)).collect()) == want
    stateful(spark)
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in (first, second):
        appended(spark, path, part, schema)
        found = edits.in_flight(spark.readStream.schema(schema).parquet(path))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.read.parquet(out).collect()) == want


def test_lists_in_two_stages(spark, tmp_path):
    schema = "search_id string, stage string, at long, rank int, note_id string"
    keyword = [(q, "keyword", 1000, i, n) for q in ("fast", "slow") for i, n in enumerate("ab", 1)]
    hybrid = [("fast", "hybrid", 2500, 1, "b"), ("fast", "hybrid", 2500, 2, "c"), ("slow", "hybrid", 2501, 1, "c"), ("slow", "hybrid", 2501, 2, "b"), ("slow", "hybrid", 2501, 3, "d"), ("none", "hybrid", 9000, 1, "z")]
    stateful(spark)
    path, lists = str(tmp_path / "in"), []
    for part in (keyword, hybrid):
        appended(spark, path, part, schema)
        q = edits.two_stage(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        q.foreachBatch(lambda df, _: lists.extend(df.orderBy("search_id", "place").collect())).trigger(availableNow=True).start().awaitTermination(120)
    shown = lambda some: [(r.search_id, r.note_id, r.appended) for r in some]
    assert shown(lists[:4]) == [("fast", "a", False), ("fast", "b", False), ("slow", "a", False), ("slow", "b", False)]
    assert shown(lists[4:]) == [("fast", "b", False), ("fast", "c", False), ("none", "z", False), ("slow", "a", False), ("slow", "b", False), ("slow", "c", True), ("slow", "d", True)]


def test_last_traces_as_a_stream(spark, tmp_path):
    schema = "key string, at long, payload string"
    stateful(spark)
    path, found = str(tmp_path / "in"), []
    for part in ([("k", i, f"p{i}") for i in range(4)], [("k", 9, "p9"), ("m", 1, "x")]):
        appended(spark, path, part, schema)
        q = edits.last_traces(spark.readStream.schema(schema).parquet(path), 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        q.foreachBatch(lambda df, _: found.append({(r.key, r.place, r.payload) for r in df.collect()})).trigger(availableNow=True).start().awaitTermination(120)
    assert found == [{("k", 1, "p3"), ("k", 2, "p2"), ("k", 3, "p1")}, {("k", 1, "p9"), ("k", 2, "p3"), ("k", 3, "p2"), ("m", 1, "x")}]


def test_maintained_store(spark, tmp_path):
    """Orphans go first, pending chunks are embedded once, and a second run over the same edits writes nothing new."""
    chunks = spark.createDataFrame([("n1/b/0", "n1", "b", "h1", "t1", "s"), ("n2/b/0", "n2", "b", "h2", "t2", "s")], "chunk_id string, note_id string, block_id string, content_hash string, text string, strategy string")
    fields = "chunk_id string, note_id string, block_id string, content_hash string, chunk_strategy string, vector array<double>, created_at int, embedding_version string"
    store = io.DerivedStore(spark, str(tmp_path / "store"), spark.createDataFrame([], fields).schema)
    store.upsert(spark.createDataFrame([("n1/b/9", "n1", "b", "x", "s", [0.0], 1, "e1"), ("n3/b/0", "n3", "b", "y", "s", [0.0], 1, "e1")], fields))
    calls = []

    def embed(pending):
        calls.append(pending.count())
        return pending.select("chunk_id", "note_id", "block_id", "content_hash", F.col("strategy").alias("chunk_strategy"), F.array(F.lit(1.0)).alias("vector"), F.lit(2).alias("created_at"))

    def run(n):
        s = stream(spark, str(tmp_path / "edits"), [("n1",), ("n2",)], "note_id string")
        q = edits.maintain(s, lambda notes: chunks.join(notes, "note_id", "left_semi"), store.load, store.delete, embed, store.upsert, "e1", str(tmp_path / f"c{n}"))
        q.awaitTermination(120)

    run(1)
    assert {r.chunk_id for r in store.load("e1").collect()} == {"n1/b/0", "n2/b/0", "n3/b/0"}
    run(2)
    assert calls == [2, 0] and store.load("e2").count() == 0


def test_run_jobs(spark):
    jobs = spark.createDataFrame([(str(i), f"t{i}") for i in range(5)], "chunk_id string, text string").coalesce(1)

    def flaky(texts, seen=[]):  # noqa: B006
        seen.append(1)
        if len(seen) < 3:
            raise ConnectionError
        return [[float(len(t))] for t in texts]

    out = edits.run_jobs(jobs, flaky, wait=0.01, running=None).collect()
    assert {r.tries for r in out} == {3} and all(r.vector == [2.0] for r in out)

    def refused(texts):
        raise ValueError

    def busy(texts):
        raise edits.RateLimitedError

    assert {(r.tries, r.error) for r in edits.run_jobs(jobs, busy, wait=0.01).collect()} == {(3, "RateLimitedError")}
    assert {(r.tries, r.vector) for r in edits.run_jobs(jobs, refused).select("tries", F.col("vector").cast("string").alias("vector")).collect()} == {(1, None)}


def test_dataset_and_documents(spark, tmp_path):
    (tmp_path / "set.json").write_text(
        '{"version":"1","notes":[{"id":"a","title":"t","content":"c"}],"candidates":[{"id":"c1","query":"q","expectedNoteIDs":["a"],"isRegression":true},'
        '{"id":"c2","query":"q","relevance":{"a":1,"b":3,"c":2},"split":"holdout"}],\n"negatives":[{"id":"n1","query":"z"}]}'
    )
    d = io.eval_dataset(spark, str(tmp_path / "set.json"))
    got = {r.case_id: (r.expected, r.origin, r.split) for r in io.dataset_cases(d).collect()}
    assert got == {"c1": (["a"], "regression", "development"), "c2": (["b", "c"], "golden", "holdout"), "n1": ([], "golden", "development")}
    assert io.dataset_notes(d).count() == 1 and io.dataset_cases(d, "holdout").count() == 1
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.MD").write_text("# hi")
    (folder / "b.pdf").write_bytes(b"%PDF")
    assert {(r.file_name, r.extracted_text, r.extraction_unavailable) for r in io.documents(spark, str(folder)).collect()} == {("a.MD", "# hi", False), ("b.pdf", None, True)}


def test_ocr_overlay(spark):
    blocks = spark.createDataFrame([("n", "b", "h"), ("n", "c", "h")], "note_id string, block_id string, content_hash string")
    overlay = spark.createDataFrame([("n", "b", "h", "sign"), ("n", "c", "old", "gone")], "note_id string, block_id string, content_hash string, text string")
    assert {r.block_id: r.ocr for r in io.ocr_text(blocks, overlay).collect()} == {"b": "sign", "c": None}
    assert {r.block_id: r.ocr for r in io.ocr_text(blocks, overlay, check_hash=False).collect()} == {"b": "sign", "c": "gone"}


def test_store_mutations(spark):
    df = spark.createDataFrame([("a", "n"), ("b", "m")], "chunk_id string, note_id string")
    assert derive.remove(df, df.filter("note_id = 'n'"), "note_id").count() == 1


def test_store_touches_only_the_buckets_of_its_notes(spark, tmp_path):
    import os

    schema = "chunk_id string, note_id string, block_id string, content_hash string, embedding_version string, vector array<double>, created_at int"
    rows = lambda *x: spark.createDataFrame([(c, n, "b" + c, "h", v, [1.0], t) for c, n, v, t in x], schema)
    path = str(tmp_path / "store")
    store = io.DerivedStore(spark, path, rows(("x", "n", "e1", 1)).schema, buckets=8)
    assert store.load().count() == 0
    store.upsert(rows(*[(f"c{i}", f"n{i % 20}", "e1", 1) for i in range(60)]))
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    before = files()
    store.upsert(rows(("c3", "n3", "e2", 2), ("new", "n3", "e1", 2)))
    assert len(before - files()) < len(before) / 2 and before & files()
    have = {(r.chunk_id, r.embedding_version) for r in store.load().collect()}
    assert len(have) == 61 and ("c3", "e2") in have and ("c3", "e1") not in have and store.load("e2").count() == 1
    assert {r.chunk_id for r in store.load(note_id="n3").collect()} == {"c3", "c23", "c43", "new"}
    store.delete(spark.createDataFrame([("c3",), ("c4",)], "chunk_id string"))
    store.delete(spark.createDataFrame([("n5",)], "note_id string"), "note_id")
    assert store.load("e2").count() == 0 and store.load().count() == 56 and "n5" not in {r.note_id for r in store.note_ids().collect()}
    assert [r.chunk_id for r in store.chunk_ids("bnew").collect()] == ["new"]
    store.clear()
    assert store.load().count() == 0
