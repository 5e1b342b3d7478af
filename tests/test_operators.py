import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import TERMINATORS
from tidemark.operators import chunk, derive, diff, evaluate, fuse, gate, grams, lexical, notes, present, ranks, registry, stats, vector


def plain_fixed(text, size=240, overlap=40):
    if len(text) <= size:
        return [(0, len(text))] if text else []
    out, start = [], 0
    while start < len(text):
        end = hard = min(start + size, len(text))
        if hard < len(text):
            for p in range(hard - 1, max(hard - max(1, size // 4), start), -1):
                if text[p] in TERMINATORS:
                    end = p + 1
                    break
        out.append((start, end))
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def random_text(n):
    return "".join(random.choices("abc .!\n。", weights=(5, 5, 5, 5, 1, 1, 1, 1), k=n))


@pytest.mark.parametrize("size, overlap", [(240, 40), (20, 5), (10, 9), (7, 0)])
def test_fixed_pieces(spark, size, overlap):
    random.seed(size)
    texts = [random_text(n) for n in (0, 1, 6, 7, 8, 19, 20, 21, 100, 500, 700)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in chunk.fixed_chunks(df, size, overlap, "t").orderBy("i", "chunk_index").collect():
        got.setdefault(r.i, []).append((r.chunk_index, r.s, r.e, r.t))
    for i, t in enumerate(texts):
        want = [(s, e, t[s:e].strip()) for s, e in plain_fixed(t, size, overlap) if t[s:e].strip()]
        assert got.get(i, []) == [(k, *w) for k, w in enumerate(want)]


def test_sentences_and_dense_numbers(spark):
    df = spark.createDataFrame([("n", "b", 0, "text", "One. Two! " + "x" * 50 + ". end", "h")], "note_id string, block_id string, ord int, source string, text string, content_hash string")
    got = [(r.chunk_id, r.text, r.char_start, r.char_end) for r in chunk.chunk(df, "sentence", 12).orderBy("chunk_index").collect()]
    assert got == [("n/b/0", "One. Two!", 0, 9), ("n/b/1", "x" * 50 + ".", 9, 61), ("n/b/2", "end", 61, 65)]
    blank = df.withColumn("text", F.concat(F.lit("a."), F.lit(" " * 300), F.lit("b")))
    assert [r.chunk_index for r in chunk.chunk(blank, "fixed", 20, 0).orderBy("chunk_index").collect()] == [0, 1]


def test_bigram_coverage(spark):
    df = spark.createDataFrame([("1", "组会改到周四下午", "text"), ("2", "组会改天", "text"), ("3", "组会改到周四", "ocr")], "chunk_id string, text string, source string")
    hits = lexical.keyword_search(df, "组会改到周四", 10).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["1", "3"]
    assert hits[0].score == pytest.approx(5 / 8**0.5) and hits[1].score == pytest.approx(5 / 6**0.5 * 0.85)
    assert lexical.keyword_search(df, " ", 10).count() == 0


def test_tf_does_not_overlap(spark):
    df = spark.createDataFrame([("aaaa",)], "h string")
    assert df.select(lexical.term_frequency(F.col("h"), "aa")).first()[0] == 2
    assert [tuple(r) for r in df.select(lexical.match_ranges(F.col("h"), ["aa", "a"]).alias("r")).first().r] == [(0, 4)]
    assert lexical.merged_places("ab ab xab", ["ab", "b x"]) == [(0, 2), (3, 9)]


def test_batch_search_equals_single_searches(spark):
    random.seed(12)
    letters = "组会改到周四下午讨论abc de"
    texts = ["".join(random.choices(letters, k=random.randrange(60))) for _ in range(120)] + ["", "aaaa"]
    chunks = spark.createDataFrame([(f"c{i:03}", f"n{i}", "b", random.choice(list(lexical.SOURCE_WEIGHT)), t) for i, t in enumerate(texts)], "chunk_id string, note_id string, block_id string, source string, text string").repartition(3)
    queries = ["组会改到周四", "周四 ab", "a b c de", "讨", "讨 a", "aa a", "", None, "ab", "会改 下午讨论", "，四下"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for k in (3, 200):
        got = {}
        for r in grams.keyword_batch(chunks, q, k).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, round(r.score, 9)))
        for i, text in enumerate(queries):
            want = [(r.rank, r.chunk_id, round(r.score, 9)) for r in lexical.keyword_search(chunks, text or "", k).collect()]
            assert sorted(got.get(i, [])) == sorted(want), text
    assert grams.keyword_batch(chunks, q.limit(0), 3).count() == 0


def test_containing(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "she sells hers"), (2, None), (3, ""), (4, "he")], "text_id long, text string")
    patterns = spark.createDataFrame([("a", "he"), ("b", "hers"), ("c", "he"), ("d", ""), ("e", None), ("f", "x")], "pattern_id string, pattern string")
    for most in (lexical.PATTERN_CHARS, 2):
        monkeypatch.setattr(lexical, "PATTERN_CHARS", most)
        assert {tuple(r) for r in lexical.containing(texts, patterns).collect()} == {("a", 1), ("c", 1), ("b", 1), ("a", 4), ("c", 4)}
    assert lexical.containing(texts, patterns.limit(0)).count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)).round(1))] + [(100, [0.0] * 8), (101, []), (102, None), (103, [1.0, 2.0]), (104, rng.normal(size=8).tolist())]
    rows += [(200 + i, rows[3][1]) for i in range(4)]
    index = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = index.filter("id % 20 = 3 or id in (100, 103)").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))

    def cos(a, b):
        a, b = np.array(a or [], np.float32).astype(float), np.array(b or [], np.float32).astype(float)
        return 0.0 if len(a) != len(b) or not len(a) or not a.any() or not b.any() else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    for block, together, direct in ((vector.BLOCK, 4096, vector.DIRECT), (10, 3, 0)):
        monkeypatch.setattr(vector, "BLOCK", block)
        monkeypatch.setattr(vector, "DIRECT", direct)
        monkeypatch.setattr(vector, "TOGETHER", together)
        got = {(r.query_id, r.rank): (r.id, round(r.similarity, 9)) for r in vector.nearest(index, queries, 7).collect()}
        for q, v in rows:
            if q % 20 == 3 or q in (100, 103):
                want = sorted(((-round(cos(v, w), 12), i) for i, w in rows))[:7]
                assert [got[q, r + 1] for r in range(7)] == [(i, pytest.approx(-s, abs=1e-6)) for s, i in want]


def test_blocks_that_cannot_win_are_skipped(spark, monkeypatch):
    """Vectors in tight groups: the answer is that of a product of matrices, and most blocks are never looked at."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.02, size=(1000, 16))
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    queries = index.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    monkeypatch.setattr(vector, "BLOCK", 20)
    monkeypatch.setattr(vector, "DIRECT", 0)
    got = {(r.query_id, r.rank): r.id for r in vector.nearest(index, queries, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1000, 20):
        want = np.lexsort((np.arange(1000), -np.round(u @ u[q], 12)))[:5]
        assert [got[q, r] for r in range(1, 6)] == want.tolist()
    seen = vector.visits(index, queries, 5).collect()
    assert len(seen) == 50 and sum(r.visited for r in seen) < 0.3 * sum(r.blocks for r in seen)


def test_percentiles_and_calibration(spark, monkeypatch):
    random.seed(13)
    rows = [(random.choice(["a", "b", None]), random.choice([float(random.randrange(20)), random.random(), None])) for _ in range(900)] + [("hot", 1.0)] * 500 + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.x, r.y, r.z) for r in evaluate.group_percentiles(df, ["g"], "v", {"x": 0.5, "y": 0.95, "z": 1.0}).collect()}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert got.get(g) == (tuple(v[min(len(v) - 1, int(len(v) * s))] for s in (0.5, 0.95, 1.0)) if v else None)
    assert evaluate.group_percentiles(df, [], "v", {"m": 0.5}).first().m == sorted(x for _, x in rows if x is not None)[sum(x is not None for _, x in rows) // 2]
    s = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.7), (False, 0.4), (False, 0.1)], "is_positive boolean, top1 double")
    r = evaluate.calibration(s).first()
    assert (r.positive_min, r.negative_max, r.negatives_below, r.positive_median, r.negative_median) == (0.5, 0.7, 2, 0.9, 0.4) and r.safety_margin == pytest.approx(0.1)


def test_peak_of_running_jobs(spark, monkeypatch):
    monkeypatch.setattr(derive, "SLICE", 4)
    log = [(0, "a", "submitted"), (1, "a", "attempt"), (2, "b", "attempt"), (3, "a", "attempt"), (5, "a", "succeeded"), (5, "c", "attempt"), (6, "b", "failed"), (9, "c", "cancelled"), (9, "d", "cancelled")]
    r = derive.job_statistics(spark.createDataFrame(log, "at long, job_key string, event string")).first()
    assert (r.attempt, r.succeeded, r.cancelled, r.peak) == (4, 1, 2, 2)


def test_startup_reconciles_before_it_scans(spark):
    live = spark.createDataFrame([("a",)], "note_id string")
    have = [("a", "x"), ("gone", "y")]
    deleted = []

    def delete(gone):
        deleted.extend(r.note_id for r in gone.collect())
        have[:] = [h for h in have if h[0] not in deleted]

    load = lambda: spark.createDataFrame(have, "note_id string, chunk_id string")
    assert [r.chunk_id for r in derive.start(load, live, delete, lambda stored: stored).collect()] == ["x"] and deleted == ["gone"]
    have[:], deleted[:] = [("a", "x")], []
    assert derive.start(load, live.limit(0), delete, lambda stored: stored).count() == 1 and not deleted


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.5**0.5), 0.0, 0.0, 0.0]


def test_fusion_ties_and_dead_ids(spark):
    kw = spark.createDataFrame([("a", 1), ("b", 2)], "id string, keyword_rank int")
    vec = spark.createDataFrame([("b", 1), ("c", 2)], "id string, vector_rank int")
    f = fuse.fuse(kw, vec, fuse.rrf(F.col("keyword_rank"), F.col("vector_rank")))
    assert [r.id for r in f.orderBy("fused_rank").collect()] == ["b", "a", "c"]
    live = spark.createDataFrame([("a",), ("c",)], "id string")
    assert [(r.id, r.final_rank) for r in fuse.live_top(f, live, 2).orderBy("final_rank").collect()] == [("a", 1), ("c", 2)]
    assert fuse.candidates(20) == 60 and fuse.candidates(3) == 13


def excerpts_of(spark, rows, budget):
    df = spark.createDataFrame([(i, t, [{"s": a, "e": b} for a, b in sp]) for i, (t, sp) in enumerate(rows)], "i int, text string, spans array<struct<s:int,e:int>>")
    return [(r.excerpt, [(h.s, h.e) for h in r.highlights]) for r in present.excerpts(df, budget=budget).orderBy("i").collect()]


def test_excerpt_invariants(spark):
    random.seed(9)
    for budget in (1, 10, 44):
        rows = []
        for _ in range(150):
            text = "".join(random.choices("ab ,.\n", k=random.randrange(150)))
            spans = [(s, min(len(text), s + random.randrange(1, 12))) for s in (random.randrange(150) for _ in range(random.randrange(9))) if s < len(text)]
            rows.append((text, spans))
        for (text, spans), (out, marks) in zip(rows, excerpts_of(spark, rows, budget), strict=True):
            flat = " ".join(text.split())
            body = out.strip("…")
            assert body in flat and "\n" not in out
            assert len(marks) <= present.MAX_HIGHLIGHTS and all(0 <= s < e <= len(out) for s, e in marks)
            assert all(a[1] < b[0] for a, b in zip(marks, marks[1:], strict=False))
            if len(flat) <= max(present.LEAST_BUDGET, budget):
                assert out == flat
            hit = [text[s:e].split() for s, e in spans]
            assert not hit or marks or not any(hit) or len(flat) > len(out)


def test_excerpt_windows(spark):
    text = "x" * 60 + " needle " + "y" * 60
    ((out, marks), short, none) = excerpts_of(spark, [(text, [(61, 67)]), ("  a \n b  ", [(2, 3)]), (None, [])], 30)
    assert out.startswith("…") and out.endswith("…") and out[slice(*marks[0])] == "needle"
    assert short == ("a b", [(0, 1)]) and none == ("", [])
    # Edges go to the end of a clause nearby, and never through a hit.
    text = "a" * 45 + ", b needles " + "c" * 8 + "." + "d" * 40
    ((snapped, at),) = excerpts_of(spark, [(text, [(49, 56)])], 30)
    assert snapped == "… b needles cccccccc.…" and snapped[slice(*at[0])] == "needles"
    text = "one two three four five six seven. eight nine ten needles eleven twelve, thirteen fourteen"
    ((grown, at),) = excerpts_of(spark, [(text, [(0, 3), (25, 40)])], 30)
    assert grown.startswith("one") and grown.rstrip("…").endswith(text[25:40])


def test_tags(spark):
    df = spark.createDataFrame([(["A  b", "é", "a B", " ", "E"], ["x", "É"])], "a array<string>, b array<string>")
    r = df.select(notes.sanitize_tags(F.col("a")).alias("s"), notes.merge_tags(F.col("a"), F.col("b")).alias("m"), notes.remove_tag(F.col("a"), F.lit("e")).alias("r"), notes.has_tag(F.col("a"), F.lit("a b")).alias("h")).first()
    assert r.s == ["A b", "é"] and r.m == ["A b", "é", "x"] and "é" not in r.r and "E" not in r.r
    assert r.h  # by "a B"
    assert not spark.createDataFrame([(["A  b"],)], "a array<string>").select(notes.has_tag(F.col("a"), F.lit("a b"))).first()[0]  # keys keep white space inside


def test_work_plan_is_idempotent(spark):
    chunks = spark.createDataFrame([("a", "h1", "s"), ("b", "h2", "s")], "chunk_id string, content_hash string, strategy string")
    stored = spark.createDataFrame([("a", "h0", "e", "s"), ("z", "h", "e", "s")], "chunk_id string, content_hash string, embedding_version string, chunk_strategy string")
    assert {(r.chunk_id, r.state) for r in derive.work_plan(chunks, stored, "e").collect()} == {("a", "pending"), ("b", "pending"), ("z", "orphan")}
    done = chunks.select("chunk_id", "content_hash", F.lit("e").alias("embedding_version"), F.col("strategy").alias("chunk_strategy"))
    assert {r.state for r in derive.work_plan(chunks, done, "e").collect()} == {"up_to_date"}


def test_empty_library_is_not_reconciled(spark):
    live = spark.createDataFrame([], "note_id string")
    some = spark.createDataFrame([("a",)], "note_id string")
    r = derive.consistency(live, derive.orphans(live, embeddings=some)).first()
    assert (r.live_notes, r.orphan_notes, r.is_consistent, r.is_safe) == (0, 1, False, False)


def test_small_edits_accumulate(spark):
    schema = "note_id string, block_id string, hash string, kind string, brief string, text_length int"
    old = spark.createDataFrame([("n", "b", "h", "text", "t", 100)], schema)
    small = old.withColumns({"hash": F.lit("i"), "text_length": F.lit(105)})
    large = old.withColumns({"hash": F.lit("j"), "text_length": F.lit(112)})
    says = lambda new: [r.significant for r in diff.significance(diff.snapshot_diff(new, old)).collect()]
    assert says(small) == [False] and says(large) == [True] and says(old) == [] and says(old.limit(0)) == [True]


def test_snapshot_moves_on_only_if_significant(spark):
    schema = "note_id string, block_id string, hash string, kind string, brief string, text_length int"
    old = spark.createDataFrame([("a", "b", "h", "text", "t", 100), ("b", "b", "h", "text", "t", 100)], schema)
    new = spark.createDataFrame([("a", "b", "i", "text", "t", 105), ("b", "b", "i", "text", "t", 150), ("c", "b", "i", "text", "t", 1)], schema)
    after = diff.next_snapshot(new, old, diff.significance(diff.snapshot_diff(new, old)))
    assert sorted((r.note_id, r.text_length) for r in after.collect()) == [("a", 100), ("b", 150), ("c", 1)]


def test_counter_draws_equal_a_sequential_generator():
    state, mask, want = stats.SEED, (1 << 64) - 1, []
    for _ in range(500):
        state = (state + stats.GAMMA) & mask
        z = ((state ^ (state >> 30)) * stats.MIX1) & mask
        z = ((z ^ (z >> 27)) * stats.MIX2) & mask
        want.append((z ^ (z >> 31)) % 37)
    assert stats.draws(np.arange(1, 501), 37).tolist() == want


def test_bootstrap(spark):
    rng = random.Random(2)
    rows = [(f"c{i:02}", "in_scope", True, 1, rng.random() < 0.5, rng.random()) for i in range(30)]
    schema = "case_id string, scope string, is_positive boolean, expected_count int, hit_at1 boolean, reciprocal_rank double"
    cur = spark.createDataFrame(rows, schema)
    base = cur.withColumn("reciprocal_rank", F.col("reciprocal_rank") * 0.5)
    r = stats.bootstrap(cur, base, "reciprocal_rank").first()
    x = np.array([row[5] / 2 for row in rows])
    means = np.sort(np.cumsum(x[stats.draws(np.arange(1, 2000 * 30 + 1), 30).reshape(2000, 30)], axis=1)[:, -1] / 30)
    assert (r.lower, r.upper, r.pairs) == (pytest.approx(means[50]), pytest.approx(means[1950]), 30) and r.delta == pytest.approx(x.mean())
    assert stats.bootstrap(cur.limit(5), base, "reciprocal_rank").count() == 0


def test_intervals_of_several_metrics_over_blocks(spark, monkeypatch):
    """Small blocks change nothing but the order of sums, and each metric has its own pairs."""
    rng = random.Random(6)
    rows = [(f"c{i:02}", "in_scope" if i % 9 else "other", True, 1 + i % 3, rng.random() < 0.5, rng.random()) for i in range(40)]
    schema = "case_id string, scope string, is_positive boolean, expected_count int, hit_at1 boolean, reciprocal_rank double"
    cur = spark.createDataFrame(rows, schema)
    base = cur.withColumns({"reciprocal_rank": F.col("reciprocal_rank") * 0.5, "hit_at1": F.lit(True)}).filter("case_id <> 'c01'")
    monkeypatch.setattr(stats, "BLOCK", 7)
    got = {r.metric: r for r in stats.intervals(cur, base, ["hit_at1", "reciprocal_rank"], rounds=300).collect()}
    for metric, x in (("hit_at1", [float(r[4]) - 1 for r in rows if r[1] == "in_scope" and r[3] == 1 and r[0] != "c01"]), ("reciprocal_rank", [r[5] / 2 for r in rows if r[1] == "in_scope" and r[0] != "c01"])):
        n = len(x)
        means = np.sort(np.array(x)[stats.draws(np.arange(1, 300 * n + 1), n).reshape(300, n)].mean(axis=1))
        r = got[metric]
        assert (r.pairs, r.delta, r.lower, r.upper) == (n, pytest.approx(np.mean(x)), pytest.approx(means[7]), pytest.approx(means[293]))
    now = spark.createDataFrame([(1,)], "cases int")
    r = gate.with_intervals(now, cur.withColumn("hit_at5", F.lit(False)), base.withColumn("hit_at5", F.lit(True))).first()
    assert r.upper_recall_at5 == -1 and r.upper_mrr > 0
    few = gate.with_intervals(now, cur.limit(3).withColumn("hit_at5", F.lit(False)), base.withColumn("hit_at5", F.lit(True))).first()
    assert (few.upper_recall_at1, few.upper_recall_at5, few.upper_mrr) == (None, None, None)


def test_gate(spark):
    schema = "cases long, recall_at1 double, recall_at5 double, mrr double, p50 double, p95 double, regression_rate double"
    base = spark.createDataFrame([(10, 0.5, 0.6, 0.55, 50.0, 100.0, 1.0)], schema)
    t = gate.Thresholds()
    status = lambda cur: tuple(gate.verdict(gate.checks(cur, base, t)).first())
    assert status(base) == ("pass", "")
    assert status(base.withColumn("recall_at5", F.lit(0.59))) == ("blocked", "recall")
    assert status(base.withColumns({"p95": F.lit(251.0), "mrr": F.lit(0.3)})) == ("blocked", "floor,latency,mrr")
    assert status(base.withColumn("cases", F.lit(9))) == ("blocked", "mrr,recall")
    unsure = base.withColumns({"recall_at1": F.lit(0.45), "upper_recall_at1": F.lit(0.01), "upper_recall_at5": F.lit(0.0), "upper_mrr": F.lit(0.0)})
    assert status(unsure) == ("pass", "") and status(unsure.withColumn("upper_recall_at1", F.lit(-0.01))) == ("blocked", "recall")
    assert gate.verdict(base, "no run").first().status == "stale"
    assert gate.disqualified({"build_configuration": "debug"}) and not gate.disqualified({"build_configuration": "release", "device_class": "physical"})


def plain_registry(events, root, config):
    """The rules one after the other, for one registry."""
    production, candidate, configs, promoted, out = root, None, {root: config}, {}, []
    for seq, kind, version, parent, new, of, ok in sorted(events):
        error = None
        if kind == "create":
            error = "unknown_record" if parent not in configs else "version_exists" if version is None or version in configs else None
            configs |= {} if error else {version: new or configs[parent]}
        elif kind == "migrate":
            error = "was_promoted" if production in promoted else "no_change" if configs[production] == new else None
            configs |= {} if error else {production: new}
        elif version not in configs:
            error = "unknown_record"
        elif kind == "nominate":
            error = "cannot_edit_production" if version == production else None
            candidate = candidate if error else version
        elif kind == "promote":
            error = "not_promotable" if version != candidate else "verdict_for_another" if of != version else None if ok else "blocked_by_gate"
            if not error:
                production, candidate, promoted = version, None, promoted | {version: seq}
        elif kind == "remove":
            error = "cannot_edit_production" if version in (production, candidate) else None
            if not error:
                del configs[version]
                promoted.pop(version, None)
        else:
            error = "unknown_event"
        out.append((seq, production, candidate, dict(configs), dict(promoted), error))
    return out


def test_registry(spark, tmp_path):
    rng = random.Random(8)
    kinds, names = ["create", "nominate", "promote", "migrate", "remove", "odd"], ["v0", "v1", "v2", None]
    logs = {r: [(i, rng.choices(kinds, [3, 4, 6, 1, 2, 0.3])[0], rng.choice(names), rng.choice(["v0", "v1", "v8"]), rng.choice(["x", "y", None]), rng.choice(names), rng.choice([True, True, False, None])) for i in range(40)] for r in ("a", "b", "c")}
    for log in logs.values():  # some of what is asked for makes sense
        log[:4] = [(0, "create", "v1", "v0", None, None, None), (1, "nominate", "v1", None, None, None, None), (2, "promote", "v1", None, None, "v1", True), (3, "migrate", None, None, "z", None, None)]
    store = registry.log_table(spark, str(tmp_path / "log"))
    rows = [(r, *e) for r, log in logs.items() for e in log]
    for part in (rows[:50], rows[50:]):
        registry.append(store, spark.createDataFrame(part, registry.LOG))
    after = registry.states(store.load(), "v0", "x")
    got = {}
    for r in after.orderBy("seq").collect():
        got.setdefault(r.registry, []).append((r.seq, r.production, r.candidate, r.configs, r.promoted, r.error))
    assert got == {r: plain_registry(log, "v0", "x") for r, log in logs.items()}
    assert {e for log in got.values() for *_, e in log} >= {None, "unknown_record", "not_promotable", "was_promoted"}
    want = {(r, v, at, v == log[-1][1]) for r, log in got.items() for v, at in log[-1][4].items()}
    assert {tuple(x) for x in registry.history(after).collect()} == want


def test_places_of_any_group(spark):
    """Hot groups, nulls and ties; clashing names; no rows."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1, 2, 3, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, _at int").repartition(7)
    got = ranks.placed(df, ["g"], ["v", "_at"], "p")
    assert got.columns == ["g", "v", "_at", "p"]
    want = {}
    for g, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(g, []).append((v, i))
    assert {(r.g, r.p): (r.v, r["_at"]) for r in got.collect()} == {(g, k): x for g, xs in want.items() for k, x in enumerate(xs)}
    assert sorted((r.g or "", r.p) for r in ranks.placed(df, ["g"], ["v"], "p").collect()) == sorted((g or "", k) for g, xs in want.items() for k in range(len(xs)))
    assert ranks.placed(df.limit(0), ["g"], ["v"], "p").collect() == []
    plan = evaluate.stratified_split(df, "g", "_at")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_lists_in_two_stages(spark):
    kw = spark.createDataFrame([("fast", "a", 1), ("fast", "b", 2), ("slow", "a", 1), ("slow", "b", 2), ("only", "a", 1)], "q string, id string, rank int")
    hy = spark.createDataFrame([("fast", "b", 1, 1500), ("fast", "c", 2, 1500), ("slow", "c", 1, 1501), ("slow", "b", 2, 1501), ("slow", "d", 3, 1501), ("none", "z", 1, 9999)], "q string, id string, rank int, after int")
    got = {}
    for r in present.two_stage(kw, hy, ["q"]).orderBy("place").collect():
        got.setdefault(r.q, []).append((r.id, r.appended))
    assert got == {"fast": [("b", False), ("c", False)], "slow": [("a", False), ("b", False), ("c", True), ("d", True)], "only": [("a", False)], "none": [("z", True)]}


def test_similar_queries(spark):
    """All pairs of different sets by brute force; equal ones are one class, however many."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(1, 7))) for i in range(60)} | {100: "x", 101: "xy", 102: "XY", 103: "", 104: None, 105: "aaaa", 106: "aaaaaa"} | {200 + i: "Alpha  beta" for i in range(2000)}
    df = spark.createDataFrame(list(texts.items()), "id long, query string").repartition(4)
    norm = {i: "".join((x or "").lower().split()) for i, x in texts.items()}
    sets = {i: frozenset(x[k : k + 3] for k in range(len(x) - 2)) or frozenset([x]) for i, x in norm.items() if x}
    least = {}
    for i, g in sets.items():
        least[g] = min(i, least.get(g, i))
    assert {(r.id, r.rep) for r in evaluate.query_classes(df).collect()} == {(i, least[g]) for i, g in sets.items()}
    for t in (0.2, 0.6, 1.0):
        want = {(min(a, b), max(a, b)): len(g & h) / len(g | h) for g, a in least.items() for h, b in least.items() if a < b and len(g & h) / len(g | h) >= t}
        got = {(r.a, r.b): r.similarity for r in evaluate.trigram_similarity(df, t).collect()}
        assert got == pytest.approx(want)


def test_canonical_checksum(spark, tmp_path):
    """The same object whatever its order on disk, by the law of a plain JSON dump with sorted keys."""
    import hashlib
    import json

    from tidemark.sources import io

    notes = [{"id": "b", "title": "周四 \"x\"", "content": "a\n\\ é/"}, {"id": "a", "title": "t", "content": ""}]
    cases = [{"id": "c2", "query": "q", "relevance": {"z": 1, "a": 2}, "expectedNoteIDs": ["b", "a"], "isRegression": True}, {"id": "c1", "query": "r", "expectedNoteIDs": []}]
    whole = {"version": "5", "notes": notes, "candidates": cases, "negatives": [{"id": "n", "query": "z"}]}
    sorted_whole = {**whole, "notes": sorted(notes, key=lambda n: n["id"]), "candidates": sorted(cases, key=lambda c: c["id"])}
    want = "sha256:" + hashlib.sha256(json.dumps(sorted_whole, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    for i, one in enumerate(({**whole, "checksum": "old"}, dict(reversed(sorted_whole.items())))):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(one, indent=1))
        assert evaluate.dataset_checksum(io.eval_dataset(spark, str(path))).first().computed == want


def test_cases_are_added_once(spark):
    schema = "case_id string, query string, expected array<string>"
    have = spark.createDataFrame([("1", "a", ["x", "y"])], schema)
    new = spark.createDataFrame([("2", " a ", ["y", "x"]), ("3", "a", ["x"]), ("4", "a ", ["x"])], schema)
    assert evaluate.add_cases(have, new).count() == 2


def test_abstention(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, None), ("b", 0.6, None), ("b", 0.59, None), ("c", None, 1), ("d", 0.3, None)]
    s = evaluate.abstention_signals(spark.createDataFrame(rows, "query_id string, similarity double, keyword_rank int"))
    got = {r.query_id: r.c for r in s.select("query_id", evaluate.abstain(floor=0.4, min_margin=0.1).alias("c")).collect()}
    assert got == {"a": "confident", "b": "abstain", "c": "confident", "d": "abstain"}
    assert {r.c for r in s.select(evaluate.abstain().alias("c")).collect()} == {"confident"}
