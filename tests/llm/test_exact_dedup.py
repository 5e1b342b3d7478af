import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


TEXTS = [(5, "a  b"), (2, "a b"), (9, "a\tb"), (7, "A b"), (3, None), (4, ""), (6, " "), (8, "\n\n"), (1, "long " * 20_000), (11, "long " * 20_000), (12, "x y"), (13, "x y")]


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    return {i: (min(by[norm(t)]), len(by[norm(t)])) for i, t in rows}


def test_groups_equal_brute_force(spark, docs):
    out = exact_dedup.exact_groups(docs(*TEXTS)).collect()
    assert {r.id: (r.keep_id, r.group_size) for r in out} == groups(TEXTS)
    assert {r.id: bytes(r.digest).hex() for r in out} == {i: hashlib.sha256(norm(t).encode()).hexdigest() for i, t in TEXTS}


def test_texts_with_one_digest_stay_apart(spark, docs):
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 0))  # noqa: E731  all digests alike
    out = exact_dedup.exact_groups(docs(*TEXTS), digest=lambda c: F.coalesce(weak(c), F.lit(b"")))
    assert {r.id: (r.keep_id, r.group_size) for r in out.collect()} == groups(TEXTS)


def entries_of(docs, rows):
    return docs(*rows).select(F.col("doc_id").alias("id"), exact_dedup.sha256(exact_dedup.normalised(F.col("text"))).alias("digest"))


def test_later_batches_are_looked_up_in_all_runs(spark, docs, monkeypatch):
    index = exact_dedup.MergeIndex(spark)
    assert index.lookup(entries_of(docs, TEXTS)).count() == 0 and index.compact().count() == 0
    index.flush(entries_of(docs, TEXTS[:4]))
    index.flush(entries_of(docs, TEXTS[4:5]))
    index.flush(entries_of(docs, TEXTS[:0]))
    assert [r.entries for r in index.runs] == [2, 1]
    have = groups(TEXTS[:5])
    by = {norm(t): have[i] for i, t in TEXTS[:5]}
    rows = [*TEXTS[5:], (5, "a b"), (5, "a b")]
    want = sorted((i, *by[norm(t)]) for i, t in rows if norm(t) in by)
    for bits, hot in ((exact_dedup.SLICE_BITS, exact_dedup.HOT_ROWS), (64, 0)):  # a filter that lets everything through changes nothing
        monkeypatch.setattr(exact_dedup, "SLICE_BITS", bits)
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
        for run in index.runs:
            run._filter = None
        assert sorted((r.id, r.keep, r.n) for r in index.lookup(entries_of(docs, rows)).collect()) == want
    index.flush(entries_of(docs, TEXTS[5:]))
    merged = {bytes(r.digest).hex(): (r.keep, r.n) for r in index.compact().collect()}
    whole = groups(TEXTS)
    assert merged == {hashlib.sha256(norm(t).encode()).hexdigest(): whole[i] for i, t in TEXTS}


def test_a_small_batch_rewrites_no_large_run(spark):
    batch = lambda lo, hi: spark.range(lo, hi).select("id", F.unhex(F.sha2((F.col("id") % 2000).cast("string"), 256)).alias("digest"))
    index = exact_dedup.MergeIndex(spark)
    index.flush(batch(0, 1000))
    for i in range(4):
        before = index.written
        index.flush(batch(1000 + 20 * i, 1020 + 20 * i))
        assert index.written - before <= 20 * (1 + 2 + 4) and index.runs[0].entries == 1000
    sizes = [r.entries for r in index.runs]
    assert sizes == [1000, 80] and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    # All runs answer: the ids 1000 to 1009 are in a late run, those from 2000 on repeat the first one's digests, 1200 to 1209 are in none.
    asked = batch(1000, 1010).unionByName(batch(2000, 2010)).unionByName(batch(1200, 1210))
    assert sorted((r.id, r.keep) for r in index.lookup(asked).collect()) == [*((i, i) for i in range(1000, 1010)), *((i, i - 2000) for i in range(2000, 2010))]
    assert index.compact().count() == 1080 and len(index.runs) == 1


def test_runs_are_merged_without_exchange_or_sort(spark):
    index = exact_dedup.MergeIndex(spark)
    for lo, hi in ((0, 3000), (2900, 3900)):
        index.flush(spark.range(lo, hi).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")))
    a, b = index.runs
    with exact_dedup._sorted_scans(spark):
        plan = index.merged(a.rows, b.rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    files = [[bytes(r.digest) for r in spark.read.parquet(f).collect()] for f in index.compact().inputFiles()]
    assert len(files) <= index.buckets and all(f == sorted(f) for f in files) and sum(map(len, files)) == 3900


def test_filters_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLICE_BITS", 1 << 11)
    df = spark.range(3000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(1).alias("bits"))
    for slices in (8, 512):
        bits = exact_dedup.Filter.of(df.filter("id < 500"), 500 * slices // 8)
        assert bits.slices >= min(slices, 4) and bits.rows.count() == bits.slices
        passed = exact_dedup.Filter.passing(bits, df)
        ids = {r.id for r in passed.collect()}
        assert passed.columns == df.columns and ids >= set(range(500)) and len(ids) < 900
    assert exact_dedup.Filter.of(df.limit(0), 0).passing(df).count() == 0


def test_drop_copies(spark, docs):
    rows = [*TEXTS, (2, "a b"), (7, "a b"), (None, "a b"), (None, "only"), (None, "only")]
    odd = docs(*rows).withColumns({"digest": F.lit(1), "keep": F.lit(2), "n": F.lit(3), "id": F.lit(4)})
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id or 0), norm(r.text)[:9]) for r in kept.collect()) == sorted([(2, "a b"), (7, "A b"), (3, ""), (6, " "), (1, "long long"), (12, "x y"), (13, "x y"), (0, "only")])
    assert exact_dedup.drop_copies(odd.limit(0)).count() == 0
