import os
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    planted = docs.filter("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 10_000)
    near = docs.filter("doc_id = 5").withColumns({"doc_id": F.lit(20_000).cast("long"), "text": F.concat("text", F.lit(" end"))})
    now = docs.unionByName(planted).unionByName(near).withColumn("extra", F.lit(1)).cache()
    seen = []
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, DATA).cache()
        assert after.columns == now.columns
        assert not after.exceptAll(now).count() or stage is pipeline.mix
        seen.append({r.doc_id for r in after.select("doc_id").collect()})
        now = after
    assert not seen[1] & {10_000, 10_001, 10_002} and 20_000 not in seen[2] and seen[0] >= seen[1] >= seen[2] >= seen[3]
    assert pipeline.STAGES[-1][1](spark, now, DATA).count() >= now.count()


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and shared ids go through all stages."""
    random.seed(2)
    text = lambda n: " ".join(f"w{random.randrange(500)}" for _ in range(n))
    long, copy = text(60_000), text(50)
    rows = [(i, text(60), "en", random.choice("abc"), 1) for i in range(40)] + [
        (100, None, None, None, None), (None, text(30), "en", "a", 1), (None, None, None, None, None), (101, "", "en", "b", 0), (102, " \n", "en", "b", 2), (103, long, "en", "c", 9), (104, long + " end", "en", "c", 9),
        (105, copy, "en", "a", 1), (105, copy, "en", "a", 1), (105, text(40), "en", "a", 1), (106, copy + "  ", "en", None, 1), (107, copy.upper(), "en", "a", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("score", "digest", "node", "copies", "salt", "key")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path)).cache()
        assert after.columns == now.columns
        texts[name] = [(r.doc_id, r.text) for r in after.collect()]
        now = after
    exact, near = texts["exact dedup"], texts["simhash near-dedup"]
    assert exact.count((105, copy)) <= 1
    if (105, copy) in near:
        assert not {106, 107} & {i for i, _ in near}
    assert sum(t is not None and len(t) > 100_000 for _, t in near) <= 1
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() >= now.count() or now.count() == 0


def test_empty_table(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
