from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import shards


def check(df, n, slack):
    rows = df.collect()
    sizes, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 16
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / n
    assert all(abs(sizes[s] - mean) <= slack * mean for s in range(n))
    return rows, of


def test_sizes_are_near_equal_and_copies_stay_together(spark, docs):
    rows = [(i, f"text {i // 3} " + "é" * (i // 3 * 7 % 90)) for i in range(6000)] + [(10_000 + i, "hot " * 20) for i in range(3000)] + [(None, None), (None, ""), (1, None)]
    df = docs(*rows)
    out, of = check(shards.shard(df, 8), 8, 0.03)
    assert sum(len(s) > 1 for t, s in of.items() if t != "hot " * 20) <= 1 and len(of["hot " * 20]) > 1
    again = shards.shard(df.repartition(7), 8)
    assert sorted((r.doc_id or -1, r.text or "", r.shard) for r in out) == sorted((r.doc_id or -1, r.text or "", r.shard) for r in again.collect())


def test_edges(spark, docs):
    assert shards.shard(docs((1, "a")).limit(0), 4).count() == 0
    one = shards.shard(docs((1, "a"), (1, "a")), 4).collect()
    assert len(one) == 2
    odd = docs((1, "x" * 300_000), (2, None), (3, "")).withColumns({"key_u": F.lit(1), "cell": F.lit(2), "slot": F.lit(9), "rank": F.lit(3)})
    out = shards.shard(odd, 2)
    assert {"key_u", "cell", "rank", "shard", "slot"} <= set(out.columns) and sorted(r.key_u for r in out.collect()) == [1, 1, 1]
