import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, graph, simhash


def plain_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_links_equal_brute_force():
    rng = np.random.default_rng(1)
    fps = np.repeat(rng.integers(0, 1 << 63, 20, dtype=np.uint64), 15)
    for _ in range(4):
        fps ^= np.where(rng.random(300) < 0.5, np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64), np.uint64(0))
    for starts in ([0], [0, 1, 5, 70, 200, 290]):
        group = np.searchsorted(starts, np.arange(300), side="right")
        for radius in (0, 1, 2, 3, 9, 20):
            want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
            assert {(int(a), int(b)) for i, j in simhash.links(fps, np.array(starts), radius) for a, b in zip(i, j)} == want


def test_exact_links_of_long_texts_take_bounded_memory(monkeypatch):
    """A group of long texts is compared some shingles at a time, with the same links."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    sets = [base[rng.random(len(base)) < keep] for keep in (*[0.95] * 60, *[0.5] * 60)] + [base[:0]] * 2
    ends, values = np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets)
    alone, asks = np.arange(len(sets)), np.ones(len(sets), bool)

    def found():
        tracemalloc.start()
        out = list(simhash.links_of(values, ends, alone, asks, alone, 0.8))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    out, peak = found()
    assert peak < 20e6
    assert sorted(out) == [(0, q) for q in range(1, 60)] + [(120, 121)]
    monkeypatch.setattr(simhash, "VALUES", 1)
    assert found()[0] == out


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    assert got == roots(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_groups_equal_brute_force(spark, docs):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(random.choices(vocabulary, k=600)) for _ in range(12)]
    texts = []
    for t in base:
        for k in range(6):
            words = t.split()
            for _ in range(k):
                words[random.randrange(600)] = random.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", None, " \t\n", "One", "one", "A b", "a  B", base[0].upper(), "x " * 30_000]
    rows = list(enumerate(texts, 10))
    out = {r.id: (r.fp, r.component_id) for r in simhash.fingerprint_groups(docs(*rows)).collect()}
    want = {i: plain_fingerprint(t, 3) for i, t in rows}
    assert {i: fp % (1 << 64) for i, (fp, _) in out.items()} == want
    assert {i: c for i, (_, c) in out.items()} == roots(want, lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    # Fingerprints that all share their upper 32 bits crowd one key; with finer keys no link is lost.
    rng = np.random.default_rng(4)
    fps = sorted({int(x) << 3 & 0xFFFFFFF for x in rng.integers(0, 1 << 12, 90)} | {int(x) for x in rng.integers(0, 1 << 9, 60)})
    text = spark.createDataFrame([(x, x) for x in fps], "node long, fp long")
    keyed = text.select("node", "fp", F.explode(simhash.block_keys("fp", 2, 4)).alias("key"))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    fine = simhash._finer_keys(keyed, 2)
    assert fine.groupBy("key").count().agg(F.max("count")).first()[0] <= 64
    got = {r.node: r.root for r in graph.components(simhash._linked(fine.withColumn("part", F.lit(0)), ["key"], 2)).collect()}
    want = roots(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {x: got.get(x, x) for x in fps} == want


def test_hubs_and_unfinished_components(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(graph, "SMALL_EDGES", 10)
    monkeypatch.setattr(graph, "HOT_ROWS", 20)
    edges = [(1000, i) for i in range(60)] + [(2000, i) for i in range(55, 120)] + [(300 + i, 301 + i) for i in range(20)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    pairs = {frozenset(e) for e in edges}
    assert got == roots(sorted({x for e in edges for x in e}), lambda a, b: frozenset((a, b)) in pairs)
    with pytest.raises(RuntimeError):
        graph.components(df, max_rounds=1)


def likeness(a, b, n=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    x, y = sets
    return 2 * len(x & y) / (len(x) + len(y)) if x | y else 1.0


def test_similar_groups_equal_brute_force(spark, docs):
    random.seed(8)
    texts = []
    for _ in range(10):
        words = [f"w{random.randrange(400)}" for _ in range(200)]
        for k in (0, 1, 2, 3, 4, 6, 9, 15):
            w = list(words)
            for p in random.sample(range(200), k):
                w[p] = f"new{random.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["", None, "one two", "one two", "One TWO", "three", "q " * 60_000, "q " * 59_000]
    rows = list(enumerate(texts))
    got = {r.id: r.component_id for r in simhash.similar_groups(docs(*rows)).collect()}
    assert got == roots(range(len(texts)), lambda a, b: likeness(texts[a], texts[b]) >= 0.8)
    kept = [r.doc_id for r in simhash.drop_near(docs(*rows, (None, "three"), (None, "three"), (None, "none like it"), (None, "none like it"))).collect()]
    assert sorted(kept, key=str) == sorted([*set(got.values()), None], key=str)
    # Rows that share an id are told apart by their texts.
    odd = simhash.drop_near(docs((1, texts[0]), (2, texts[0]), (2, "something else here"), (3, "x " * 40), (3, "x " * 40)))
    assert sorted((r.doc_id, r.text[:5]) for r in odd.collect()) == sorted([(1, texts[0][:5]), (2, "somet"), (3, "x x x")])


def test_similar_groups_count_shingles_once(spark, docs):
    random.seed(9)
    words = [[f"v{i}x{random.randrange(10**6)}" for _ in range(300)] for i in range(4)]
    line = " ".join(f"line{i}" for i in range(10)) + " "
    rows = list(enumerate([" ".join(words[i] + ["spam"] * n) for i in range(4) for n in (6, 400)] + [line * 2, line * 20, "spam " * 6, "spam " * 400]))
    texts = dict(rows)
    got = {r.id: r.component_id for r in simhash.similar_groups(docs(*rows)).collect()}
    assert got == roots(range(len(rows)), lambda a, b: likeness(texts[a], texts[b]) >= 0.8) == {i: i - i % 2 for i in texts}


def test_similar_groups_beyond_the_radius(spark, docs, monkeypatch):
    random.seed(10)
    texts = []
    for i in range(30):  # three and four shingles: 0.857
        words = [f"s{i}w{j}" for j in range(8)]
        texts += [" ".join(words[:7]), " ".join(words)]
    for i in range(4):
        words = [f"t{i}w{j}" for j in range(200)]
        for k in (0, 1, 3, 8, 30):
            texts.append(" ".join("new" + str(random.randrange(10**6)) if p in random.sample(range(200), k) else w for p, w in enumerate(words)))
    rows = list(enumerate(texts))
    want = roots(range(len(texts)), lambda a, b: likeness(texts[a], texts[b]) >= 0.8)
    for block in (simhash.BLOCK, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for radius in (0, simhash.WIDE):
            assert {r.id: r.component_id for r in simhash.similar_groups(docs(*rows), radius=radius).collect()} == want


def test_crowded_groups_of_near_copies(spark, docs, monkeypatch):
    """Copies that are like their origin but not like each other, chains, and lone texts, all in crowded bands."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    random.seed(11)
    rows = []
    for g in range(3):
        origin = [f"g{g}w{i}" for i in range(40)]
        rows.append(" ".join(origin))
        for p in range(2, 38):
            rows.append(" ".join(origin[:p] + [f"n{g}x{p}"] + origin[p + 1 :]))
        rows += [" ".join(origin[: 40 - k]) for k in range(1, 25)]
    rows = list(enumerate(rows))
    got = {r.id: r.component_id for r in simhash.similar_groups(docs(*rows)).collect()}
    assert got == roots(range(len(rows)), lambda a, b: likeness(rows[a][1], rows[b][1]) >= 0.8)


def test_empty_and_extra_columns(spark, docs):
    empty = docs((1, "a")).filter("false")
    assert simhash.fingerprint_groups(empty).count() == 0
    assert simhash.similar_groups(empty).count() == 0
    odd = docs((1, "a b c d e f g"), (2, "a b c d e f g")).withColumns({"node": F.lit(1), "root": F.lit(2), "fp": F.lit(3), "key": F.lit(4), "part": F.lit(5), "_gone": F.lit(6)})
    assert {r.component_id for r in simhash.fingerprint_groups(odd).collect()} == {1}
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [1]


def test_recall_on_the_corpus(spark):
    """Of all pairs of documents that share 0.8 of their shingles, found by brute force over an inverted index, 0.9 are linked at least."""
    import os

    import pytest

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    sets = {r.doc_id: np.unique(simhash.shingle_hashes((r.text or "").encode(), 5)) for r in df.collect()}
    got = {r.id: r.component_id for r in simhash.similar_groups(df).collect()}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a]) and len(sets[b]) and 2 * len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= 0.8 * (len(sets[a]) + len(sets[b]))]
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    linked = {frozenset(p) for p in pairs}
    assert got == roots(ids, lambda a, b: frozenset((a, b)) in linked)


def test_texts_that_share_a_hash(spark, docs, monkeypatch):
    """With a first hash of three values nearly all texts clash; nothing changes but their names."""
    rng = random.Random(5)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(6)]
    rows = [(i, base[i % 6] + (" tail" if i > 8 else "")) for i in range(14)] + [(20, None), (21, ""), (None, base[0]), (3, base[1])]
    want = sorted(((r.id, r.component_id, r.stays) for r in simhash.similar_groups(docs(*rows)).collect()), key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near(docs(*rows)).collect()), key=str)
    whole = simhash._hash
    monkeypatch.setattr(simhash, "_hash", lambda t, n: whole(t, n) if n else F.pmod(whole(t, 0), F.lit(3)))
    assert sorted(((r.id, r.component_id, r.stays) for r in simhash.similar_groups(docs(*rows)).collect()), key=str) == want
    assert sorted(((r.doc_id, r.text) for r in simhash.drop_near(docs(*rows)).collect()), key=str) == kept
    monkeypatch.setattr(simhash, "CLASHES", 1)
    with pytest.raises(ValueError):
        simhash.similar_groups(docs(*rows))


def test_too_many_hot_keys_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(k, i) for k in "abcd" for i in range(50)] + [("e", 0), (None, 1)], "k string, i int").repartition(3)
    side = spark.createDataFrame([(k, n, k * 2) for k, n in zip("abcdf", (50, 50, 50, 2, 9))], "k string, n int, v string")
    for most in (1_000_000, 2):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        for how in ("inner", "left"):
            rows = lambda d: sorted(map(str, d.select("k", "i", "n", "v").collect()))
            assert rows(common.join_hot(df, side, ["k"], F.col("n") > 10, how)) == rows(df.join(side, "k", how))
