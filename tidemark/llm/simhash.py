"""Near-duplicate groups by SimHash with bit-sliced comparison.

Fingerprints whose blocks of bits agree meet in a group (any two within the
radius agree in enough blocks), or, for wide radii, documents that share a
min-hash of their shingles do.  A group is compared in bit-sliced form: bit
planes hold one bit of 64 fingerprints in a word, the plane of differences to
the fingerprint ``d`` places on is the plane XOR itself shifted by ``d``, and
carry-save counters add up the differences of all lanes at once.  Blocks of
lanes (words) that all exceed the radius are abandoned after each few planes.

Only a spanning forest of the links of a group leaves a task; star steps join
the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import each_part
from .common import HOT_ROWS, cut, fresh, if_small, join_hot, table, text_batches
from .graph import components
from .words import groups

BITS = 64
#: Rows of a group that are compared in one task; larger groups are split.
BLOCK = 2048
#: Shingles that are hashed at a time.
CHUNK = 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``n`` words of the text in lower case (A-Z), repeats included; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    return np.fromiter((h(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int, bands: int = 0, rows: int = 4, text: str = "text", id: str = "doc_id", node: Column | None = None, mark: Column | None = None) -> DataFrame:
    """Rows (id, node, mark, fp, bands, digest): 64-bit fingerprint and, if asked for, min-hash band keys of each text and a digest of its set of shingles.

    With bands, the fingerprint counts each distinct shingle once, as the bands do.  A text
    without words (null too) has fingerprint zero and the band keys of no shingles.
    ``node`` and ``mark`` are carried along.
    """
    text_batches(df.sparkSession)
    salts = np.random.default_rng(7).integers(1, 1 << 63, (2, bands * rows), np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in groups(batch.column(3)):
                fps, keys, digests = [], [], []
                for t in part.cast(pa.binary()):
                    h = shingle_hashes(t.as_py(), shingle)
                    h = np.unique(h) if bands else h
                    fps.append(fingerprint(h) if len(h) else 0)
                    keys.append(_bands(h, salts, bands, rows) if bands else [])
                    digests.append(xxhash.xxh64_intdigest(h.tobytes()) if bands else 0)
                named = [batch.column(c).slice(lo, len(part)) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(digests, np.uint64).view(np.int64))], names=["id", "node", "mark", "fp", "bands", "digest"])

    carried = [(F.lit(None) if c is None else c).cast("long").alias(name) for name, c in (("node", node), ("mark", mark))]
    source = df.select(F.col(id).cast("long").alias("id"), *carried, F.col(text).alias("text"))
    return source.mapInArrow(run, "id long, node long, mark long, fp long, bands array<long>, digest long")


def _bands(h: np.ndarray, salts: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key of each band of ``rows`` min-hashes of the distinct hashes ``h``."""
    least = np.full(bands * rows, _ONES)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * salts[0] + salts[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    mixed = (least.reshape(bands, rows) * np.uint64(0x9E3779B97F4A7C15)) ^ (least.reshape(bands, rows) >> np.uint64(32))
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = (out ^ mixed[:, r]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(r)
    return out.view(np.int64).tolist()


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1, each packed into words of 64 lanes."""
    pad = -bits.shape[-1] % 64
    packed = np.packbits(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)]), axis=-1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def links(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j), i < j, of the same group whose fingerprints differ in at most ``radius`` bits.

    Takes 64 distances j - i at a time; ``b`` and ``w`` name the blocks of 64 lanes that
    are still alive, by distance and by word.
    """
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))  # rows from here to the group's end
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.pad(_planes(np.ascontiguousarray(bits)), ((0, 0), (0, 1)))
    levels = max(1, radius.bit_length())
    for c in range(-(-int(sizes.max(initial=1)) // 64)):
        lanes = np.flatnonzero(left > max(64 * c, 1))
        if not len(lanes):
            break
        near = np.unique(lanes // 64)  # words with some lane that has a partner so far on
        alive = np.zeros((len(near), 64), np.int64)
        alive[np.searchsorted(near, lanes // 64), lanes % 64] = left[lanes]
        live = _planes((alive[None, :, :] > (64 * c + np.arange(64))[:, None, None]).astype(np.uint8))[:, :, 0]
        if c == 0:
            live[0] = 0
        b, k = np.nonzero(live)
        over, w, b = ~live[b, k], near[k], b.astype(np.uint64)
        up = np.where(b > 0, np.uint64(64) - b, np.uint64(0))
        high = np.where(b > 0, _ONES, np.uint64(0))
        at = np.minimum(w + c, planes.shape[1] - 1)
        after = np.minimum(w + c + 1, planes.shape[1] - 1)
        count = [np.zeros(len(w), "<u8") for _ in range(levels)]
        for p in range(BITS):
            plane = planes[p]
            carry = plane[w] ^ ((plane[at] >> b) | ((plane[after] << up) & high))
            for level in range(levels):
                carry, count[level] = count[level] & carry, count[level] ^ carry
            over |= carry
            if p % 4 == 3:
                over |= _above(count, radius)
                keep = over != _ONES
                if not keep.all():
                    w, b, over, up, high, at, after = (x[keep] for x in (w, b, over, up, high, at, after))
                    count = [x[keep] for x in count]
                    if not len(w):
                        break
        if len(w):
            k, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = w[k] * 64 + lane
            yield i, i + 64 * c + b[k].astype(np.int64)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, as far as its bits go, exceeds the radius."""
    above = np.zeros_like(count[0])
    equal = np.full_like(above, _ONES)
    for level in reversed(range(len(count))):
        if radius >> level & 1:
            equal &= count[level]
        else:
            above |= equal & count[level]
            equal &= ~count[level]
    return above


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of n places is linked with."""
    root = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            y = root[x]
            if np.array_equal(y, x):
                return x
            x = y

    for i, j in pairs:
        while len(i):
            a, b = find(i), find(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    return find(np.arange(n))


def _linked(groups: DataFrame, key: list[str], radius: int) -> DataFrame:
    """Spanning edges (a, b) of the links within the parts of ``groups`` (key, part, node, fp)."""

    def run(starts: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, fp = rows.column(0), rows.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        a = np.arange(len(fp))
        b = forest(len(fp), links(fp, starts, radius))
        edge = a != b
        yield pa.RecordBatch.from_arrays([node.take(pa.array(a[edge])), node.take(pa.array(b[edge]))], names=["a", "b"])

    return each_part(groups, key, ["node", "fp"], run, "a long, b long", 20_000)


def _linked_and_met(groups: DataFrame, key: list[str], radius: int) -> DataFrame:
    """As :func:`_linked`, and rows (a, key), with b null, of all nodes of the parts that have several."""

    def run(starts: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, fp = rows.column(0), rows.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        n = len(fp)
        b = forest(n, links(fp, starts, radius))
        edge = np.flatnonzero(b != np.arange(n))
        yield pa.RecordBatch.from_arrays([node.take(pa.array(edge)), node.take(pa.array(b[edge])), *[pa.nulls(len(edge), rows.column(k).type) for k in key]], names=["a", "b", *key])
        sizes = np.diff(np.append(starts, n))
        met = rows.filter(pa.array(np.repeat(sizes > 1, sizes)))
        yield pa.RecordBatch.from_arrays([met.column(0), pa.nulls(met.num_rows, pa.int64()), *[met.column(k) for k in key]], names=["a", "b", *key])

    schema = ", ".join(["a long", "b long", *[f"{k} {groups.schema[k].dataType.simpleString()}" for k in key]])
    return each_part(groups, key, ["node", "fp", *key], run, schema, WIDE_ROWS)


def block_keys(fp: str, radius: int, blocks: int) -> F.Column:
    """An array of keys, the bits of each choice of ``blocks - radius`` blocks: fingerprints within the radius share one at least."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = F.array(*[F.lit(m - (m >> 63 << 64)).cast("long") for m in masks])
    return F.transform(signed, lambda m, k: F.xxhash64(k, F.col(fp).bitwiseAND(m)))


def fingerprint_groups(df: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, fp, component_id), one for each row of ``df``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest id that can be reached (null only if all ids reached are null).  Texts
    without words, null ones too, have fingerprint zero and link like any other.  An
    empty table gives an empty result.
    """
    docs = cut(fingerprints(df, shingle, text=text, id=id).select("id", "fp"))
    nodes = cut(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    keyed = nodes.select(F.col("fp").alias("node"), "fp", F.explode(block_keys("fp", radius, blocks)).alias("key"))
    keyed = _finer_keys(keyed, radius)
    edges = _linked(keyed.withColumn("part", F.lit(0)), ["key"], radius)
    roots = cut(components(edges))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    by_fp = join_hot(named.select("fp", "root", "n"), least, ["root"], F.col("members") > HOT_ROWS).select("fp", "component_id", "n")
    return join_hot(docs, cut(by_fp), ["fp"], F.col("n") > HOT_ROWS).select("id", "fp", "component_id")


def _finer_keys(keyed: DataFrame, radius: int) -> DataFrame:
    """``keyed`` (node, fp, key) without the groups of over ``BLOCK`` fingerprints, whose members get finer keys instead.

    Finer keys leave so few bits open that a group of distinct fingerprints cannot
    exceed ``BLOCK``, so the work on a crowded group stays in proportion to its size.
    """
    open_bits = max(1, (BLOCK.bit_length() - 1) // max(radius, 1))
    crowded = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key"))
    if crowded.isEmpty():
        return keyed
    few = if_small(crowded)
    inside = keyed.join(few, "key", "left_semi").select("node", "fp").distinct()
    fine = inside.select("node", "fp", F.explode(block_keys("fp", radius, -(-BITS // open_bits))).alias("key"))
    return keyed.join(few, "key", "left_anti").select("node", "fp", "key").unionByName(fine)


#: Of 64 bits, how many may differ in two texts that share 0.8 of their shingles (13 are expected, 24 are 3.4 deviations more).
WIDE = 24
#: Min-hash bands of so many rows: two texts that share 0.8 of their shingles meet in one with probability 0.995.
BANDS, ROWS = 24, 4
#: Rows of band groups that are compared at a time: within ``WIDE`` bits all pairs of a group may link.
WIDE_ROWS = 5_000
#: How often a crowded band group is held against one of its own texts.
LEADERS = 3
#: Shingles of other texts that one text is held against at a time.
VALUES = 1 << 18


#: Different texts that share a 64-bit hash, at most: N texts have some N * N / 2 ** 65 such pairs, 300 if there are 10 ** 11.
CLASHES = 100_000


def _hash(text: Column, n: int) -> Column:
    """Hash n of a text; null is empty."""
    return F.xxhash64(F.lit(n), F.coalesce(text, F.lit("")))


def _named(first: Column, second: Column, clashes: list[int]) -> Column:
    """The node of a text with these two hashes: the first of them, or one of both for texts whose first hash another text has."""
    return F.when(first.isin(clashes), F.xxhash64(first, second)).otherwise(first) if clashes else first


def _clashes(docs: DataFrame) -> list[int]:
    """First hashes (``node``) that occur with different second ones (``mark``)."""
    found = docs.groupBy("node").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).filter("x <> y").select("node").limit(CLASHES + 1).collect()
    if len(found) > CLASHES:
        raise ValueError(f"over {CLASHES} hashes of texts clash")
    return [r.node for r in found]


def similar_groups(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", id: str = "doc_id", radius: int = WIDE, bands: int = BANDS) -> DataFrame:
    """Rows (id, node, component_id, stays), one for each row of ``df``.

    Texts link if they share ``similarity`` or more of their distinct shingles, which is
    twice the shingles in common over the shingles of both (Dice).  Candidates share a min-hash
    band.  Within a band's group they are compared bit-sliced within ``radius``, and the links
    of this are held against the shingles themselves; a group of over ``BLOCK`` texts is first
    held against those in its middle.  Wherever a group is not joined into one by then, all
    its texts but those of its largest cluster are compared exactly with the whole group.

    Equal texts are one ``node``, a hash of the text; the few texts that share it with
    another one are named by two hashes.  Texts without words, null ones too, link with each other.
    Rows that share an id but not the text are told apart.  ``component_id`` is the smallest
    id that can be reached, null only if all are null; ``stays`` marks the row to keep, the one
    of smallest id (null last, then by node), and rows that repeat both id and text alike.
    """
    return _similar(df, shingle, similarity, text, id, radius, bands)[0]


def _similar(df: DataFrame, shingle: int, similarity: float, text: str, id: str, radius: int = WIDE, bands: int = BANDS) -> tuple[DataFrame, list[int]]:
    """:func:`similar_groups`, and the hashes that name several texts."""
    docs = table(fingerprints(df, shingle, bands, ROWS, text, id, _hash(F.col(text), 0), _hash(F.col(text), 1)))
    clashes = _clashes(docs)
    docs = docs.withColumn("node", _named(F.col("node"), F.col("mark"), clashes)).drop("mark")
    name = lambda t: _named(_hash(t, 0), _hash(t, 1), clashes)
    uniq = table(docs.drop("id").dropDuplicates(["node"]))
    # Equal sets of shingles: one text stands for them.
    alike = cut(uniq.groupBy("fp", "digest").agg(F.min("node").alias("rep"), F.count("*").alias("texts")))
    same = join_hot(uniq.select("node", "fp", "digest"), alike, ["fp", "digest"], F.col("texts") > HOT_ROWS).filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    reps = uniq.join(alike.select(F.col("rep").alias("node")), "node", "left_semi")
    keyed = reps.select("node", "fp", F.posexplode("bands").alias("band", "key"))
    crowded = cut(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("band", "key"))
    hot = None if crowded.isEmpty() else if_small(crowded)
    light = keyed if hot is None else keyed.join(hot, ["band", "key"], "left_anti")
    first = table(_linked_and_met(light.withColumn("part", F.lit(0)), ["band", "key"], radius))
    pairs = table(first.filter("b is not null").select("a", "b").distinct())
    rows = first.filter("b is null").select("band", "key", F.col("a").alias("node"))
    crowd = None if hot is None else table(keyed.join(hot, ["band", "key"]).select("band", "key", "node", "fp"))
    rows = rows if crowd is None else rows.unionByName(crowd.drop("fp"))

    needed = cut(rows.select("node").distinct())
    texts = df.select(name(F.col(text)).alias("node"), F.col(text).alias("text")).join(if_small(needed), "node", "left_semi")
    if docs.count() > uniq.count():
        texts = texts.dropDuplicates(["node"])
    sets = table(_sets(texts, shingle))

    edges = table(_verified(pairs, sets, similarity))
    if crowd is not None:
        edges = edges.unionByName(_by_leaders(crowd, sets, similarity))
    edges = edges.unionByName(table(_asked(rows, components(edges), sets, similarity)))
    roots = cut(components(edges.unionByName(same)))
    named = cut(docs.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root")))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("node"))
    kept = cut(named.groupBy("root").agg(F.min(rank).alias("kept"), F.count("*").alias("members")))
    whole = join_hot(named, kept, ["root"], F.col("members") > HOT_ROWS)
    return whole.select("id", "node", F.col("kept.id").alias("component_id"), (rank == F.col("kept")).alias("stays")), clashes


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, set): the distinct shingle hashes of each text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in groups(batch.column(1)):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.cast(pa.binary())]
                ends = np.cumsum([0, *map(len, sets)])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), flat], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(hashes, "node long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar.  The set of a node that is the b of many pairs is sent to several tasks."""
    counts = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")))
    wide = if_small(cut(counts.filter("k > 1")))
    dealt = pairs.join(wide, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("k", F.lit(1))).cast("int")).select("a", "b", "salt")
    right = sets.join(counts.withColumnRenamed("b", "node"), "node").select(F.col("node").alias("b"), F.col("set").alias("b_set"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("set").alias("a_set")), "a").join(right, ["b", "salt"])
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(2 * shared >= similarity * (F.size("a_set") + F.size("b_set")) - 1e-9).select("a", "b")


def _by_leaders(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Exact links (a, b) of the crowded groups ``rows`` (band, key, node, fp) with the texts in their middle.

    In each round the nodes without a link so far have a middle, the bits that most of
    their fingerprints have; the one nearest to it is held against the whole group.  So a
    group of copies of one text, each with its own changes, is joined in a round or two.
    """
    by = ["band", "key"]
    state, edges = rows.withColumn("open", F.lit(True)), None
    for _ in range(LEADERS):
        free = state.filter("open")
        bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))
        most = free.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(bit(i)).alias(f"s{i}") for i in range(BITS)])
        middle = [F.when(2 * F.col(f"s{i}") > F.col("n"), F.lit((1 << i) - (1 << i >> 63 << 64)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
        centre = cut(most.select(*by, reduce(lambda x, y: x.bitwiseOR(y), middle).alias("centre")))
        if centre.isEmpty():
            break
        near = F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("off"), "node"))
        leaders = cut(free.join(if_small(centre), by).groupBy(*by).agg(near.alias("x")).select(*by, F.col("x.node").alias("b")))
        held = state.join(if_small(leaders), by)
        met = table(_verified(held.filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), sets, similarity))
        edges = met if edges is None else edges.unionByName(met)
        linked = met.select(F.col("a").alias("node"), "b", F.lit(True).alias("met"))
        state = table(held.join(linked, ["node", "b"], "left").select(*by, "node", "fp", (F.col("open") & F.col("met").isNull() & (F.col("node") != F.col("b"))).alias("open")))
    return edges


def _asked(rows: DataFrame, clusters: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Exact links (a, b) that join clusters within the groups ``rows`` (band, key, node); ``clusters``: node, root.

    Groups of one cluster have none to find, and of groups with the same nodes one is enough.
    All nodes outside the largest cluster ask the whole group, in blocks: the cost is that of
    the group's size times the number of those nodes.
    """
    by = ["band", "key"]
    named = table(rows.join(clusters.withColumnRenamed("root", "label"), "node", "left").select(*by, "node", F.coalesce("label", "node").alias("label")))
    mark = F.xxhash64("node")
    per = named.groupBy(*by, "label").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("s"), F.bit_xor(mark).alias("x"))
    sizes = per.groupBy(*by).agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.max("n").alias("top"), F.max_by("label", F.struct("n", "label")).alias("largest")).filter("labels > 1")
    one = sizes.groupBy("size", "s", "x").agg(F.min(F.struct(*by, "largest", "top")).alias("g")).select("g.*", "size")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    chosen = cut(one.select(*by, "largest", "size", blocks(F.col("size")).alias("wide"), blocks(F.col("size") - F.col("top")).alias("high")))
    place = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    at = lambda part, asks: F.struct(part.alias("part"), F.lit(asks).alias("asks"))
    j, i = place(1, F.col("wide")), place(2, F.col("high"))
    asks = F.col("label") != F.col("largest")
    member = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda h: at(h * F.col("wide") + j, False))
    asker = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda w: at(i * F.col("wide") + w, True))
    small = (F.col("wide") == 1) & (F.col("high") == 1)
    copies = F.when(small, F.array(F.struct(F.lit(0).alias("part"), asks.alias("asks")))).when(asks, F.concat(member, asker)).otherwise(member)
    dealt = join_hot(named, chosen, by, F.col("size") > BLOCK).withColumn("copy", F.explode(copies)).select(*by, "copy.part", "copy.asks", "node", "label")

    def run(starts: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, sets, asks, label = rows.column(0).to_numpy(), rows.column(1), rows.column(2).to_numpy(zero_copy_only=False), rows.column(3).to_numpy()
        ends, values = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
        a, b = [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(node)), strict=True):
            for i, k in links_of(values, ends, np.arange(lo, hi), asks[lo:hi], label[lo:hi], similarity):
                a.append(node[i]), b.append(node[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return each_part(dealt.join(sets, "node"), by, ["node", "set", "asks", "label"], run, "a long, b long", 2_000)


def links_of(values: np.ndarray, ends: np.ndarray, rows: np.ndarray, asks: np.ndarray, label: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that join sets with different labels, found by holding each set that asks against all; sets once joined count as one."""
    label = label.copy()
    for k in np.flatnonzero(asks):
        own = values[ends[rows[k]] : ends[rows[k] + 1]]
        sizes = ends[rows + 1] - ends[rows]
        near = np.flatnonzero((label != label[k]) & (2 * np.minimum(sizes, len(own)) >= similarity * (sizes + len(own))))
        if not len(near):
            continue
        m = sizes[near]
        total = np.cumsum(m)
        shared = np.zeros(len(near), np.int64)
        lo = 0
        while lo < len(near):
            before = total[lo] - m[lo]
            hi = max(lo + 1, int(np.searchsorted(total, before + VALUES, side="right")))
            n = m[lo:hi]
            at = np.repeat(ends[rows[near[lo:hi]]] - (total[lo:hi] - n - before), n) + np.arange(n.sum())
            x = values[at]
            place = np.minimum(np.searchsorted(own, x), max(len(own) - 1, 0))
            found = own[place] == x if len(own) else np.zeros(len(x), bool)
            shared[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n)[found], minlength=hi - lo)
            lo = hi
        for q in near[2 * shared >= similarity * (m + len(own)) - 1e-9]:
            if label[q] != label[k]:
                yield int(rows[k]), int(rows[q])
                label[label == label[q]] = label[k]


def drop_near(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay: of each group of near duplicates the one with the smallest id (null last).

    Rows that share an id but not the text are judged each for itself; of rows that repeat
    both, one stays.  All columns are kept; an empty table stays empty.
    """
    gone_id, gone_node, node = fresh(df, "gone_id", "gone_node", "node")
    found, clashes = _similar(df, shingle, similarity, text, id)
    found = cut(found)
    gone = found.filter("not stays").select(F.col("id").alias(gone_id), F.col("node").alias(gone_node)).distinct()
    again = found.filter("stays").groupBy("id", "node").count().filter("count > 1")
    named = df.withColumn(node, _named(_hash(F.col(text), 0), _hash(F.col(text), 1), clashes))
    kept = named.join(if_small(cut(gone)), (F.col(node) == F.col(gone_node)) & F.col(id).cast("long").eqNullSafe(F.col(gone_id)), "left_anti")
    if not again.isEmpty():
        kept = kept.dropDuplicates([id, node])
    return kept.select(*df.columns)
