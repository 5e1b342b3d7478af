"""Keyword search by an inverted index of short strings.

Chunks lie in parts of some thousand places.  The index has, for each gram (one,
two or three characters in a row of a folded text) and part, the places whose
text has it.  A term's candidates are the places that all its grams share; only
those chunks are read, and held against the term itself, so both searches here
return what the scan of :mod:`lexical` returns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.segment import Group, Policy, groups
from .lexical import SOURCE_WEIGHT, TF_CAP, keyword_search, query_groups
from .scan import KEEP, scanned_batch

#: Places of a part, and characters of the longest grams.
PLACES, LONGEST = 4096, 3
#: If more than this share of the chunks may match a query, they are scanned.
SCANNED = 0.2
_INDEX = "gram string, part long, n int, places array<int>"


def numbered(chunks: DataFrame, first: int) -> DataFrame:
    """``chunks`` with ``part`` and ``place`` (below ``PLACES``); parts are numbered from ``first * 2**40`` on."""
    at = F.monotonically_increasing_id()
    task, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    part = F.lit(first << 40).bitwiseOR(task * F.lit(1 << 21)).bitwiseOR(F.floor(row / PLACES))
    return chunks.withColumns({"part": part.cast("long"), "place": (row % PLACES).cast("int")})


def part_grams(hays: list[str], places: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, ends, places): the grams of the texts of a part, and the places of each, ascending, up to its end."""
    chars = np.frombuffer("".join(hays).encode("utf-32-le"), "<u4")
    owner = np.repeat(places.astype(np.int64), [len(h) for h in hays])
    text = np.repeat(np.arange(len(hays)), [len(h) for h in hays])
    alphabet, code = np.unique(chars, return_inverse=True)
    names, lengths, held = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    gram = np.zeros(len(chars), np.int64)
    for n in range(1, LONGEST + 1):
        if len(chars) < n:
            break
        gram = gram[: len(chars) - n + 1] * len(alphabet) + code[n - 1 :]
        whole = text[: len(gram)] == text[n - 1 :]
        mine, at = gram[whole], owner[: len(gram)][whole]
        if len(alphabet) ** n * PLACES < 1 << 62:
            pairs = _different(mine * PLACES + at)
            mine, at = pairs // PLACES, pairs % PLACES
        else:
            found, mine = np.unique(mine, return_inverse=True)
            pairs = _different(mine * PLACES + at)
            mine, at = found[pairs // PLACES], pairs % PLACES
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        some, count = mine[first], np.diff(np.append(first, len(mine)))
        letters = np.stack([alphabet[some // len(alphabet) ** (n - 1 - i) % len(alphabet)] for i in range(n)], axis=1) if len(some) else np.zeros((0, n), "<u4")
        joined = np.ascontiguousarray(letters, "<u4").tobytes().decode("utf-32-le")
        names += [joined[i : i + n] for i in range(0, len(joined), n)]
        lengths.append(count)
        held.append(at)
    return names, np.cumsum(np.concatenate(lengths)), np.concatenate(held)


def _different(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; on mostly different numbers faster than ``np.unique``, which hashes."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def build(chunks: DataFrame) -> DataFrame:
    """The index (gram, part, n, places) of ``chunks`` (part, place, hay), sorted by gram within files, so that a look-up skips most pages."""

    def run(rows: pa.Table) -> pa.Table:
        hays = rows.column("hay").fill_null("").to_pylist()
        names, ends, places = part_grams(hays, rows.column("place").to_numpy())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(places, pa.int32()))
        part = rows.column("part")[0].as_py() if len(hays) else 0
        return pa.table({"gram": pa.array(names, pa.string()), "part": pa.array([part] * len(names), pa.int64()), "n": pa.array(np.diff(np.append(0, ends)), pa.int32()), "places": lists})

    return chunks.select("part", "place", "hay").groupBy("part").applyInArrow(run, _INDEX).sortWithinPartitions("gram", "part")


def grams_of(term: str) -> list[str]:
    """The grams that a text with the term must have."""
    return [term] if len(term) <= LONGEST else list(dict.fromkeys(term[i : i + LONGEST] for i in range(len(term) - LONGEST + 1)))


def grams(term: Column) -> Column:
    """:func:`grams_of` as a column."""
    n = F.length(term)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - LONGEST + 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(LONGEST)))
    return F.when(n <= LONGEST, F.array(term)).otherwise(F.array_distinct(cut))


def _shared(lists: Column) -> Column:
    """What all arrays of an array have."""
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), F.array_intersect)


def most_matches(index: DataFrame, wanted: list[Group]) -> int:
    """A bound on the chunks that match: of each group, the counts of its terms' rarest grams over how many must match; the least of all groups."""
    needed = sorted({g for w in wanted for t in w.terms for g in grams_of(t)})
    count = {r.gram: r.n for r in index.filter(F.col("gram").isin(needed)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    of = lambda t: min(count.get(g, 0) for g in grams_of(t))
    return min(sum(map(of, w.terms)) // w.min_matched for w in wanted)


def candidates(index: DataFrame, wanted: list[Group]) -> DataFrame:
    """Rows (part, place): the places whose grams let enough terms of every group match."""
    needed = sorted({g for w in wanted for t in w.terms for g in grams_of(t)})
    held = index.filter(F.col("gram").isin(needed)).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("gram", "places"))).alias("m"))
    none = F.array().cast("array<int>")
    places = lambda t: _shared(F.array(*[F.coalesce(F.try_element_at("m", F.lit(g)), none) for g in grams_of(t)]))
    of_group = lambda k: lambda p: F.struct(p.alias("place"), F.lit(k).alias("k"))
    lists = [F.transform(places(t), of_group(k)) for k, w in enumerate(wanted) for t in w.terms]
    found = held.select("part", F.explode(F.concat(*lists)).alias("x")).groupBy("part", "x.place")
    enough = [F.count(F.when(F.col("x.k") == k, 1)).alias(f"n{k}") for k in range(len(wanted))]
    out = found.agg(*enough)
    for k, w in enumerate(wanted):
        out = out.filter(F.col(f"n{k}") >= w.min_matched)
    return out.select("part", "place")


def indexed_search(chunks: DataFrame, index: DataFrame, query: str, k: int, wanted: list[Group] | None = None, summed: bool = False) -> DataFrame:
    """:func:`keyword_search` over the chunks that can match: all columns, ``score`` and ``rank``.

    Where the index says that more than ``SCANNED`` of the chunks may match, they are scanned.
    """
    wanted = groups(query) if wanted is None else wanted
    if not wanted or most_matches(index, wanted) > SCANNED * chunks.count():
        return keyword_search(chunks, query, k, wanted, summed)
    return keyword_search(chunks.join(candidates(index, wanted), ["part", "place"], "left_semi"), query, k, wanted, summed)


def keyword_batch(chunks: DataFrame, queries: DataFrame, k: int, policy: Policy = Policy(), digits: int | None = None, keep: tuple[str, ...] = KEEP) -> DataFrame:
    """:func:`indexed_batch` over chunks that have no index: they are scanned once, as an index for one use takes more disk than their texts.  Of the chunks, the columns ``keep`` come along."""
    return scanned_batch(chunks, queries, k, policy, digits, keep)


_HIT = "query_id string, chunk_id string, note_id string, block_id string, source string, text string, score double"


def indexed_batch(chunks: DataFrame, index: DataFrame, queries: DataFrame, k: int, policy: Policy = Policy(), digits: int | None = None) -> DataFrame:
    """The ``k`` best chunks of each query at once: (query_id, chunk_id, note_id, block_id, source, text, score, rank); ties by chunk id.

    Queries (query_id, query) mean what they mean in :func:`keyword_search`, and stay a table.  A part is given the terms that some place of it may have, the
    queries for which that is enough, and the chunks at these places; the ``k`` best of each
    query leave it.  Nothing is done for chunks that no query can match.  ``digits`` rounds
    scores before ranking.
    """
    kind = queries.schema["query_id"].dataType
    asked = query_groups(queries.select(F.col("query_id").cast("string").alias("query_id"), "query"), policy)
    terms = asked.select("query_id", "group", "min_matched", F.explode("terms").alias("term"))
    split = terms.select("term").distinct().select("term", grams(F.col("term")).alias("gs"))
    wanted = split.select("term", F.size("gs").alias("n_grams"), F.explode("gs").alias("gram"))
    met = index.select("gram", "part", "places").join(wanted, "gram").groupBy("part", "term").agg(F.collect_list("places").alias("lists"), F.first("n_grams").alias("n_grams"))
    held = met.filter(F.size("lists") == F.col("n_grams")).select("part", "term", _shared(F.col("lists")).alias("places")).filter(F.size("places") > 0)

    # Queries with enough terms in a part, in every group.
    whole = asked.groupBy("query_id").agg(F.count("*").alias("groups"), F.collect_list(F.struct("terms", "min_matched", "is_bigram")).alias("wanted"))
    here = terms.join(held.select("part", "term"), "term").groupBy("part", "query_id", "group", "min_matched").count().filter("count >= min_matched")
    able = here.groupBy("part", "query_id").agg(F.count("*").alias("met")).join(whole, "query_id").filter("met = groups").select("part", "query_id", "wanted")
    used = able.select("part", F.explode(F.flatten("wanted.terms")).alias("term")).distinct()
    held = held.join(used, ["part", "term"], "left_semi")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    given = held.select("part", "term", "places", none("query_id", "string"), none("wanted", able.schema["wanted"].dataType.simpleString()))
    given = given.unionByName(able.select("part", none("term", "string"), none("places", "array<int>"), "query_id", "wanted"))
    read = chunks.join(held.select("part", F.explode("places").alias("place")).distinct(), ["part", "place"])
    read = read.select("part", "place", "hay", "chunk_id", "note_id", "block_id", "source", "text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _part_best(left, right, k, digits)

    best = given.groupBy("part").cogroup(read.groupBy("part")).applyInArrow(run, _HIT)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).withColumn("query_id", F.col("query_id").cast(kind))


def _part_best(given: pa.Table, chunks: pa.Table, k: int, digits: int | None) -> pa.Table:
    """The ``k`` best chunks of a part for each of its queries; terms are counted where the index has them."""
    hays, n = chunks.column("hay").to_pylist(), chunks.num_rows
    row = np.full(PLACES, -1)
    row[chunks.column("place").to_numpy()] = np.arange(n)
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    asked = []
    for term, places, query, wanted in zip(given.column("term").to_pylist(), given.column("places"), given.column("query_id").to_pylist(), given.column("wanted").to_pylist(), strict=True):
        if term is None:
            asked.append((query, wanted))
            continue
        at = row[places.values.to_numpy()]
        at = at[at >= 0]  # places whose chunk is gone
        tf = np.array([min(hays[i].count(term), TF_CAP) for i in at], np.float64)
        counts[term] = at[tf > 0], tf[tf > 0]
    norm = np.sqrt(np.maximum(1, pc.utf8_length(chunks.column("text")).to_numpy()))
    weight = np.array([SOURCE_WEIGHT.get(s, 0.0) for s in chunks.column("source").to_pylist()])
    ids = np.array(chunks.column("chunk_id").to_pylist(), object)
    owner, picked, scores = [], [], []
    for query, wanted in asked:
        fits, total, cover, pairs = np.ones(n, bool), np.zeros(n), np.zeros(n), 0
        for g in wanted:
            matched, mine = np.zeros(n, np.int64), np.zeros(n)
            for term in g["terms"]:
                at, tf = counts.get(term, (np.zeros(0, np.int64), np.zeros(0)))
                matched[at] += 1
                mine[at] += tf
            fits &= matched >= g["min_matched"]
            total += mine
            if g["is_bigram"]:
                pairs += 1
                cover += matched / len(g["terms"])
        at = np.flatnonzero(fits)
        score = total[at] / norm[at] * (cover[at] / pairs if pairs else 1.0) * weight[at]
        score = score if digits is None else np.round(score, digits)
        order = sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]]))[:k] if len(at) <= 4 * k else _first(score, ids[at], k)
        owner += [query] * len(order)
        picked += at[order].tolist()
        scores += score[order].tolist()
    found = chunks.select(["chunk_id", "note_id", "block_id", "source", "text"]).take(pa.array(picked, pa.int64()))
    return pa.table({"query_id": pa.array(owner, pa.string()), **{c: found.column(c) for c in found.column_names}, "score": pa.array(scores, pa.float64())})


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """The ``k`` first by score and id, sorting only what can be among them."""
    least = np.partition(score, len(score) - k)[len(score) - k]
    some = np.flatnonzero(score >= least)
    return sorted(some.tolist(), key=lambda i: (-score[i], ids[i]))[:k]
