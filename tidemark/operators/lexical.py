"""Keyword search: term groups matched as substrings of folded text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.segment import Group, Policy, groups
from ..functions.text import haystack

# The weight of a hit by the origin of its text.
SOURCE_WEIGHT = {"text": 1.0, "transcript": 0.95, "extracted": 0.9, "link": 0.9, "ocr": 0.85}
TF_CAP = 3


def with_hay(chunks: DataFrame) -> DataFrame:
    """Adds ``hay``, the folded text; stored with the chunks it is made once for all queries."""
    return chunks if "hay" in chunks.columns else chunks.withColumn("hay", haystack(F.col("text")))


def term_frequency(hay: Column, term: str | Column) -> Column:
    """Occurrences from left to right without overlap."""
    t = F.lit(term) if isinstance(term, str) else term
    return ((F.length(hay) - F.length(F.replace(hay, t, F.lit("")))) / F.length(t)).cast("int")


def source_weight(source: Column) -> Column:
    return reduce(lambda c, kv: F.when(source == kv[0], kv[1]).otherwise(c), SOURCE_WEIGHT.items(), F.lit(0.0))


def matches(hay: Column, wanted: list[Group]) -> Column:
    """Every group has enough of its terms in the text; a query without groups matches nothing."""
    if not wanted:
        return F.lit(False)
    enough = [sum((F.when(F.contains(hay, F.lit(t)), 1).otherwise(0) for t in g.terms), F.lit(0)) >= g.min_matched for g in wanted]
    return reduce(lambda a, b: a & b, enough)


def score(hay: Column, text: Column, source: Column, wanted: list[Group], summed: bool = False) -> Column:
    """``summed``: counts are added as whole numbers before they are divided, so chunks of as many counts tie; else each is divided first, and sums may differ in their last bit."""
    norm = F.sqrt(F.greatest(F.lit(1), F.length(text)).cast("double"))
    counts = [F.least(term_frequency(hay, t), F.lit(TF_CAP)) for g in wanted for t in g.terms]
    total = sum(counts, F.lit(0)).cast("double") / norm if summed else sum((n.cast("double") / norm for n in counts), F.lit(0.0))
    pairs = [g for g in wanted if g.is_bigram]
    cover = [sum((F.when(F.contains(hay, F.lit(t)), 1.0).otherwise(0.0) for t in g.terms), F.lit(0.0)) / len(g.terms) for g in pairs]
    coverage = sum(cover, F.lit(0.0)) / len(cover) if cover else F.lit(1.0)
    return total * coverage * source_weight(source)


def keyword_search(chunks: DataFrame, query: str, k: int, wanted: list[Group] | None = None, summed: bool = False) -> DataFrame:
    """The ``k`` best chunks of a query: all columns, ``score`` and ``rank``; ties by chunk id.

    The filter runs on the scan, and the sort keeps ``k`` rows a task.
    """
    wanted = groups(query) if wanted is None else wanted
    c = with_hay(chunks).filter(matches(F.col("hay"), wanted))
    best = c.withColumn("score", score(F.col("hay"), F.col("text"), F.col("source"), wanted, summed)).orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def query_groups(queries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Rows (query_id, group, terms, min_matched, is_bigram): the groups of terms of each query (query_id, query), as :func:`groups` makes them."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k, g) for i, q in enumerate(batch.column(1).to_pylist()) for k, g in enumerate(groups(q or "", policy))]
            columns = [pa.array([k for _, k, _ in found], pa.int32()), pa.array([list(g.terms) for *_, g in found], pa.list_(pa.string())), pa.array([g.min_matched for *_, g in found], pa.int32()), pa.array([g.is_bigram for *_, g in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, *_ in found], pa.int64())), *columns], names=["query_id", "group", "terms", "min_matched", "is_bigram"])

    return queries.select("query_id", "query").mapInArrow(run, f"query_id {kind}, `group` int, terms array<string>, min_matched int, is_bigram boolean")


#: Characters of patterns that one pass over the texts looks for.
PATTERN_CHARS = 4_000_000


def _automaton(terms: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, (i, len(t)))
    found.make_automaton()
    return found


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (pattern_id, text_id): which ``texts`` (text_id, text) contain which ``patterns`` (pattern_id, pattern) as substrings.

    All patterns are found in one scan of a text; sets of over ``PATTERN_CHARS`` characters
    take several scans.  Nulls and empty patterns are found nowhere.
    """
    some = patterns.filter(F.length("pattern") > 0)
    chars = some.agg(F.sum(F.length("pattern"))).first()[0] or 0
    n = max(1, -(-chars // PATTERN_CHARS))
    kinds = patterns.schema["pattern_id"].dataType.simpleString(), texts.schema["text_id"].dataType.simpleString()
    out = None
    for i in range(n):
        rows = (some if n == 1 else some.filter(F.pmod(F.xxhash64("pattern_id"), F.lit(n)) == i)).select("pattern_id", "pattern").collect()
        ids: dict[str, list] = {}
        for r in rows:
            ids.setdefault(r.pattern, []).append(r.pattern_id)
        words = sorted(ids)

        def run(batches: Iterator[pa.RecordBatch], words: list[str] = words, ids: dict = ids) -> Iterator[pa.RecordBatch]:
            if not words:
                return
            found = _automaton(words)
            for batch in batches:
                a, b = [], []
                for j, t in enumerate(batch.column(1).to_pylist()):
                    for w in {w for _, (w, _) in found.iter(t)} if t else ():
                        a += ids[words[w]]
                        b += [j] * len(ids[words[w]])
                texts = batch.column(0).take(pa.array(b, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(a), texts] if a else [pa.nulls(0), texts], names=["pattern_id", "text_id"]).cast(pa.schema([("pattern_id", pa.string() if kinds[0] == "string" else pa.int64()), ("text_id", texts.type)]))

        met = texts.select("text_id", "text").mapInArrow(run, f"pattern_id {kinds[0]}, text_id {kinds[1]}")
        out = met if out is None else out.unionByName(met)
    return out


def match_ranges(hay: Column, terms: list[str]) -> Column:
    """Places [s, e) of all terms, overlapping and touching ones merged; each term from left to right without overlap."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def run(hays: pd.Series) -> pd.Series:
        return hays.map(lambda h: [{"s": s, "e": e} for s, e in merged_places(h or "", terms)])

    return run(hay)


def merged_places(hay: str, terms: list[str]) -> list[tuple[int, int]]:
    """In time linear in the text for each term."""
    spans = []
    for t in terms:
        at = hay.find(t) if t else -1
        while at >= 0:
            spans.append((at, at + len(t)))
            at = hay.find(t, at + len(t))
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
