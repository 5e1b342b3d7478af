"""Retrieval quality: outcomes of cases, metrics by group, comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

from ..sources.io import kept
from .lexical import containing
from .ranks import placed

KS = (1, 3, 5)


def returned_notes(results: DataFrame) -> DataFrame:
    """Rows (case_id, returned): the notes of each case in order of their best chunk; ``results``: case_id, note_id, rank."""
    best = results.groupBy("case_id", "note_id").agg(F.min("rank").alias("rank"))
    return best.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "note_id"))), lambda x: x["note_id"]).alias("returned"))


def outcomes(cases: DataFrame, returned: DataFrame) -> DataFrame:
    """Rows (case_id, scope, origin, is_positive, expected_count, hit_at1, hit_at3, hit_at5, reciprocal_rank, returned_none).

    A hit at k needs all expected notes among the first k; a case without expected notes
    is negative.
    """
    j = cases.join(returned, "case_id", "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<string>")))
    positive = F.size("expected") > 0
    hit = lambda k: positive & (F.size(F.array_except("expected", F.slice("returned", 1, k))) == 0)
    place = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position("returned", e)), lambda p: p > 0))
    rr = F.when(positive, F.coalesce(F.lit(1.0) / place, F.lit(0.0))).otherwise(0.0)
    return j.select("case_id", "scope", "origin", positive.alias("is_positive"), F.size("expected").alias("expected_count"), *[hit(k).alias(f"hit_at{k}") for k in KS], rr.alias("reciprocal_rank"), (F.size("returned") == 0).alias("returned_none"))


#: Bounds that split a group's values for counting.
SPLITS = 64


def group_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at place int(share * n) of the n sorted values of each group, the last one at most; no interpolation; nulls don't count.

    Values are counted first; the counts are cumulated within ranges of values and ranges
    within groups, so that no group is sorted in one task, however large.
    """
    key = by or ["_all"]
    base = df.filter(F.col(value).isNotNull()).select(*by, *([] if by else [F.lit(0).alias("_all")]), F.col(value).alias("_v"))
    counts = base.groupBy(*key, "_v").agg(F.count("*").alias("_n"))
    bounds = base.groupBy(*key).agg(F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 1000).alias("_b"), F.count("*").alias("_total"))
    match = lambda right, names: [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(names, right, strict=True)]
    named = bounds.select(*[F.col(k).alias("b" + k) for k in key], "_b", "_total")
    placed = counts.join(named, match(["b" + k for k in key], key)).withColumn("_r", F.size(F.filter("_b", lambda x: x <= F.col("_v")))).select(*key, "_v", "_n", "_total", "_r")
    ranges = placed.groupBy(*key, "_r").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_in").over(before), F.lit(0))).select(*[F.col(k).alias("r" + k) for k in key], F.col("_r").alias("r_r"), "_base", "_in")
    at = [F.least(F.col("_total") - 1, F.floor(F.col("_total") * F.lit(s))) for s in shares.values()]
    holds = F.lit(False)
    for x in at:
        holds = holds | ((x >= F.col("_base")) & (x < F.col("_base") + F.col("_in")))
    # Only the ranges that hold a sought place are cumulated.
    some = placed.join(ranges, [*match(["r" + k for k in key], key), F.col("_r") == F.col("r_r")]).filter(holds)
    upto = F.col("_base") + F.sum("_n").over(Window.partitionBy(*key, "_r").orderBy("_v"))
    found = some.withColumn("_upto", upto)
    picks = [F.max(F.when((x < F.col("_upto")) & (x >= F.col("_upto") - F.col("_n")), F.col("_v"))).alias(name) for x, name in zip(at, shares, strict=True)]
    return found.groupBy(*key).agg(*picks).select(*by, *shares)


def metrics(of: DataFrame, by: list[str] = ()) -> DataFrame:
    """Recall at 1, 3 and 5 (over cases that can be met within k), MRR, share of right empty answers and its complement."""
    share = lambda hit, base: F.coalesce(F.avg(F.when(base, F.when(hit, 1.0).otherwise(0.0))), F.lit(0.0))
    pos = F.col("is_positive")
    recall = [share(F.col(f"hit_at{k}"), pos & (F.col("expected_count") <= k)).alias(f"recall_at{k}") for k in KS]
    none = share(F.col("returned_none"), ~pos)
    negatives = F.count(F.when(~pos, 1))
    return of.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count(F.when(pos, 1)).alias("positives"), negatives.alias("negatives"), *recall,
        F.coalesce(F.avg(F.when(pos, F.col("reciprocal_rank"))), F.lit(0.0)).alias("mrr"), none.alias("no_result_accuracy"), F.when(negatives == 0, 0.0).otherwise(1.0 - none).alias("false_positive_rate"),
    )


def in_groups(of: DataFrame) -> DataFrame:
    """One row for each of the overlapping groups that a case belongs to."""
    pos, scope, regression = F.col("is_positive"), F.col("scope"), F.col("origin") == "regression"
    names = F.array(
        F.lit("all"), F.when(~regression, "golden"), F.when(regression, "regression"), F.when(pos & (scope == "in_scope"), "in_scope"),
        F.when(pos & (scope == "cross_language"), "cross_language"), F.when(pos & (scope == "in_scope") & regression, "in_scope_regression"),
    )
    return of.select("*", F.explode(F.array_compact(names)).alias("group"))


def failures(of: DataFrame) -> DataFrame:
    """Cases that don't pass at 5: positives without a hit, negatives with an answer."""
    return of.filter(F.when(F.col("is_positive"), ~F.col("hit_at5")).otherwise(~F.col("returned_none")))


def failure_ranks(failed: DataFrame, cases: DataFrame, results: DataFrame) -> DataFrame:
    """``failed`` with the best rank that each arm gives the first expected note: keyword_rank, vector_rank and hybrid_rank, null where it has none.

    ``results``: case_id, note_id, keyword_rank, vector_rank, rank (of all, by note); hybrid_rank is that of the first relevant note.
    """
    first = cases.select("case_id", F.get("expected", F.lit(0)).alias("note_id"))
    arms = first.join(results, ["case_id", "note_id"]).groupBy("case_id").agg(F.min("keyword_rank").alias("keyword_rank"), F.min("vector_rank").alias("vector_rank"))
    any_of = cases.select("case_id", F.explode("expected").alias("note_id")).join(results, ["case_id", "note_id"]).groupBy("case_id").agg(F.min("rank").alias("hybrid_rank"))
    return failed.join(arms, "case_id", "left").join(any_of, "case_id", "left")


def by_category(of: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows (category, cases, hits_at1, hits_at3, hits_at5, recall_at1) of the positives in each category; ``categories``: case_id, category."""
    hits = [F.count(F.when(F.col(f"hit_at{k}"), 1)).alias(f"hits_at{k}") for k in KS]
    return of.filter("is_positive").join(categories, "case_id").groupBy("category").agg(F.count("*").alias("cases"), *hits, F.avg(F.col("hit_at1").cast("int")).alias("recall_at1"))


# Metrics in their order with their label, unit and whether lower is better.
METRICS = (("recall_at1", "Recall@1", "", False), ("recall_at3", "Recall@3", "", False), ("recall_at5", "Recall@5", "", False), ("mrr", "MRR", "", False), ("p50", "P50", "ms", True), ("p95", "P95", "ms", True))


def metric_deltas(current: DataFrame, baseline: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Rows (metric, current, baseline, delta, direction) of two one-row metric tables; latencies are better if lower."""
    lower = {name for name, _, _, low in METRICS if low}
    names = [c for c in current.columns if c in baseline.columns]
    both = current.select([F.col(c).cast("double").alias(c) for c in names]).join(F.broadcast(baseline.select([F.col(c).cast("double").alias("b_" + c) for c in names])))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("current"), F.col("b_" + c).alias("baseline"), F.lit(c in lower).alias("low")) for c in names]))
    d = both.select(rows.alias("r")).select("r.*").withColumn("delta", F.col("current") - F.col("baseline"))
    better = F.when(F.col("low"), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    return d.select("metric", "current", "baseline", "delta", F.when(F.abs("delta") < epsilon, "unchanged").when(better, "better").otherwise("worse").alias("direction"))


def tradeoff(deltas: DataFrame) -> DataFrame:
    """One row (summary): in a sentence what got better and what worse; ``deltas`` are at most the six metrics."""
    order = F.lit(None).cast("int")
    text = F.lit(None).cast("string")
    for i, (name, label, unit, _) in enumerate(METRICS):
        size = F.concat(F.round(F.abs("delta")).cast("long").cast("string"), F.lit(" " + unit)) if unit else F.format_string("%.3f", F.abs("delta"))
        mine = F.col("metric") == name
        order = F.when(mine, i).otherwise(order)
        text = F.when(mine, F.concat(F.lit(label + " "), F.when(F.col("delta") > 0, "+").when(F.col("delta") < 0, "−").otherwise(""), size)).otherwise(text)
    low = F.col("metric").isin([name for name, _, _, lower in METRICS if lower])
    is_ = lambda d: F.col("direction") == d
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    found = deltas.select("*", order.alias("_o"), text.alias("_t")).agg(
        some(~low & is_("better")).alias("up"), some(~low & is_("worse")).alias("down"), some(low & is_("worse")).alias("slow"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") != "unchanged", F.struct("_o", "_t")))), lambda x: x["_t"]), " · ").alias("detail"),
    )
    c = F.col
    quality = F.when(c("up") & ~c("down"), "质量提升").when(c("down") & ~c("up"), "质量下降").when(c("up"), "质量有涨有跌")
    said = F.concat(F.concat_ws("，", quality, F.when(c("slow"), "延迟回退").otherwise("延迟未回退")), F.lit("。"), c("detail"), F.lit("。是否上线由 Release Gate 判定。"))
    return found.select(F.when(c("up") | c("down") | c("slow"), said).otherwise("与基线基本一致，没有可观察的差异。").alias("summary"))


def arms_table(arms: DataFrame, title: str) -> DataFrame:
    """One row (report): a Markdown table of experiment arms (place, arm, recall_at1, recall_at3, recall_at5, mrr, p50, p95, build_ms), a few rows."""
    line = F.format_string("| %s | %.3f | %.3f | %.3f | %.3f | %.2f ms | %.2f ms | %.0f ms |", "arm", "recall_at1", "recall_at3", "recall_at5", "mrr", "p50", "p95", "build_ms")
    head = f"| {title} | Recall@1 | Recall@3 | Recall@5 | MRR | P50 | P95 | 建索引 |\n|---|---|---|---|---|---|---|---|"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return arms.agg(F.concat_ws("\n", F.lit(head), lines).alias("report"))


def abstention_signals(results: DataFrame) -> DataFrame:
    """Rows (query_id, top1, margin, top1_to_mean, has_keyword, n) of results (query_id, similarity, keyword_rank); results without a similarity don't count for the first three."""
    by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"))
    r = results.withColumn("i", F.when(F.col("similarity").isNotNull(), F.row_number().over(by)))
    top1, top2 = F.max(F.when(F.col("i") == 1, F.col("similarity"))), F.max(F.when(F.col("i") == 2, F.col("similarity")))
    mean = F.avg(F.when(F.col("i") > 1, F.col("similarity")))
    return r.groupBy("query_id").agg(top1.alias("top1"), (top1 - top2).alias("margin"), F.when(mean > 0, top1 / mean).alias("top1_to_mean"), F.bool_or(F.col("keyword_rank").isNotNull()).alias("has_keyword"), F.count("*").alias("n"))


def abstain(floor: float = 0, min_margin: float = 0, min_ratio: float = 0, floor_without_keyword: float = 0, band: float = 1.5) -> Column:
    """confident, uncertain or abstain, from the columns of :func:`abstention_signals`; all thresholds at 0 never abstain."""
    if not (floor or min_margin or min_ratio or floor_without_keyword):
        return F.lit("confident")
    has, top1, n = F.col("has_keyword"), F.col("top1"), F.col("n")
    least = F.when(has, F.lit(float(floor))).otherwise(F.lit(float(max(floor, floor_without_keyword))))
    margin, ratio = F.coalesce("margin", F.lit(float("inf"))), F.coalesce("top1_to_mean", F.lit(float("inf")))
    unsure = ((top1 < least * band) & (least > 0)) | (F.lit(min_margin > 0) & (margin < min_margin * band))
    return (
        F.when(n == 0, "abstain").when(top1.isNull(), F.when(has, "confident").otherwise("abstain")).when(top1 < least, "abstain")
        .when(F.lit(min_margin > 0) & (margin < min_margin), "abstain").when(F.lit(min_ratio > 0) & (ratio < min_ratio), "abstain").when(unsure, "uncertain").otherwise("confident")
    )


def calibration(signals: DataFrame) -> DataFrame:
    """One row from (is_positive, top1): lowest positive, highest negative, their gap, how many negatives lie below it, the margin to the nearest of those (0 if none), and the medians at n // 2."""
    pos, neg = F.when(F.col("is_positive"), F.col("top1")), F.when(~F.col("is_positive"), F.col("top1"))
    low = signals.agg(F.min(pos).alias("positive_min"), F.max(neg).alias("negative_max"))
    middle = group_percentiles(signals, ["is_positive"], "top1", {"m": 0.5}).agg(F.max(F.when(F.col("is_positive"), F.col("m"))).alias("positive_median"), F.max(F.when(~F.col("is_positive"), F.col("m"))).alias("negative_median"))
    under = ~F.col("is_positive") & (F.col("top1") < F.col("positive_min"))
    below = signals.join(F.broadcast(low.select("positive_min"))).agg(F.count(F.when(under, 1)).alias("negatives_below"), F.max(F.when(under, F.col("top1"))).alias("nearest"))
    one = low.join(F.broadcast(middle)).join(F.broadcast(below))
    return one.select("positive_min", "negative_max", "positive_median", "negative_median", "negatives_below", (F.col("positive_min") - F.col("negative_max")).alias("gap"), F.coalesce(F.col("positive_min") - F.col("nearest"), F.lit(0.0)).alias("safety_margin"))


def add_cases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New cases added once: equal trimmed queries with equal sets of expected notes are one case."""
    from ..functions.text import trim

    key = lambda d: d.withColumns({"_q": trim(F.col("query")), "_e": F.array_join(F.array_sort(F.array_distinct("expected")), "\u0001")})
    fresh = key(new).dropDuplicates(["_q", "_e"]).join(key(existing).select("_q", "_e").distinct(), ["_q", "_e"], "left_anti")
    return existing.unionByName(fresh.drop("_q", "_e").select(existing.columns))


def dangling(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (case_id, note_id): expected notes that don't exist."""
    return cases.select("case_id", F.explode("expected").alias("note_id")).join(notes.select("note_id"), "note_id", "left_anti").select("case_id", "note_id")


def stratified_split(cases: DataFrame, by: str, order: str = "case_id") -> DataFrame:
    """Adds ``split``: of each ten cases of a stratum, places 0, 4 and 7 are held out.  No stratum is sorted in one task."""
    of_ten = placed(cases, [by], [order], "_place").withColumn("_place", F.col("_place") % 10)
    return of_ten.select(*cases.columns, F.when(F.col("_place").isin(0, 4, 7), "holdout").otherwise("development").alias("split"))


def split_overlap(cases: DataFrame, key: str) -> DataFrame:
    """Rows (key, splits): values of ``key`` that occur in more than one split; none if the splits are apart."""
    return cases.groupBy(key).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def leakage(cases: DataFrame, notes: DataFrame, least: int = 12, exempt: Column | None = None) -> DataFrame:
    """Rows (case_id, note_id): notes that contain a whole query of at least ``least`` characters, white space and case apart; cases that are ``exempt`` aside."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    some = cases if exempt is None else cases.filter(~exempt)
    q = some.select(F.col("case_id").alias("pattern_id"), squeeze(F.col("query")).alias("pattern")).filter(F.length("pattern") >= least)
    found = containing(notes.select(F.col("note_id").alias("text_id"), squeeze(F.col("text")).alias("text")), q)
    return found.select(F.col("pattern_id").alias("case_id"), F.col("text_id").alias("note_id"))


def _trigrams(queries: DataFrame) -> DataFrame:
    """Rows (id, g): the sorted set of trigrams of each query that isn't blank, case and white space apart; shorter ones whole."""
    s = queries.select("id", F.regexp_replace(F.lower("query"), r"\s+", "").alias("s")).filter("s <> ''")
    n = F.length("s")
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring("s", i, F.lit(3))))
    return s.select("id", F.array_sort(F.when(n < 3, F.array("s")).otherwise(some)).alias("g"))


def trigram_digest(text: str) -> bytes:
    """SHA-256 of the set of trigrams of a text that isn't empty, of fewer characters of the whole; equal for equal sets."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(c) >= 3:
        c = np.sort(c[:-2] << 42 | c[1:-1] << 21 | c[2:])  # code points have 21 bits
        c = c[np.diff(c, prepend=-1) != 0]
        return hashlib.sha256(b"3" + c.tobytes()).digest()
    return hashlib.sha256(b"%d" % len(c) + c.tobytes()).digest()


def query_classes(queries: DataFrame) -> DataFrame:
    """Rows (id, rep): queries with equal sets of trigrams are one class, known by its smallest id.

    Sets are sent and compared as SHA-256 digests, as they take more room than their texts.
    """
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.greater(pc.binary_length(batch.column(1)), 0))
            digests = pa.array([trigram_digest(x.as_py()) for x in some.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), digests], names=["id", "g"])

    squeezed = F.regexp_replace(F.lower("query"), r"\s+", "")
    g = kept(queries.select("id", squeezed.alias("s")).mapInArrow(run, f"id {kind}, g binary"))
    return g.join(g.groupBy("g").agg(F.min("id").alias("rep")), "g").select("id", "rep")


def trigram_similarity(queries: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows (a, b, similarity): pairs of classes (see :func:`query_classes`) whose trigram sets have a Jaccard similarity of ``least`` or more.

    Two such sets share one of their rarest trigrams, all but the first ``least`` share of each
    set in order of frequency; and where they first meet there, enough of both must be left.
    Only pairs for which both hold are compared, so common trigrams pair nothing.
    """
    g = kept(_trigrams(queries).groupBy("g").agg(F.min("id").alias("id")).withColumn("n", F.size("g")))
    each = g.select("id", "n", F.explode("g").alias("gram"))
    rare = each.join(each.groupBy("gram").agg(F.count("*").alias("f")), "gram").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("f", "gram")))
    prefix = rare.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("id", "n", "gram", "place")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n") - 1e-9
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + F.least("x.place", "y.place")
    enough = left >= F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-9
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")) & near & enough).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    sets = lambda side: g.select(F.col("id").alias(side), F.col("g").alias("g_" + side))
    shared = F.size(F.array_intersect("g_a", "g_b"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", (shared / (F.size("g_a") + F.size("g_b") - shared)).alias("similarity"))
    return both.filter(F.col("similarity") >= least)


def checksum(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: SHA-256 over the digests of all rows, whatever their order; for tables too large for :func:`dataset_checksum`, which has another law.

    Rows are dealt by the first four digits of their digests; a bucket's digests in order
    make one digest, and those of the 65,536 buckets at most make the checksum.
    """
    rows = df.select(F.sha2(F.concat_ws("|", F.col(key).cast("string"), value), 256).alias("d"))
    parts = rows.groupBy(F.substring("d", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("checksum"))


def canonical_json(value: Column, kind: t.DataType) -> Column:
    """A struct as JSON with its keys in order at every depth, no blanks, and nulls left out; letters stay as they are."""

    def ordered(c: Column, k: t.DataType) -> Column:
        if isinstance(k, t.StructType):
            made = F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(k.fields, key=lambda f: f.name)])
            return F.when(c.isNotNull(), made)
        if isinstance(k, t.ArrayType):
            return F.transform(c, lambda x: ordered(x, k.elementType))
        if isinstance(k, t.MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(c)))
        return c

    return F.to_json(ordered(value, kind))


def dataset_checksum(dataset: DataFrame) -> DataFrame:
    """``dataset`` (one row for each JSON file) with ``computed``: ``sha256:`` and the digest of its canonical JSON without the checksum itself.

    Notes, cases and negatives are taken in order of their ids, so a file's order doesn't matter.
    """
    by_id = lambda c: F.array_sort(c, lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    fields = [f for f in dataset.schema if f.name != "checksum"]
    whole = F.struct(*[(by_id(F.col(f.name)) if isinstance(f.dataType, t.ArrayType) else F.col(f.name)).alias(f.name) for f in fields])
    return dataset.withColumn("computed", F.concat(F.lit("sha256:"), F.sha2(canonical_json(whole, t.StructType(fields)), 256)))


def profile(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of each value of each column: (field, value, n, share).  One row of totals is broadcast."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in by])).alias("r")).select("r.*")
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(df.agg(F.count("*").alias("total")))).select("field", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def clusters(df: DataFrame, by: str, shown: int = 5) -> DataFrame:
    """Rows (cluster, n, beyond): the sizes of clusters, and whether one is too large to be shown whole among the first ``shown``."""
    return df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("cluster")).agg(F.count("*").alias("n")).withColumn("beyond", F.col("n") > shown)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n): values that occur more than once."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def token_totals(calls: DataFrame) -> DataFrame:
    """One row (tokens, reported_calls, unreported_calls) from the ``prompt_tokens`` of calls, null where a service didn't say."""
    said = F.count("prompt_tokens")
    return calls.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens"), said.alias("reported_calls"), (F.count("*") - said).alias("unreported_calls"))


def failure_breakdown(failed: DataFrame, kind: str) -> DataFrame:
    """Failures by kind, the most frequent first, then by name; failures without a kind don't count."""
    return failed.filter(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind)


def regression_rate(of: DataFrame) -> DataFrame:
    """One row: recall at 5 of the regression cases in scope, 1 if there are none."""
    mine = F.col("is_positive") & (F.col("origin") == "regression") & (F.col("scope") == "in_scope") & (F.col("expected_count") <= 5)
    any_case = F.count(F.when(F.col("is_positive") & (F.col("origin") == "regression") & (F.col("scope") == "in_scope"), 1)) > 0
    rate = F.coalesce(F.avg(F.when(mine, F.col("hit_at5").cast("int"))), F.lit(0.0))
    return of.agg(F.when(any_case, rate).otherwise(1.0).alias("regression_rate"))


def leader(arms: DataFrame) -> DataFrame:
    """One row: the arm with the highest recall at 5, by MRR if they tie, then by name."""
    best = F.min_by("arm", F.struct(-F.col("recall_at5"), -F.col("mrr"), F.col("arm")))
    return arms.agg(best.alias("leader"))


def participation(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (scope, cases, with_hit, share): how many cases have a keyword hit at all."""
    have = hits.select("case_id").distinct().withColumn("has", F.lit(1))
    j = cases.join(have, "case_id", "left")
    return j.groupBy("scope").agg(F.count("*").alias("cases"), F.count("has").alias("with_hit"), (F.count("has") / F.count("*")).alias("share"))
