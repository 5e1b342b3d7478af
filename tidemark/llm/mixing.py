"""Mixing sources to target weights by entropy balancing.

Every document has a size in words and a prior rate, by default one that falls
with the length of short texts.  The mix takes rate times size words of each, and the
rates are those nearest to the priors, in relative entropy per word, for which every
source takes its target and no rate passes the cap.  The dual is convex and has one
multiplier for each source; Newton steps within a bracket solve it, each one aggregation
by source:

    rate = min(cap, prior * exp(multiplier))

So the documents of a source differ in their rates, and where some reach the cap the
others make up for it.  Rates depend on source and prior only, so documents are first
summed by these two.  Rates then become whole copies by systematic rounding in order of
size, which leaves each source off by one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, if_small, parallelism, word_count

CAP = 3.0
OFFSETS = 32
#: Texts of so many words have a prior of 1; each halving of the length below it takes off a factor of ``SHORTER``.
FULL_WORDS = 64
SHORTER = 0.75
#: Last corrections by one copy of one document in each source.
FIXES = 2


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = CAP) -> DataFrame:
    """Adds ``target`` to ``sources`` (source, source_size; a row for each source).

    Weights repeat over the sources in order of code points, null last, and share
    out all sizes; a target stops at ``cap`` times its source and the excess is
    shared again by weight until no target is above.  Sources without words get 0.
    The order of all sources, a narrow row each, is one sort; it spills if they are many.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("w", w)
    # Water filling: sources stop at the cap in ascending order of cap * size / weight.
    by = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    found = weighed.withColumn("level", level).withColumn(
        "level", F.first(F.when(F.col("level") * F.col("w") <= cap * F.col("source_size"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    return found.select("source", "source_size", F.least(F.col("level") * F.col("w"), cap * F.col("source_size")).cast("double").alias("target"))


def length_prior(size: Column) -> Column:
    """The default prior: 1 from ``FULL_WORDS`` words on, less for shorter texts, by octaves (so that few priors differ)."""
    top = FULL_WORDS.bit_length() - 1
    return F.pow(F.lit(SHORTER), F.greatest(F.lit(0), F.lit(top) - F.floor(F.log2(size + F.lit(0.5)))).cast("double"))


def balance(strata: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """Solves the dual; returns (source, prior, rate).

    ``strata``: source, prior (above 0), size (words of all documents with both).  Newton
    steps that leave the bracket of a source's multiplier are replaced by its middle, so
    any targets up to ``cap`` times the size are met; it raises if ``max_steps`` do not suffice.
    """
    state = cut(
        targets.join(strata.groupBy(F.col("source").alias("p_source")).agg(F.min("prior").alias("least")), F.col("source").eqNullSafe(F.col("p_source"))).select(
            "source", "target", (F.col("source_size") > 0).alias("live"), F.when(F.col("source_size") > 0, F.log(F.greatest(F.col("target"), F.lit(1e-300)) / F.col("source_size"))).otherwise(F.lit(0.0)).alias("multiplier"),
            F.lit(-800.0).alias("lo"), (F.log(F.lit(float(cap)) / F.col("least")) + 1).alias("hi"),
        )
    )
    rate = F.least(F.lit(float(cap)), F.col("prior") * F.exp("multiplier"))
    for _ in range(max_steps):
        s = state.withColumnRenamed("source", "state_source")
        sums = (
            strata.join(s, F.col("source").eqNullSafe(F.col("state_source")))
            .withColumn("rate", rate)
            .groupBy("source", "target", "live", "multiplier", "lo", "hi")
            .agg(F.sum(F.col("size") * F.col("rate")).alias("taken"), F.sum(F.when(F.col("rate") < cap, F.col("size") * F.col("rate")).otherwise(0.0)).alias("slope"))
        )
        newton = F.col("multiplier") + (F.col("target") - F.col("taken")) / F.when(F.col("slope") > 0, F.col("slope"))
        lo, hi = F.when(F.col("taken") < F.col("target"), F.col("multiplier")).otherwise(F.col("lo")), F.when(F.col("taken") > F.col("target"), F.col("multiplier")).otherwise(F.col("hi"))
        off = F.when(F.col("live"), F.abs(F.col("target") - F.col("taken")) / F.greatest(F.col("target"), F.lit(1.0))).otherwise(0.0)
        moved = cut(sums.withColumns({"off": off, "newton": newton, "new_lo": lo, "new_hi": hi}))
        worst = moved.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            s = state.withColumnRenamed("source", "state_source")
            return strata.join(s, F.col("source").eqNullSafe(F.col("state_source"))).select("source", "prior", F.round(rate, 9).alias("rate"))
        inside = (F.col("newton") > F.col("new_lo")) & (F.col("newton") < F.col("new_hi"))
        step = F.when(F.col("off") <= tolerance, F.col("multiplier")).when(inside, F.col("newton")).otherwise((F.col("new_lo") + F.col("new_hi")) / 2)
        state = moved.select("source", "target", "live", step.alias("multiplier"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"))
    raise RuntimeError(f"rates did not settle in {max_steps} steps")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = CAP, text: str = "text", id: str = "doc_id", source: str = "source", prior: Column | None = None) -> DataFrame:
    """One row for each document: id, key, source, size, source_size, target, rate, copies, taken.

    ``prior`` is a column of ``docs`` above 0, best with few values (by default
    :func:`length_prior`).  ``copies`` is at most ``cap``.  A null text has no words and gets
    no copies beyond its rate; a null source is a source of its own and comes last.
    ``key`` is a hash of id and text: rows that repeat both share it and may change places,
    all others are told apart.  An empty table gives an empty result.
    """
    n_words = word_count(F.col(text))
    docs = cut(
        docs.select(
            F.col(id).alias("id"), F.col(source).alias("source"), n_words.alias("size"),
            (prior if prior is not None else length_prior(n_words)).cast("double").alias("prior"), F.xxhash64(F.col(id), F.col(text)).alias("h"),
        )
    )
    strata = cut(docs.groupBy("source", "prior").agg(F.sum("size").alias("size")))
    targets = cut(source_targets(strata.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    rates = cut(balance(strata, targets, cap))

    # Cells of like size within a source; a large source has many, more on a larger cluster, so no task gets all of it.
    salts = parallelism(docs.sparkSession)
    cell = F.floor(F.log2(F.col("size") + 1) * 8).cast("int") * salts + F.pmod(F.col("h"), F.lit(salts)).cast("int")
    placed = docs.withColumn("cell", cell)
    # A row for each source and prior: broadcast if these are few, so that a large source isn't dealt by its name.
    r = if_small(rates.select(F.col("source").alias("r_source"), F.col("prior").alias("r_prior"), "rate"))
    with_rate = lambda d: d.join(r, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("prior") == F.col("r_prior"))).drop("r_source", "r_prior")
    cells = with_rate(placed.groupBy("source", "prior", "cell").agg(F.count("*").alias("n"))).groupBy("source", "cell").agg(F.sum(F.col("n") * F.col("rate")).alias("mass"))
    starts = cells.select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), F.coalesce(F.sum("mass").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("start"))
    in_cell = Window.partitionBy("source", "cell").orderBy("size", "h", "id")
    run = with_rate(placed).withColumn("run", F.sum("rate").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)))
    run = cut(
        run.join(starts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
        .select("id", F.col("h").alias("key"), "source", "size", "rate", F.round(F.col("start") + F.col("run"), 6).alias("upto"))
    )
    copies_at = lambda u: F.floor(F.col("upto") + u) - F.floor(F.round(F.col("upto") - F.col("rate"), 6) + u)
    grid = [(k + 0.5) / OFFSETS for k in range(OFFSETS)]
    # Of a fixed set of offsets, each source takes the one that lands nearest to its target.
    sums = run.groupBy("source").agg(*[F.sum(F.col("size") * copies_at(F.lit(u))).alias(f"s{k}") for k, u in enumerate(grid)])
    t = targets.withColumnRenamed("source", "t_source")
    best = sums.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "t_source", "source_size", "target", F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(u).alias("u")) for k, u in enumerate(grid)]))["u"].alias("u")
    )
    copies = F.least(F.lit(int(cap)), F.greatest(F.lit(0), copies_at(F.col("u")))).cast("int")
    out = cut(
        run.join(if_small(cut(best)), F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("copies", copies)
        .select("id", "key", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies")
    )
    for _ in range(FIXES):
        out = _nearer(out, int(cap))
    return out.withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def _nearer(out: DataFrame, cap: int) -> DataFrame:
    """Gives one document of each source a copy more or less where that brings the source nearer to its target."""
    off = out.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("off")).withColumnRenamed("source", "o_source")
    move = F.when((F.col("off") > 0) & (F.col("copies") < cap), 1).when((F.col("off") < 0) & (F.col("copies") > 0), -1)
    left = F.abs(F.col("off") - move * F.col("size"))
    chosen = (
        out.join(if_small(cut(off)), F.col("source").eqNullSafe(F.col("o_source")))
        .filter(move.isNotNull() & (left < F.abs("off")))
        .groupBy(F.col("source").alias("m_source"))
        .agg(F.min(F.struct(left.alias("left"), F.col("id").alias("m_id"), F.col("key").alias("m_key"), F.col("size").alias("m_size"), F.col("copies").alias("m_copies"), move.alias("move"))).alias("m"))
        .select("m_source", "m.*")
    )
    same = F.col("source").eqNullSafe(F.col("m_source")) & F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")) & (F.col("copies") == F.col("m_copies"))
    return out.join(if_small(cut(chosen)), same, "left").select(*[c for c in out.columns if c != "copies"], (F.col("copies") + F.coalesce("move", F.lit(0))).cast("int").alias("copies"))


def repeat_by_mix(df: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = CAP, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it; all columns are kept.

    Rows that share an id but not the text take each their own copies.  Of rows that
    repeat both, the first so many in any order take one copy more than the others, so that together
    they take what the mix gives them.
    """
    key, copies, times, place = fresh(df, "mix_key", "copies", "times", "place")
    c_key, c_source = fresh(df, "c_key", "c_source")
    found = cut(mix(df, weights, cap, text, id, source))
    taken = found.groupBy(F.col("key").alias(c_key), F.col("source").alias(c_source)).agg(F.sum("copies").alias(copies), F.count("*").alias(times)).filter(F.col(copies) > 0)
    keyed = df.withColumn(key, F.xxhash64(F.col(id), F.col(text)))
    joined = keyed.join(taken, (F.col(key) == F.col(c_key)) & F.col(source).eqNullSafe(F.col(c_source)))
    share = F.col(copies)
    if not taken.filter(F.col(times) > 1).isEmpty():
        joined = joined.withColumn(place, F.row_number().over(Window.partitionBy(key, source).orderBy(F.lit(0))))
        share = F.floor(F.col(copies) / F.col(times)) + F.when(F.col(place) <= F.col(copies) % F.col(times), 1).otherwise(0)
    return joined.withColumn(copies, share.cast("int")).filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*df.columns)
