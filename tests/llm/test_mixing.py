import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def targets(sizes):
    """Shares by weight, again and again, until none is above three times its source."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(w[s] for s in rest))
        above = [s for s in rest if w[s] * level > 3 * sizes[s] + 1e-9]
        if not above:
            return fixed | {s: w[s] * level for s in rest}
        fixed |= {s: 3 * sizes[s] for s in above}


def test_mix(spark, docs):
    random.seed(4)
    rows = [(i, "w " * min(2000, int(random.paretovariate(1.1) * 20)), random.choice(["b", "a", "é", None, "Z", "c"])) for i in range(1500)]
    rows += [(2000, "tiny one", "aa"), (2001, None, "zz"), (2002, "", "zz"), (None, "w " * 50, "a")]
    out = mixing.mix(docs(*rows)).collect()
    size, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
    assert len(out) == len(rows) and target == pytest.approx(targets(size))
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in target)
    # Within a source, short texts have lower rates by the default prior, unless all are at the cap.
    rates = {}
    for r in out:
        rates.setdefault(r.source, {}).setdefault(r["size"] >= mixing.FULL_WORDS, set()).add(r.rate)
    assert any(len(by.get(True, {1})) == 1 and by.get(False) and max(by[False]) < min(by.get(True, {9})) for by in rates.values())
    for r in out:
        assert r.copies in (0, 1, 2, 3) and abs(r.copies - r.rate) < 2
    again = mixing.mix(docs(*rows).repartition(5)).collect()
    assert sorted((r.id or -1, r["size"], r.taken) for r in out) == sorted((r.id or -1, r["size"], r.taken) for r in again)


def test_newton_meets_targets_with_priors(spark):
    strata = spark.createDataFrame([("a", 0.1, 100), ("a", 1.0, 300), ("a", 2.5, 200), (None, 1.0, 50), ("z", 1.0, 0)], "source string, prior double, size long")
    goal = spark.createDataFrame([("a", 600, 1300.0), (None, 50, 20.0), ("z", 0, 0.0)], "source string, source_size long, target double")
    rates = {(r.source, r.prior): r.rate for r in mixing.balance(strata, goal).collect()}
    assert 100 * rates["a", 0.1] + 300 * rates["a", 1.0] + 200 * rates["a", 2.5] == pytest.approx(1300, rel=1e-6)
    # With all rates at the cap, and with a target far below, the bracket holds.
    hard = spark.createDataFrame([("a", 600, 1800.0), (None, 50, 0.001), ("z", 0, 0.0)], "source string, source_size long, target double")
    rigid = {(r.source, r.prior): r.rate for r in mixing.balance(strata, hard).collect()}
    assert {rigid["a", p] for p in (0.1, 1.0, 2.5)} == {3.0} and rigid[None, 1.0] == pytest.approx(0.001 / 50, abs=1e-9)
    with pytest.raises(RuntimeError):
        mixing.balance(strata, goal, max_steps=1)
    assert rates["a", 2.5] == 3 and rates["a", 1.0] / rates["a", 0.1] == pytest.approx(10, rel=1e-5) and rates[None, 1.0] == pytest.approx(0.4)


def test_edges(spark, docs):
    assert mixing.mix(docs((1, "a")).limit(0)).count() == 0
    odd = docs((1, "a b", "s"), (1, "a b", "s"), (2, "c", "s")).withColumns({"copies": F.lit(1), "copies_id": F.lit(2), "target": F.lit(0), "size": F.lit(0)})
    out = mixing.repeat_by_mix(odd)
    assert out.columns == odd.columns and set(r.doc_id for r in out.collect()) <= {1, 2}
    long = mixing.mix(docs((1, "w " * 300_000, "s"), (2, "a", "s"), (3, "b c", "t"), (4, None, None))).collect()
    assert len(long) == 4 and sum(r.source_size for r in long if r.id in (1, 3)) == 300_003 and all(r.copies <= 3 for r in long)
    # Rows that share an id, or id and text, take together what the mix gives them.
    rows = [(1, f"w{i} " * (20 + i), "s") for i in range(40)] + [(2, "same words " * 30, "t")] * 7 + [(3, "x " * 500, "u")]
    given = sum(r.taken for r in mixing.mix(docs(*rows)).collect())
    assert sum(len(r.text.split()) for r in mixing.repeat_by_mix(docs(*rows)).collect()) == given
