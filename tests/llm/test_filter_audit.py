"""The audit against filters that are really applied one after the other."""

from itertools import permutations

from tidemark.llm.filter_audit import audit, flagged, orders

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, flags, losses):
    """Rows of the audit by applying every order to every row."""
    out = {}
    for part in {r["part"] or "" for r in rows}:
        mine = [r for r in rows if (r["part"] or "") == part]
        for order in map("".join, permutations(flags)):
            left = mine
            for step, f in enumerate(order, 1):
                bad = [r for r in left if r[f]]
                fails = [r for r in mine if r[f]]
                row = {"kept": len(left) - len(bad), "removed": len(bad), "redundant": len(fails) - len(bad), "unique_fails": sum(all(not r[g] for g in flags if g != f) for r in fails)}
                row |= {f"{x}_lost": sum(bool(r[x]) for r in bad) for x in losses}
                out[part, order, step] = row
                left = [r for r in left if not r[f]]
        total = {f: sum(v["removed"] for (p, o, s), v in out.items() if p == part and o[s - 1] == f) for f in flags}
        for (p, o, s), v in out.items():
            if p == part:
                v["shapley"] = total[o[s - 1]]
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in df.collect()}


def flags_of(docs, labels):
    """The flags by plain Python."""
    import re

    out = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        mine = [x for x in labels if i is not None and x[0] == i]
        out.append({
            "part": source or "", "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs), "good": any(x[1] == 1 for x in mine), "toxic": any(x[2] == 1 for x in mine),
        })
    return out


DOCS = [
    (1, "one " * 60, "a"), (2, "one " * 60, "a"), (3, " ".join(f"w{i}" for i in range(70)), "a"), (4, " ".join(f"w{i}" for i in range(70)), None), (5, None, "b"), (6, "", "b"), (7, "LOUD WORDS", "b"),
    (8, " ".join(f"É{i} 50%" for i in range(50)), ""), (9, " ".join(f"w{i}" for i in range(49)) + "\x85x", "a"), (9, "LOUD WORDS", "a"), (None, "LOUD WORDS", "b"), (None, "alone here", "b"), (12, "a\x0bb\x0cc " * 40, "c"),
    (13, " ".join(f"X{i}y" for i in range(50_000)), "c"),
]
LABELLED = [(1, 1, 0), (2, 1, 1), (2, None, 0), (3, 0, None), (7, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_every_order_as_if_applied(spark):
    docs = spark.createDataFrame([(i, t, s, s) for i, t, s in DOCS], "doc_id long, text string, source string, A string").repartition(3)
    rows = flagged(docs, spark.createDataFrame(LABELLED, LABELS))
    want = flags_of(DOCS, LABELLED)
    key = lambda r: sorted((k, v) for k, v in r.items())
    assert sorted(key({**r.asDict(), "part": r.part or ""}) for r in rows.collect()) == sorted(key(r) for r in want)
    got = found(audit(rows))
    assert len(got) == 4 * 600 and got == brute(want, "ABCDE", ("good", "toxic"))


def test_a_hot_part_other_filters_and_nulls(spark):
    rows = [{"part": "hot" if i % 3 else None, "x": i % 2 == 0, "y": None if i % 5 == 0 else i % 7 < 3, "bad": None if i % 4 == 0 else True} for i in range(3000)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "part string, x boolean, y boolean, bad boolean")
    assert found(audit(df, "xy", losses=("bad",))) == brute(rows, "xy", ("bad",))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(flagged(docs, spark.createDataFrame([], LABELS))).collect() == []


def test_orders():
    assert len(orders("ABCDE")) == 600 and orders("AB") == [("AB", 1, 0, 0, 1), ("AB", 2, 1, 1, 3), ("BA", 1, 1, 0, 2), ("BA", 2, 0, 2, 3)]
