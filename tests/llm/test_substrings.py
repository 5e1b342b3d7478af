import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings as S


def words(n):
    return [f"{random.choice('bcdfgst')}{random.choice('aeiou')}{random.randrange(300)}" for _ in range(n)]


def test_cuts_resist_insertions():
    random.seed(1)
    w = words(400)
    chunks = lambda ws: {x for _, x in _chunks(" ".join(ws))}
    a, b = chunks(w), chunks(w[:100] + ["inserted"] + w[100:])
    assert len(a & b) >= len(a) - 3


def _chunks(t):
    norm, ends, cuts = S.cut_points(t.encode())
    place = [0, *(ends[cuts] + 1)]
    return [(a, norm[a:b]) for a, b in zip(place, place[1:], strict=False)]


def test_chunks_rebuild_the_text():
    random.seed(2)
    for t in ("", "a", " a\t b\n", "aaaa " * 500, " ".join(words(300)), "é中 x " * 50):
        assert b"".join(c for _, c in _chunks(t)).split() == t.encode().split()


def brute(rows, min_words=S.MIN_WORDS):
    """The parts of repeated passages by plain loops over the windows of each (id, text)."""
    docs = []
    for key in sorted({(i is None, i or 0, xx(t), t) for i, t in rows if t and t.split()}):
        place = _chunks(key[3])
        norm, ends, cuts = S.cut_points(key[3].encode())
        first = [0, *(c + 1 for c in cuts)]
        w = min(S.WINDOW, len(cuts))
        windows = [(first[m], first[m + w] - first[m], b"".join(c for _, c in place[m : m + w])) for m in range(len(place) - w + 1)]
        docs.append((None if key[0] else key[1], windows))
    seen, times = {}, {}
    for d, (i, windows) in enumerate(docs):
        for start, span, t in windows:
            seen.setdefault(t, (d, start, i))
            times[t] = times.get(t, 0) + 1
    out = []
    for d, (i, windows) in enumerate(docs):
        run, runs = [], []
        for start, span, t in windows:
            if times[t] > 1:
                if run and start > max(s + n for s, n, _ in run):
                    runs.append(run)
                    run = []
                run.append((start, span, t))
        for run in [*runs, run]:
            if run and max(s + n for s, n, _ in run) - run[0][0] >= min_words - S.EDGE:
                part = []
                for start, span, t in run:
                    kept = seen[t][:2] == (d, start)
                    if part and part[-1][2] == kept:
                        part[-1][1] = max(part[-1][1], start + span)
                        part[-1][3].append(seen[t][2])
                    else:
                        part.append([start, start + span, kept, [seen[t][2]]])
                out += [(i, a, b - a, kept, min((x for x in of if x is not None), default=None)) for a, b, kept, of in part]
    return sorted(out, key=str)


def xx(t):
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join((t or "").encode().split()) + b" ")).view(np.int64))


def test_spans_equal_brute_force(spark, docs, monkeypatch):
    random.seed(7)
    passages = [words(n) for n in (40, 51, 90)]
    rows = []
    for i in range(40):
        body = words(random.randrange(20, 120))
        for _ in range(i % 3):
            at = random.randrange(len(body))
            body[at:at] = random.choice(passages)
        rows.append((i, " ".join(body)))
    within = words(80)
    rows += [(50, " ".join(words(30) + within + words(20) + within)), (51, "line of ten words that comes again and once more " * 20), (52, None), (53, " "), (54, "x " * 20_000)]
    for extra in ([], [(None, " ".join(passages[2])), (None, " ".join(passages[2])), (7, " ".join(words(5) + passages[1])), (7, " ".join(passages[1] + words(9)))]):
        for hot in (S.HOT_ROWS, 3):
            monkeypatch.setattr(S, "HOT_ROWS", hot)
            spans = S.repeated_spans(docs(*rows, *extra))
            assert sorted(((r.id, r.start_word, r.n_words, r.kept, r.first_id) for r in spans.collect()), key=str) == brute([*rows, *extra])
    twice = [r for r in S.repeated_spans(docs(*rows)).collect() if r.id == 50]
    assert any(r.kept for r in twice) and any(not r.kept and r.n_words > 60 for r in twice)


def test_planted_passages(spark, docs):
    random.seed(3)
    passages = [words(n) for n in (51, 60, 200)]
    rows, holds = [], {}
    for i in range(60):
        body = words(random.randrange(60, 200))
        for k, p in enumerate(passages):
            if i % 4 == 0 and i // 4 % 3 == k:
                at = random.randrange(len(body))
                body[at:at] = p
                holds.setdefault(k, []).append((i, at))
        rows.append((i, random.choice([" ", "\n", "  "]).join(body)))
    clean = {i for i in range(60) if i % 4}
    df = docs(*rows, (None, "no repeat here"), (70, None), (71, "")).withColumns({"digest": F.lit(1), "doc": F.lit(2), "place": F.lit(3), "first": F.lit(4)})
    spans = S.repeated_spans(df).cache()
    got = [(r.id, r.start_word, r.start_word + r.n_words, r.kept, r.first_id) for r in spans.collect()]
    assert not {g[0] for g in got} & (clean | {70, 71})
    for k, places in holds.items():
        first = min(i for i, _ in places)
        for i, at in places:
            (lo, hi, kept, of) = next(g[1:] for g in got if g[0] == i)
            assert at - 3 <= lo <= at + 12 and at + len(passages[k]) - 12 <= hi <= at + len(passages[k]) + 3 and kept == (i == first) and of == first
    out = {r.doc_id: r.text for r in S.remove_spans(df.withColumns({"other": F.lit(1), "cut": F.lit(2)}), spans).collect()}
    assert all(out[i] == t for i, t in rows if i in clean)
    assert all(len(out[i].split()) < len(dict(rows)[i].split()) - 30 for k, places in holds.items() for i, _ in places if i != min(places)[0])
    assert out[min(holds[0])[0]] == dict(rows)[min(holds[0])[0]]


def test_repeated_words_are_cut():
    """Where all words are candidates, or none is, chunks stay short."""
    random.seed(5)
    for t in ("spam " * 1000, "ham " * 999, "a b " * 500, " ".join(words(8)) + " ", " ".join(words(8) * 100), " ".join(words(23) * 40)):
        _, ends, cuts = S.cut_points(t.encode())
        assert len(ends) < 30 or np.diff(cuts).max() <= 30, t[:30]


def test_recall_of_exact_repeats(spark):
    """Of the words of a whole table that lie in an exact repeat of so many words, how many lie in the spans."""
    data = os.environ.get("TEST_LEARN_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: (r.text or "").split() for r in df.select("doc_id", "text").collect()}
    got = {i: np.zeros(len(w), bool) for i, w in texts.items()}
    for r in S.repeated_spans(df).collect():
        got[r.id][r.start_word : r.start_word + r.n_words] = True
    for least, share in ((S.MIN_WORDS, 0.95), (50, 0.97), (80, 0.98)):
        places = {}
        for i, w in texts.items():
            for a in range(len(w) - least + 1):
                places.setdefault(hash(tuple(w[a : a + least])), []).append((i, a))
        true = {i: np.zeros(len(w), bool) for i, w in texts.items()}
        for found in places.values():
            for i, a in found if len(found) > 1 else ():
                true[i][a : a + least] = True
        assert sum((x & got[i]).sum() for i, x in true.items()) >= share * sum(x.sum() for x in true.values())
        assert not [i for i, x in true.items() if x.any() and not (x & got[i]).any()]


def test_nothing(spark, docs):
    assert S.repeated_spans(docs((1, "a")).limit(0)).count() == 0
    same = " ".join(map(str, range(80)))
    twice = S.repeated_spans(docs((1, same), (1, same), (2, same + " tail"))).collect()
    assert {(r.id, r.kept) for r in twice} == {(1, True), (2, False)} and len(twice) == 2
