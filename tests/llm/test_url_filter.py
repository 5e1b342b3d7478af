import random

from pyspark.sql import functions as F

from tidemark.llm import url_filter

ENTRIES = "pattern string, action string, day int"


def brute(url, day, entries):
    import re

    m = re.match(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)(?::\d+)?/?([^?#]*)", url or "", re.I)
    if not m or day is None:
        return "none", None
    host, path = m[1].lower(), [p for p in m[2].split("/") if p]
    found = []
    for p in {e[0] for e in entries}:
        fits = p[:2] == "d:" and (host == p[2:] or host.endswith("." + p[2:])) or p[:2] == "p:" and any(p[2:] == host + "/" + "/".join(path[:i]) for i in range(1, len(path) + 1))
        active = max(((d, a) for q, a, d in entries if q == p and d <= day), default=None)
        if fits and active and active[1] != "remove":
            found.append((len(p), active[1], p))
    return max(found)[1:] if found else ("none", None)


def test_decisions_equal_brute_force(spark, monkeypatch):
    random.seed(1)
    hosts = ["a.org", "x.a.org", "y.x.a.org", "b.net", "c.b.net"]
    entries = [(random.choice([f"d:{h}", f"p:{h}/en", f"p:{h}/en/q"]), random.choice(["block", "allow", "remove"]), random.randrange(20)) for h in hosts for _ in range(8)]
    urls = [f"{random.choice(['http', 'HTTPS'])}://{h}{p}" for h in hosts for p in ("", "/", "/en", "/en/q?x#y", "/en//q/z", "/fr?u=/en")] + [None, "", "junk", "http://A.org:80/en", "http://b.net:pw@a.org/en", "http://a.org@b.net:8080", "http://" + "x" * 50_000 + ".a.org/en"]
    rows = [(i, random.choice(urls), random.choice([None, *range(22)])) for i in range(400)]
    want = {i: brute(u, d, entries) for i, u, d in rows}
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched int").withColumns({"key": F.lit(1), "salt": F.lit(2), "found": F.lit(3), "decision": F.lit("old")})
    table = spark.createDataFrame([*entries, (None, "block", 1), ("d:a.org", None, 1)], ENTRIES)
    for limit, hot in ((url_filter.BROADCAST_ROWS, url_filter.HOT_ROWS), (0, 2)):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(url_filter, "HOT_ROWS", hot)
        out = url_filter.filter_urls(captures, table)
        assert {r.page_id: (r.decision, r.pattern) for r in out.collect()} == want
    # Rows that share an id are judged each by its own URL and day.
    shared = url_filter.filter_urls(captures.withColumn("page_id", F.lit(1)), table)
    assert sorted((r.url or "", -1 if r.fetched is None else r.fetched, r.decision) for r in shared.collect()) == sorted((u or "", -1 if d is None else d, want[i][0]) for i, u, d in rows)
    assert url_filter.filter_urls(captures.limit(0), table).count() == 0
    assert {r.decision for r in url_filter.filter_urls(captures, table.limit(0)).collect()} == {"none"}
