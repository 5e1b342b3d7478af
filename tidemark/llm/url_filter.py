"""URL filters by a temporal list join.

List entries carry the day from which they hold.  The entries of a pattern in
order of their days become validity intervals, and each capture is held against
the entries that were active when it was fetched.  A pattern is a domain
(``d:example.org``, its subdomains too) or the start of a path
(``p:example.org/a/b``); of several active patterns the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_ROWS, cut, fresh, join_hot, table

#: Intervals that are broadcast at most (about 100 bytes each); beyond it patterns are exchanged, and only those asked for often broadcast.
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    """The host in lower case, without a user's name and a port; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^?#]*)", 1)


def url_patterns(url: Column) -> Column:
    """All patterns that can match the URL: its host, each parent domain of two labels or more, and each start of its path."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    m = F.size(parts)
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.concat(F.lit("p:"), host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (pattern, action, valid_from, valid_to) of ``entries`` (pattern, action, day); ``valid_to`` is null for the last.

    Of entries of one pattern and day the greatest action by name holds (remove
    before block before allow); entries with a null in any column are left out.
    """
    one = entries.dropna(subset=["pattern", "action", "day"]).groupBy("pattern", "day").agg(F.max("action").alias("action"))
    return one.select("pattern", "action", F.col("day").alias("valid_from"), F.lead("day").over(Window.partitionBy("pattern").orderBy("day")).alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """All rows and columns of ``captures`` plus ``decision`` (block, allow or none) and ``pattern`` (null for none).

    A null or unreadable URL and a null fetch day match nothing.  A decision depends on URL
    and day alone, so it is found once for each pair of them; columns named like the two
    that are added are replaced.  An empty list decides ``none`` everywhere.
    """
    captures = captures.drop("decision", "pattern")
    spans = cut(intervals(entries).filter(F.col("action") != "remove"))
    seen = table(captures.filter(F.col(url).isNotNull() & F.col(fetched).isNotNull()).groupBy(F.col(url).alias("url"), F.col(fetched).cast("long").alias("day")).agg(F.count("*").alias("times")))
    keys = seen.select("url", "day", F.explode(F.array_distinct(url_patterns(F.col("url")))).alias("key"))
    holds = (F.col("key") == F.col("pattern")) & (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    if spans.count() <= BROADCAST_ROWS:
        met = keys.join(F.broadcast(spans), holds)
    else:
        # A pattern has one interval for each of its days at most, so its intervals go as one row; only patterns that many captures ask for are broadcast.
        often = keys.groupBy("key").agg(F.count("*").alias("asked"))
        listed = spans.groupBy(F.col("pattern").alias("key")).agg(F.collect_list(F.struct("valid_from", "valid_to", "action")).alias("spans"))
        found = join_hot(keys, cut(listed.join(often, "key")), ["key"], F.col("asked") > HOT_ROWS)
        active = F.filter("spans", lambda s: (F.col("day") >= s["valid_from"]) & (s["valid_to"].isNull() | (F.col("day") < s["valid_to"])))
        met = found.select("url", "day", F.col("key").alias("pattern"), F.get(active, F.lit(0))["action"].alias("action")).filter(F.col("action").isNotNull())
    best = met.groupBy("url", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "action", "pattern")).alias("best"))
    k_url, k_day, decision, pattern, times = fresh(captures, "k_url", "k_day", "k_decision", "k_pattern", "k_times")
    side = seen.join(best, ["url", "day"]).select(F.col("url").alias(k_url), F.col("day").alias(k_day), F.col("best.action").alias(decision), F.col("best.pattern").alias(pattern), F.col("times").alias(times))
    keyed = captures.withColumns({k_url: F.col(url), k_day: F.col(fetched).cast("long")})
    out = join_hot(keyed, cut(side), [k_url, k_day], F.col(times) > HOT_ROWS, "left")
    return out.select(*captures.columns, F.coalesce(decision, F.lit("none")).alias("decision"), F.col(pattern).alias("pattern"))
