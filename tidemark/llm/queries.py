"""The queries of the text operators, as their contracts word them, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, exact_dedup, filter_audit, language, maxscore, mixing, packing, shards, simhash, substrings, syncmers, toxicity, url_filter

N_SHARDS = 40


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of three-word shingles; components of fingerprints at two bits or fewer."""
    out = simhash.fingerprint_groups(documents(spark, sf_dir), shingle=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each, next to its size, its source's size and target."""
    out = mixing.mix(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents, a row for each part: where, how long, whether it stays, and who has it first."""
    out = substrings.repeated_spans(documents(spark, sf_dir))
    return out.drop("doc").withColumnsRenamed({"id": "doc_id", "first_id": "first_doc_id"})


def _number(col: F.Column) -> F.Column:
    """A number from the MD5 of a string, the same in any engine."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: blocked hosts and parent domains, removals, returns, and paths that are allowed or blocked again."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("x", _number(F.col("host")))
    day = (F.col("x") % 200).cast("int")
    entry = lambda pattern, action, day: F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), day.cast("int").alias("day"))
    host, parent = F.concat(F.lit("d:"), F.col("host")), F.concat(F.lit("d:"), F.regexp_replace("host", r"^(blog|m|www)\.", ""))
    some = lambda test, e: F.when(test, e)
    entries = F.array(
        some(F.col("x") % 3 == 0, entry(host, "block", day)),
        some(F.col("x") % 6 == 0, entry(host, "remove", day + 60)),
        some(F.col("x") % 12 == 0, entry(host, "block", day + 120)),
        some(F.col("x") % 7 == 0, entry(parent, "block", day + 30)),
        some(F.col("x") % 5 == 0, entry(F.concat(F.lit("p:"), F.col("host"), F.lit("/en")), "allow", day + 10)),
        some(F.col("x") % 10 == 0, entry(F.concat(F.lit("p:"), F.col("host"), F.lit("/en")), "block", day + 90)),
    )
    return hosts.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*").distinct()


def op4_url_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with the decision of the list entries active when it was fetched."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", (_number(F.col("page_id").cast("string")) % 365).cast("int"))
    return url_filter.filter_urls(captures, url_list(pages))


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    # The checksum is taken before the exchange, which then carries no text.
    docs = documents(spark, sf_dir).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return shards.shard(docs, N_SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram and word-frequency scores of all documents; every seventh by hash is held out."""
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 7) == 2
    out = class_lm.score(documents(spark, sf_dir), ~held_out)
    return out.withColumnRenamed("id", "doc_id").withColumn("held_out", held_out)


def op7_merge_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    out = exact_dedup.exact_groups(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a network trained on the labels of two thirds of them."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3) == 1
    net = toxicity.fit(docs, labels, ~held_out)
    out = toxicity.score(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_best_fit_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The token pieces of all documents in sequences of 2,048 tokens."""
    pieces = packing.tokenize(documents(spark, sf_dir), tokenizer or default_tokenizer())
    digests = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, ["doc_id", "piece", "start", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits, and how like they are."""
    return syncmers.fingerprints_with_edits(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by a network trained on the languages of four fifths of them."""
    docs = documents(spark, sf_dir)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5) == 0
    net = language.fit(docs, ~held_out)
    return language.identify(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return maxscore.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove of each source, in all 120 orders, step by step."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(filter_audit.flagged(documents(spark, sf_dir), labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_bitsliced, op2_entropy_mix, op3_chunk_dedup, op4_url_asof, op5_histogram_shards, op6_class_bigrams, op7_merge_index_dedup, op8_bigru_toxicity, op9_best_fit_pack, op10_closed_syncmers, op11_byte_cnn_language, op12_maxscore_search, op13_filter_audit)
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_asof": r"""
        WITH p AS (SELECT page_id, url, CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 365 AS INTEGER) AS fetched,
                regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)', 1) AS host,
                regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^?#]*)', 1) AS path FROM pages),
        h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS x FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
        e AS (SELECT 'd:' || host AS pattern, 'block' AS action, x % 200 AS day FROM h WHERE x % 3 = 0
            UNION SELECT 'd:' || host, 'remove', x % 200 + 60 FROM h WHERE x % 6 = 0
            UNION SELECT 'd:' || host, 'block', x % 200 + 120 FROM h WHERE x % 12 = 0
            UNION SELECT 'd:' || regexp_replace(host, '^(blog|m|www)\.', ''), 'block', x % 200 + 30 FROM h WHERE x % 7 = 0
            UNION SELECT 'p:' || host || '/en', 'allow', x % 200 + 10 FROM h WHERE x % 5 = 0
            UNION SELECT 'p:' || host || '/en', 'block', x % 200 + 90 FROM h WHERE x % 10 = 0),
        one AS (SELECT pattern, day, max(action) AS action FROM e GROUP BY pattern, day),
        span AS (SELECT pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM one),
        met AS (SELECT p.page_id, s.action, s.pattern, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.pattern) DESC, s.action DESC, s.pattern DESC) AS rn
            FROM p JOIN span s ON s.action <> 'remove' AND p.fetched >= s.valid_from AND (s.valid_to IS NULL OR p.fetched < s.valid_to)
            AND ((starts_with(s.pattern, 'd:') AND ('d:' || p.host = s.pattern OR ends_with(p.host, '.' || substr(s.pattern, 3)))) OR (starts_with(s.pattern, 'p:') AND ('p:' || p.host || '/' || p.path = s.pattern OR starts_with('p:' || p.host || '/' || p.path, s.pattern || '/')))))
        SELECT p.page_id, p.url, p.fetched, coalesce(m.action, 'none') AS decision, m.pattern FROM p LEFT JOIN met m ON m.page_id = p.page_id AND m.rn = 1""",
    "op7_merge_index_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    "op12_maxscore_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term, CAST(len(terms) AS BIGINT) AS n FROM d) GROUP BY doc_id, term, n),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        part AS (SELECT doc_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS adds FROM tf JOIN df USING (term), whole),
        scored AS (SELECT item_id, doc_id, CAST(sum(adds) AS BIGINT) AS score FROM q JOIN part USING (term) GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > first_id THEN 'E' ELSE '' END AS fails
            FROM t LEFT JOIN l USING (doc_id)),
        cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM x a, x b, x d, x e, x g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
        steps AS (SELECT o AS filter_order, s AS step, o[s] AS c, o[:s - 1] AS earlier FROM orders, unnest([1, 2, 3, 4, 5]) AS u(s)),
        run AS (SELECT part, filter_order, step, c, contains(fails, c) AS bad, earlier <> '' AND regexp_matches(fails, '[' || earlier || '_]') AS gone, fails = c AS only_this, n, good, toxic FROM cells, steps),
        out AS (SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant, coalesce(sum(n) FILTER (only_this), 0) AS unique_fails,
                coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS toxic_lost FROM run GROUP BY part, filter_order, step, c)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
            CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM out""",
}
