"""Queries over the corpus tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.segment import Policy, groups
from ..operators import derive, diff, evaluate, fuse, grams, lexical, notes, present, stats, vector
from ..operators.chunk import chunk
from ..sources import io
from ..streaming import edits
from . import mapping as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = "the thing of another"
TERMS = ("the", "thing", "of", "another")
K = 20

# SQL: texts to search, chunks and scores, put before a query that needs them.
TRIM = r"regexp_replace({}, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"
_T = TRIM.format("text")
TEXTS = f"""texts AS (SELECT 'n' || doc_id AS note_id, 'b' || doc_id AS block_id,
    CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'transcript' WHEN 2 THEN 'ocr' WHEN 3 THEN 'extracted' ELSE 'link' END AS source,
    CASE WHEN doc_id % 5 = 4 THEN source || ' — ' || {_T} || ' — https://example.org/' || doc_id ELSE {_T} END AS text,
    sha256('v2|' || CASE doc_id % 5 WHEN 0 THEN 'text|' || {_T} WHEN 1 THEN 'audio|ref=aud' || doc_id || '|transcript=' || {_T} WHEN 2 THEN 'image|ref=img' || doc_id || '|caption=' || {_T}
        WHEN 3 THEN 'file|name=f' || doc_id || '.txt|type=' || lang || '|text=' || {_T} || '|unavail=false' ELSE 'link|url=https://example.org/' || doc_id || '|title=' || source || '|desc=' || {_T} END) AS content_hash FROM documents)"""
CHUNKS = TEXTS + r""", walk AS (
    SELECT note_id, block_id, source, text, content_hash, length(text) AS n, 0 AS s, 0 AS e, 0 AS step FROM texts WHERE length(text) > 0
    UNION ALL
    SELECT note_id, block_id, source, text, content_hash, n, s2, CASE WHEN n > 240 AND s2 + 240 < n AND cut > 0 THEN tail_from + cut ELSE least(s2 + 240, n) END, step + 1 FROM (
        SELECT *, length(regexp_extract(substr(text, tail_from + 1, least(s2 + 240, n) - tail_from), '(?s)^(.*[.!?;\n。！？；…])', 1)) AS cut FROM (
            SELECT *, greatest(least(s2 + 240, n) - 59, s2 + 1) AS tail_from FROM (
                SELECT *, CASE WHEN step = 0 THEN 0 ELSE greatest(s + 1, e - 40) END AS s2 FROM walk WHERE step = 0 OR e < n)))),
    pieces AS (SELECT *, """ + TRIM.format("substr(text, s + 1, e - s)") + r""" AS t FROM walk WHERE step > 0),
    chunks AS (SELECT note_id || '/' || block_id || '/' || (row_number() OVER (PARTITION BY block_id ORDER BY step) - 1) AS chunk_id, note_id, block_id, source,
        row_number() OVER (PARTITION BY block_id ORDER BY step) - 1 AS chunk_index, t AS text, s AS char_start, e AS char_end, content_hash, strip_accents(lower(t)) AS hay FROM pieces WHERE t <> '')"""


def _tf(t: str) -> str:
    return f"((length(hay) - length(replace(hay, '{t}', ''))) // {len(t)})"


WEIGHT = "CASE source WHEN 'text' THEN 1.0::DOUBLE WHEN 'transcript' THEN 0.95::DOUBLE WHEN 'ocr' THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END"
SCORE = "(0.0::DOUBLE + " + " + ".join(f"least({_tf(t)}, 3)::DOUBLE / sqrt(greatest(1, length(text))::DOUBLE)" for t in TERMS) + f") * 1.0::DOUBLE * {WEIGHT}"
MATCH = "(" + " + ".join(f"(contains(hay, '{t}'))::INT" for t in TERMS) + ") >= 2"
KEYWORD = CHUNKS + f", keyword AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, {SCORE} AS score FROM chunks WHERE {MATCH}))"
NEIGHBOURS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
    near AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id AS id, v.label AS label, list_cosine_similarity(v.e, q.e) AS similarity FROM v, v AS q WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM near)"""
CASES = r"""held AS (SELECT item_id, list('n' || doc_id ORDER BY 'n' || doc_id) AS expected FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY item_id),
    cases AS (SELECT CAST(b.item_id AS VARCHAR) AS case_id, array_to_string(list_slice(regexp_split_to_array(b.text, '\s+'), 1, 5), ' ') AS query, coalesce(expected, []) AS expected,
        CASE WHEN b.item_id % 4 = 0 THEN 'cross_language' ELSE 'in_scope' END AS scope, CASE WHEN b.item_id % 3 = 0 THEN 'regression' ELSE 'golden' END AS origin, b.text AS item FROM benchmark b LEFT JOIN held USING (item_id))"""
# Retrieval over whole blocks, a query's terms folded and told apart, half of them needed if there are more than two.
RESULTS = TEXTS + ", " + CASES + r""", terms AS (SELECT DISTINCT case_id, term FROM (SELECT case_id, unnest(string_split(strip_accents(lower(query)), ' ')) AS term FROM cases) WHERE term <> ''),
    need AS (SELECT case_id, count(*) AS n, CASE WHEN count(*) > 2 THEN ceil(count(*) / 2.0) ELSE count(*) END AS least FROM terms GROUP BY case_id),
    hays AS (SELECT *, strip_accents(lower(text)) AS hay FROM texts WHERE length(text) > 0),
    hit AS (SELECT case_id, note_id, count(*) AS m, sum(least((length(hay) - length(replace(hay, term, ''))) // length(term), 3)) AS tf, any_value(length(text)) AS len, any_value(source) AS source FROM hays JOIN terms ON contains(hay, term) GROUP BY case_id, note_id),
    results AS (SELECT case_id, note_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, note_id) AS rank FROM (
        SELECT case_id, note_id, round(tf / sqrt(len::DOUBLE) * """ + WEIGHT + r""", 9) AS score FROM hit JOIN need USING (case_id) WHERE m >= least) QUALIFY rank <= 5),
    returned AS (SELECT case_id, list(note_id ORDER BY rank) AS returned FROM results GROUP BY case_id),
    outcomes AS (SELECT case_id, scope, origin, len(expected) > 0 AS is_positive, len(expected) AS expected_count, r.returned IS NULL AS returned_none,
        len(expected) > 0 AND list_has_all(coalesce(list_slice(returned, 1, 1), []), expected) AS hit_at1, len(expected) > 0 AND list_has_all(coalesce(list_slice(returned, 1, 3), []), expected) AS hit_at3,
        len(expected) > 0 AND list_has_all(coalesce(list_slice(returned, 1, 5), []), expected) AS hit_at5,
        coalesce((SELECT max(1.0::DOUBLE / x.rank) FROM results x WHERE x.case_id = cases.case_id AND list_contains(cases.expected, x.note_id)), 0.0) AS reciprocal_rank
        FROM cases LEFT JOIN returned r USING (case_id))"""
METRICS = """count(*) AS cases, count(*) FILTER (is_positive) AS positives, count(*) FILTER (NOT is_positive) AS negatives,
    round(coalesce(avg(hit_at1::INT) FILTER (is_positive AND expected_count <= 1), 0), 6) AS recall_at1, round(coalesce(avg(hit_at3::INT) FILTER (is_positive AND expected_count <= 3), 0), 6) AS recall_at3,
    round(coalesce(avg(hit_at5::INT) FILTER (is_positive AND expected_count <= 5), 0), 6) AS recall_at5, round(coalesce(avg(reciprocal_rank) FILTER (is_positive), 0), 6) AS mrr,
    round(coalesce(avg(returned_none::INT) FILTER (NOT is_positive), 0), 6) AS no_result_accuracy,
    round(CASE WHEN count(*) FILTER (NOT is_positive) = 0 THEN 0.0 ELSE 1 - coalesce(avg(returned_none::INT) FILTER (NOT is_positive), 0) END, 6) AS false_positive_rate"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return M.read(spark, sf, "documents")


# Scalar functions


@query("SELECT doc_id, strip_accents(lower(text)) AS folded, length(text) AS n FROM documents")
def text_fold(spark, sf):
    return _docs(spark, sf).select("doc_id", T.haystack(F.col("text")).alias("folded"), F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(regexp_split_to_array({TRIM.format('strip_accents(lower(text))')}, '[ \\t\\n\\v\\f\\r]+')) AS t) WHERE t <> '') AS n_tokens FROM documents")
def text_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {TEXTS} SELECT note_id, block_id, source, sha256(text) AS text_hash FROM texts WHERE text <> ''")
def retrievable_text(spark, sf):
    return M.texts(M.document_blocks(spark, sf)).select("note_id", "block_id", "source", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {TEXTS} SELECT block_id, content_hash FROM texts")
def content_hash(spark, sf):
    b = M.document_blocks(spark, sf)
    return b.select("block_id", T.content_hash({c: F.col(c) for c in b.columns}).alias("content_hash"))


_CT = "regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')"
_CB = f"""SELECT 'c' || conv_id AS note_id, 't-' || conv_id || '-' || turn AS block_id, turn AS ord, CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'audio' ELSE 'file' END AS kind, {_CT} AS t, text AS raw FROM conversations"""
_CHASH = "sha256('v2|' || CASE kind WHEN 'text' THEN 'text|' || t WHEN 'audio' THEN 'audio|ref=' || block_id || '|transcript=' || t ELSE 'file|name=system.txt|type=txt|text=' || t || '|unavail=false' END)"


@query(f"WITH b AS ({_CB}) SELECT note_id, sha256('v2|card|title=' || note_id || '|' || string_agg(block_id || ':' || {_CHASH}, '|' ORDER BY ord)) AS card_hash FROM b GROUP BY note_id")
def card_hash(spark, sf):
    b = M.conversation_blocks(spark, sf)
    part = F.concat_ws(":", "block_id", T.content_hash({c: F.col(c) for c in b.columns}))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), "|")
    return b.groupBy("note_id").agg(F.sha2(F.concat(F.lit("v2|card|title="), F.first("note_id"), F.lit("|"), body), 256).alias("card_hash"))


_LINE = r"regexp_replace(regexp_replace({}, '^\s{{0,3}}#{{1,6}}\s+', ''), '^\s*([-*+]\s+|\d+[.)]\s+)', '')"
for _p, _r in ((r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"\*\*(.+?)\*\*|__(.+?)__", r"\1\2"), (r"\*(.+?)\*|_(.+?)_", r"\1\2"), ("`([^`]+)`", r"\1"), ("~~(.+?)~~", r"\1")):
    _LINE = "regexp_replace(" + _LINE + f", '{_p.replace('{', '{{').replace('}', '}}')}', '{_r}', 'g')"
_MD = r"""l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    WHERE NOT regexp_matches(regexp_replace(line, '^[ \t]+|[ \t]+$', '', 'g'), '^(-{3,}|\*{3,}|_{3,})$')),
    md AS (SELECT doc_id, """ + TRIM.format("regexp_replace(string_agg(" + _LINE.format("line") + r", chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g')") + " AS plain FROM l GROUP BY doc_id)"


@query(f"WITH {_MD} SELECT doc_id, sha256(plain) AS plain_hash, length(plain) AS n FROM md")
def markdown_plain(spark, sf):
    plain = T.markdown_plain(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.sha2(plain, 256).alias("plain_hash"), F.length(plain).cast("long").alias("n"))


_FORMATTED = r"^\s{0,3}#{1,6}\s+|^\s*([-*+]\s+|\d+[.)]\s+)|(\*\*|__).+?(\*\*|__)|\*([^*\s]|[^*\s][^*\n]*[^*\s])\*|\[[^\]]+\]\([^)]*\)"


@query(rf"""SELECT doc_id, bool_or(regexp_matches(line, '{_FORMATTED}') OR regexp_matches(regexp_replace(line, '^[ \t]+|[ \t]+$', '', 'g'), '^(-{{3,}}|\*{{3,}}|_{{3,}})$')) AS formatted
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def has_formatting(spark, sf):
    return _docs(spark, sf).select("doc_id", T.has_formatting(F.col("text")).alias("formatted"))


@query(r"""SELECT lang, bool_or(regexp_matches(text, '[㐀-䶿一-鿿豈-﫿]')) AS has_han, bool_or(regexp_matches(text, '[A-Za-zÀ-ɏ]')) AS has_latin FROM documents GROUP BY lang""")
def script_detect(spark, sf):
    return _docs(spark, sf).groupBy("lang").agg(F.bool_or(T.has_han(F.col("text"))).alias("has_han"), F.bool_or(T.has_latin(F.col("text"))).alias("has_latin"))


@query(r"""SELECT word, length(m) > 0 AND length(m) >= CASE WHEN (length(m) - length(regexp_replace(m, '[㐀-䶿一-鿿豈-﫿぀-ヿ]', '', 'g'))) * 2 > length(m) THEN 2 ELSE 3 END AS runs
    FROM (SELECT DISTINCT word, word AS m FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\v\f\r]+')) AS word FROM documents))""")
def semantic_gate(spark, sf):
    """Every different word of the corpus as a query."""
    words = _docs(spark, sf).select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return words.select("word", T.runs_semantic(F.col("word")).alias("runs"))


@query(f"WITH b AS ({_CB}) SELECT block_id, CASE kind WHEN 'text' THEN clip WHEN 'audio' THEN CASE WHEN clip = '' THEN '录音' ELSE '录音:' || clip END ELSE '文档:system.txt' END AS brief, CASE WHEN kind = 'text' THEN length(t) ELSE 0 END AS text_length FROM (SELECT *, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '…' ELSE t END AS clip FROM b)")
def block_descriptor(spark, sf):
    b = M.conversation_blocks(spark, sf)
    c = {x: F.col(x) for x in b.columns}
    return b.select("block_id", T.brief(c).alias("brief"), F.when(F.col("kind") == "text", F.length(T.trim(F.col("text")))).otherwise(0).cast("long").alias("text_length"))


# Chunks


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, source, chunk_index, sha256(text) AS text_hash, char_start, char_end, content_hash FROM chunks")
def chunk_fixed(spark, sf):
    c = chunk(M.texts(M.document_blocks(spark, sf)))
    return c.select("chunk_id", "source", "chunk_index", F.sha2("text", 256).alias("text_hash"), "char_start", "char_end", "content_hash")


@query(f"WITH {TEXTS} SELECT note_id || '/' || block_id || '/0' AS chunk_id, sha256(text) AS text_hash, length(text) AS char_end FROM texts WHERE text <> ''")
def chunk_block(spark, sf):
    return chunk(M.texts(M.document_blocks(spark, sf)), "block").select("chunk_id", F.sha2("text", 256).alias("text_hash"), F.col("char_end").cast("long").alias("char_end"))


# Keyword search


@query(f"WITH RECURSIVE {KEYWORD} SELECT rank, chunk_id, source, round(score, 9) AS score FROM keyword WHERE rank <= {K}")
def keyword_topk(spark, sf):
    return lexical.keyword_search(M.corpus(spark, sf), QUERY, K).select("rank", "chunk_id", "source", F.round("score", 9).alias("score"))


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, {', '.join(f'{_tf(t)} AS tf_{t}' for t in TERMS)} FROM chunks WHERE {MATCH}")
def term_frequency(spark, sf):
    c = M.corpus(spark, sf).filter(lexical.matches(F.col("hay"), groups(QUERY)))
    return c.select("chunk_id", *[lexical.term_frequency(F.col("hay"), t).cast("long").alias(f"tf_{t}") for t in TERMS])


@query(f"WITH RECURSIVE {CHUNKS}, t AS (SELECT unnest(['chi', 'ungein', 'verlich']) AS term), m AS (SELECT chunk_id, any_value(source) AS source, any_value(length(text)) AS n, count(*) AS met, sum(least((length(hay) - length(replace(hay, term, ''))) // length(term), 3)) AS tf FROM chunks JOIN t ON contains(hay, term) GROUP BY chunk_id HAVING count(*) >= 2) "
       f"SELECT chunk_id, row_number() OVER (ORDER BY tf / sqrt(n::DOUBLE) * {WEIGHT} DESC, chunk_id) AS rank, round(tf / sqrt(n::DOUBLE) * {WEIGHT}, 9) AS score FROM m QUALIFY rank <= {K}")
def indexed_search(spark, sf):
    """A query of rarer terms, which reads only the chunks that the index names."""
    c = M.chunk_table(spark, sf)
    return grams.indexed_search(c.load(), c.index(), "chi ungein verlich", K, summed=True).select("chunk_id", "rank", F.round("score", 9).alias("score"))


@query(f"WITH {RESULTS} SELECT case_id, note_id, rank FROM results")
def keyword_batch(spark, sf):
    return _case_results(spark, sf)


def _case_results(spark, sf):
    """The five best notes of each case over whole blocks; scores are rounded before ranking, so that any engine breaks ties alike."""
    c = M.chunk_table(spark, sf, "block")
    asked = M.cases(spark, sf).select(F.col("case_id").alias("query_id"), "query")
    found = grams.indexed_batch(c.load(), c.index(), asked, 5, digits=9)
    return io.kept(found.select(F.col("query_id").alias("case_id"), "note_id", "rank"))


# Han queries: letters become Han characters, by place in the alphabet, in texts and queries alike.
_LETTERS, _HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + 37 * i) for i in range(26))
# Of a run of Han characters all pairs, in order and once each; other words are Latin terms.  A query of both needs one pair of each run.
HAN_RESULTS = rf"""docs AS (SELECT doc_id, 'n' || doc_id || '/b/0' AS chunk_id, translate(lower(text), '{_LETTERS}', '{_HAN}') AS text FROM documents),
    hays AS (SELECT doc_id, chunk_id, strip_accents(text) AS hay, length(text) AS len FROM docs WHERE text <> ''),
    queries AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN q || ' src' ELSE q END AS query FROM (SELECT item_id, translate(lower(array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 2, 3), ' ')), '{_LETTERS}', '{_HAN}') AS q FROM benchmark)),
    tokens AS (SELECT query_id, unnest(string_split(query, ' ')) AS token, generate_subscripts(string_split(query, ' '), 1) AS t FROM queries),
    runs AS (SELECT query_id, t, unnest(regexp_extract_all(token, '[一-鿿]+|[^一-鿿]+')) AS run, generate_subscripts(regexp_extract_all(token, '[一-鿿]+|[^一-鿿]+'), 1) AS r FROM tokens WHERE token <> ''),
    latin AS (SELECT DISTINCT query_id, strip_accents(run) AS term FROM runs WHERE NOT regexp_matches(run, '^[一-鿿]')),
    pairs AS (SELECT DISTINCT query_id, t, r, substr(run, i::INT, 2) AS term FROM (SELECT query_id, t, r, run, unnest(generate_series(1, length(run) - 1)) AS i FROM runs WHERE regexp_matches(run, '^[一-鿿]') AND length(run) >= 2)),
    terms AS (SELECT query_id, t * 1000 + r AS g, true AS is_pair, term FROM pairs UNION ALL SELECT query_id, -1, false, term FROM latin),
    sizes AS (SELECT query_id, g, is_pair, count(*) AS n, CASE WHEN NOT is_pair THEN CASE WHEN count(*) > 2 THEN ceil(0.5 * count(*)) ELSE count(*) END
        WHEN query_id IN (SELECT query_id FROM latin) THEN 1 ELSE least(greatest(3, ceil(0.15::DOUBLE * count(*))), count(*)) END AS need FROM terms GROUP BY query_id, g, is_pair),
    hit AS (SELECT terms.query_id, g, doc_id, chunk_id, any_value(len) AS len, count(*) AS m, sum(least((length(hay) - length(replace(hay, term, ''))) // length(term), 3)) AS tf FROM hays JOIN terms ON contains(hay, term) GROUP BY terms.query_id, g, doc_id, chunk_id),
    whole AS (SELECT query_id, doc_id, any_value(chunk_id) AS chunk_id, count(*) AS met, sum(tf) AS tf, any_value(len) AS len, coalesce(avg(m::DOUBLE / n) FILTER (is_pair), 1.0) AS coverage FROM hit JOIN sizes USING (query_id, g) WHERE m >= need GROUP BY query_id, doc_id),
    scored AS (SELECT query_id, doc_id, chunk_id, coverage, round(tf / sqrt(len::DOUBLE) * coverage, 9) AS score FROM whole WHERE met = (SELECT count(*) FROM sizes s WHERE s.query_id = whole.query_id)),
    han AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""


def _han_parts(spark, sf):
    """(chunks, queries) with Han characters."""
    han = lambda c: F.translate(F.lower(c), _LETTERS, _HAN)
    note = F.concat(F.lit("n"), F.col("doc_id").cast("string"))
    c = _docs(spark, sf).select(F.concat(note, F.lit("/b/0")).alias("chunk_id"), note.alias("note_id"), F.lit("text").alias("source"), han(F.col("text")).alias("text"))
    words = han(F.array_join(F.slice(F.split("text", r"\s+"), 2, 2), " "))
    q = M.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, F.concat(words, F.lit(" src"))).otherwise(words).alias("query"))
    return c, q


@query(f"WITH {HAN_RESULTS} SELECT query_id, 'n' || doc_id AS note_id, rank, round(score, 6) AS score FROM han WHERE rank <= 10")
def keyword_batch_han(spark, sf):
    c, q = _han_parts(spark, sf)
    return grams.keyword_batch(c, q, 10, digits=9, keep=("note_id",)).select("query_id", "note_id", "rank", F.round("score", 6).alias("score"))


@query(rf"WITH {HAN_RESULTS} SELECT query_id, g = -1 AS latin, n AS terms, need::BIGINT AS min_matched FROM sizes")
def query_groups(spark, sf):
    """How the queries with Han characters fall into groups of terms, and how many of each must match."""
    words = F.translate(F.lower(F.array_join(F.slice(F.split("text", r"\s+"), 2, 2), " ")), _LETTERS, _HAN)
    q = M.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, F.concat(words, F.lit(" src"))).otherwise(words).alias("query"))
    return lexical.query_groups(q).select("query_id", (~F.col("is_bigram")).alias("latin"), F.size("terms").cast("long").alias("terms"), F.col("min_matched").cast("long").alias("min_matched"))


@query("SELECT doc_id, (contains(h, 'src1'))::INT + (contains(h, 'en'))::INT >= 2 AS matches FROM (SELECT doc_id, strip_accents(lower(source || ' ' || lang)) AS h FROM documents)")
def title_tag_match(spark, sf):
    hay = T.haystack(F.concat_ws(" ", "source", "lang"))
    return _docs(spark, sf).select("doc_id", lexical.matches(hay, groups("src1 en")).alias("matches"))


@query("SELECT doc_id FROM documents WHERE source = 'src4' AND doc_id % 2 = 0 AND lower(lang) = 'en'")
def scope_filter(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.col("source").alias("folder"), (F.col("doc_id") % 2 == 0).alias("is_pinned"), F.array(F.upper("lang")).alias("tags"))
    return d.filter(notes.in_scope("src4", True, ("en",))).select("doc_id")


@query(r"""WITH h AS (SELECT doc_id, strip_accents(lower(text)) AS hay FROM documents), v AS (SELECT unnest(['th', 'he']) AS t),
    p AS (SELECT doc_id, t, unnest(string_split(hay, t)) AS part, generate_subscripts(string_split(hay, t), 1) AS i FROM h, v),
    o AS (SELECT doc_id, t, i, sum(length(part)) OVER (PARTITION BY doc_id, t ORDER BY i) + (i - 1) * 2 AS s, count(*) OVER (PARTITION BY doc_id, t) AS n FROM p),
    m AS (SELECT DISTINCT doc_id, s, s + 2 AS e FROM o WHERE i < n),
    w AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w)
    SELECT doc_id, min(s)::BIGINT AS range_start, max(e)::BIGINT AS range_end FROM g GROUP BY doc_id, island""")
def match_ranges(spark, sf):
    r = _docs(spark, sf).select("doc_id", F.explode(lexical.match_ranges(T.haystack(F.col("text")), ["th", "he"])).alias("r"))
    return r.select("doc_id", F.col("r.s").cast("long").alias("range_start"), F.col("r.e").cast("long").alias("range_end"))


# Vectors and fusion


@query(f"WITH {NEIGHBOURS} SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10")
def vector_topk(spark, sf):
    return _near(spark, sf, 10).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


def _near(spark, sf, k):
    v = M.vectors(spark, sf)
    return vector.nearest(v.select("id", "vector"), M.vector_queries(spark, sf), k, digits=9)


@query(f"WITH {NEIGHBOURS} SELECT query_label, count(*) AS pairs, round(avg((label = query_label)::INT), 6) AS precision_at10 FROM ranked WHERE rank <= 10 GROUP BY query_label")
def vector_label_precision(spark, sf):
    q = M.vector_queries(spark, sf).select("query_id", "query_label")
    found = _near(spark, sf, 10).join(M.vectors(spark, sf).select("id", "label"), "id").join(F.broadcast(q), "query_id")
    return found.groupBy("query_label").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("int")), 6).alias("precision_at10"))


# Hybrid search: of each vector whose id is divisible by 20, its neighbours among all vectors, and the notes found by the first five words of the document of that id.
_WORDS5 = r"array_to_string(list_slice(regexp_split_to_array(" + _T + r", '[ \t\n\v\f\r]+'), 1, 5), ' ')"
ARMS = TEXTS + f""", asked AS (SELECT vec_id AS query_id, {_WORDS5} AS query FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0),
    terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(string_split(strip_accents(lower(query)), ' ')) AS term FROM asked) WHERE term <> ''),
    need AS (SELECT query_id, CASE WHEN count(*) > 2 THEN ceil(count(*) / 2.0) ELSE count(*) END AS least FROM terms GROUP BY query_id),
    hays AS (SELECT *, strip_accents(lower(text)) AS hay FROM texts WHERE length(text) > 0),
    hit AS (SELECT query_id, note_id, count(*) AS m, sum(least((length(hay) - length(replace(hay, term, ''))) // length(term), 3)) AS tf, any_value(length(text)) AS len, any_value(source) AS source FROM hays JOIN terms ON contains(hay, term) GROUP BY query_id, note_id),
    kw AS (SELECT query_id, note_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(tf / sqrt(len::DOUBLE) * {WEIGHT}, 9) DESC, note_id) AS keyword_rank FROM hit JOIN need USING (query_id) WHERE m >= least QUALIFY keyword_rank <= 60),
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    vec AS (SELECT q.vec_id AS query_id, 'n' || v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, v.vec_id) AS vector_rank FROM v, v AS q WHERE q.vec_id % 20 = 0 QUALIFY vector_rank <= 60),
    both_arms AS (SELECT query_id, id, keyword_rank, vector_rank FROM kw FULL JOIN vec USING (query_id, id))"""


def _arms(spark, sf):
    """(query_id, id, keyword_rank) and (query_id, id, vector_rank).  The keyword arm is one scan of whole blocks, of which each note has one, so its id stands for its block's."""
    n = fuse.candidates(K)
    words = F.array_join(F.slice(F.split(T.trim(F.col("text")), r"\s+", 6), 1, 5), " ")
    ids = M.vectors(spark, sf).filter("id % 20 = 0").select(F.col("id").alias("query_id"))
    asked = _docs(spark, sf).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), words.alias("query")).join(ids, "query_id")
    blocks = M.document_blocks(spark, sf)
    found = T.retrievable({c: F.col(c) for c in blocks.columns})  # null without text, which no term is in; a filter would make all texts twice
    blocks = blocks.select(F.col("note_id").alias("chunk_id"), found.alias("r")).select("chunk_id", "r.source", "r.text")
    keyword = grams.keyword_batch(blocks, asked, n, digits=9, keep=()).select("query_id", F.col("chunk_id").alias("id"), F.col("rank").alias("keyword_rank"))
    near = _near(spark, sf, n).select("query_id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.col("rank").alias("vector_rank"))
    return io.kept(keyword), io.kept(near)


_RRF = "round(coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 9)"
_WEIGHTED = "round(coalesce(0.7::DOUBLE / keyword_rank, 0) + coalesce(0.3::DOUBLE / vector_rank, 0), 9)"
_BY = ["query_id"]


def _fused(spark, sf, method):
    kw, near = _arms(spark, sf)
    return fuse.fuse(kw, near, F.round(method(F.col("keyword_rank"), F.col("vector_rank")), 9), _BY)


def _fuse_sql(score: str) -> str:
    return f"WITH {ARMS} SELECT query_id, id, keyword_rank, vector_rank, {score} AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS fused_rank FROM both_arms"


@query(_fuse_sql(_RRF))
def fuse_rrf(spark, sf):
    return _fused(spark, sf, fuse.rrf)


@query(_fuse_sql(_WEIGHTED))
def fuse_weighted(spark, sf):
    return _fused(spark, sf, fuse.weighted)


@query(f"WITH {ARMS}, f AS (SELECT query_id, {_WEIGHTED} AS s, id, CASE WHEN keyword_rank IS NULL THEN 'vector_only' WHEN vector_rank IS NULL THEN 'keyword_only' ELSE 'both' END AS arm FROM both_arms) SELECT query_id, arm, count(*) AS n FROM (SELECT query_id, arm, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM f) WHERE r <= {K} GROUP BY query_id, arm")
def hybrid_unique_hits(spark, sf):
    f = _fused(spark, sf, fuse.weighted).filter(F.col("fused_rank") <= K)
    return f.groupBy("query_id", fuse.arm(F.col("keyword_rank"), F.col("vector_rank")).alias("arm")).agg(F.count("*").alias("n"))


@query(f"WITH {ARMS}, f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {_WEIGHTED} DESC, id) AS fused_rank FROM both_arms) SELECT query_id, id, fused_rank, final_rank FROM (SELECT query_id, id, fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS final_rank FROM f WHERE id IN (SELECT 'n' || doc_id FROM documents WHERE lang <> 'fr')) WHERE final_rank <= {K}")
def live_topk(spark, sf):
    """French notes were deleted: they use up candidates, but no results."""
    live = _docs(spark, sf).filter("lang <> 'fr'").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"))
    return fuse.live_top(_fused(spark, sf, fuse.weighted), live, K, _BY).select("query_id", "id", "fused_rank", "final_rank")


@query(f"WITH {ARMS} SELECT query_id, count(DISTINCT id) AS candidates FROM both_arms GROUP BY query_id")
def candidate_counts(spark, sf):
    return fuse.candidate_count(*_arms(spark, sf), _BY)


def _mode_sql(mode: str, rank: str) -> str:
    return f"SELECT '{mode}' AS mode, query_id, id, round(1.0::DOUBLE / {rank}, 9) AS score FROM both_arms WHERE {rank} <= {K}"


@query(f"WITH {ARMS} {_mode_sql('keyword', 'keyword_rank')} UNION ALL {_mode_sql('vector', 'vector_rank')}")
def single_mode_ranks(spark, sf):
    parts = [df.filter(F.col(f"{m}_rank") <= K).select(F.lit(m).alias("mode"), "query_id", "id", F.round(fuse.by_mode(m, F.col(f"{m}_rank"), F.col(f"{m}_rank")), 9).alias("score")) for m, df in zip(("keyword", "vector"), _arms(spark, sf), strict=True)]
    return parts[0].unionByName(parts[1])


_SWEEP = [("rrf", k, 0.0, 0.0) for k in (1, 5, 10, 30, 60, 100, 200)] + [("weighted", 0, w, round(1 - w, 1)) for w in (0.5, 0.6, 0.7, 0.8, 0.9)]
_SWEEP_SQL = ", ".join(f"('{m}', {k}, {a}::DOUBLE, {b}::DOUBLE)" for m, k, a, b in _SWEEP)


@query(f"""WITH {ARMS}, p(method, k, a, b) AS (VALUES {_SWEEP_SQL}), f AS (SELECT method, k, a, query_id, id, row_number() OVER (PARTITION BY method, k, a, query_id ORDER BY round(CASE method WHEN 'rrf'
    THEN coalesce(1.0::DOUBLE / (k + keyword_rank), 0) + coalesce(1.0::DOUBLE / (k + vector_rank), 0) ELSE coalesce(a / keyword_rank, 0) + coalesce(b / vector_rank, 0) END, 9) DESC, id) AS r FROM both_arms, p)
    SELECT method, k, a AS keyword_weight, sum(CASE WHEN id = 'n' || query_id THEN 1.0::DOUBLE / r ELSE 0 END) / count(DISTINCT query_id) AS mrr, count(*) AS n FROM f WHERE r <= {K} GROUP BY method, k, a""")
def fusion_sweep(spark, sf):
    """Both methods over their parameters in one job; the mean reciprocal rank of the note that each query is taken from."""
    kw, near = _arms(spark, sf)
    params = spark.createDataFrame(_SWEEP, "method string, k int, a double, b double")  # a dozen rows
    ranks = F.col("keyword_rank"), F.col("vector_rank")
    score = F.when(F.col("method") == "rrf", fuse.rrf(*ranks, F.col("k"))).otherwise(fuse.weighted(*ranks, F.col("a"), F.col("b")))
    each = kw.crossJoin(F.broadcast(params)), near.crossJoin(F.broadcast(params))
    top = fuse.fuse(*each, F.round(score, 9), ["method", "k", "a", "b", "query_id"]).withColumnRenamed("fused_rank", "r").filter(F.col("r") <= K)
    own = F.when(F.col("id") == F.concat(F.lit("n"), F.col("query_id").cast("string")), F.lit(1.0) / F.col("r")).otherwise(0.0)
    return top.groupBy("method", "k", F.col("a").alias("keyword_weight")).agg((F.sum(own) / F.countDistinct("query_id")).alias("mrr"), F.count("*").alias("n"))


# Presentation


@query(f"WITH RECURSIVE {KEYWORD} SELECT note_id, chunk_id, place AS rank FROM (SELECT note_id, chunk_id, row_number() OVER (ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY rank) AS n FROM keyword WHERE rank <= 200) WHERE n = 1) WHERE place <= 50")
def note_rows(spark, sf):
    """The flagship: documents to chunks to keyword hits to one row a note."""
    hits = lexical.keyword_search(M.corpus(spark, sf), QUERY, 200).withColumnRenamed("rank", "fused_rank")
    return present.note_rows(hits).select("note_id", "chunk_id", "rank")


@query(f"""WITH RECURSIVE {KEYWORD}, r AS (SELECT note_id, place AS rank FROM (SELECT note_id, row_number() OVER (ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY rank) AS n FROM keyword WHERE rank <= 200) WHERE n = 1) WHERE place <= 30),
    x AS (SELECT 'n' || doc_id AS note_id, n_chars FROM documents WHERE contains(strip_accents(lower(source || ' ' || lang)), 'src1') AND 'n' || doc_id NOT IN (SELECT note_id FROM r)),
    a AS (SELECT note_id, (SELECT coalesce(max(rank), 0) FROM r) + row_number() OVER (ORDER BY n_chars DESC, note_id) AS rank FROM x)
    SELECT note_id, rank, by_title FROM (SELECT note_id, rank, false AS by_title FROM r UNION ALL SELECT note_id, rank, true FROM a) WHERE rank <= 50""")
def lexical_append(spark, sf):
    """Thirty rows of the search, then notes whose title or tag matches."""
    hits = lexical.keyword_search(M.corpus(spark, sf), QUERY, 200).withColumnRenamed("rank", "fused_rank")
    rows = present.note_rows(hits, 30)
    hay = T.haystack(F.concat_ws(" ", "source", "lang"))
    lex = _docs(spark, sf).filter(lexical.matches(hay, groups("src1"))).select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("note_id"), F.col("n_chars").alias("updated_at"))
    return present.append_lexical(rows.select("note_id", "rank"), lex)


@query(f"WITH {ARMS}, f AS (SELECT query_id, keyword_rank, row_number() OVER (PARTITION BY query_id ORDER BY {_WEIGHTED} DESC, id) AS r FROM both_arms WHERE vector_rank IS NOT NULL) SELECT query_id, NOT bool_or(keyword_rank IS NOT NULL) AS notice FROM f WHERE r <= 5 GROUP BY query_id")
def semantic_notice(spark, sf):
    """Over the first five results that the vector arm knows: whether none of them has a literal hit."""
    near = _fused(spark, sf, fuse.weighted).filter("vector_rank is not null").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("fused_rank"))).filter("r <= 5")
    return present.semantic_only(near.withColumn("has_hit", F.col("keyword_rank").isNotNull()), ["query_id"])


_SPANS = f"""top AS (SELECT * FROM keyword WHERE rank <= 200), o AS (SELECT chunk_id, s, s + len AS e FROM (
        SELECT chunk_id, t, len, i, sum(length(part)) OVER (PARTITION BY chunk_id, t ORDER BY i) + (i - 1) * len AS s, count(*) OVER (PARTITION BY chunk_id, t) AS n FROM (
            SELECT chunk_id, t, length(t) AS len, unnest(string_split(hay, t)) AS part, generate_subscripts(string_split(hay, t), 1) AS i FROM top, (SELECT unnest([{", ".join(f"'{t}'" for t in TERMS)}]) AS t))) WHERE i < n),
    islands AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY chunk_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT * FROM o))),
    spans AS (SELECT chunk_id, min(s)::INT AS s, max(e)::INT AS e FROM islands GROUP BY chunk_id, g)"""
_FLATTEN = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+', ' ', 'g')"
_EX = "[。！？；，….!?;,\n]"


@query(f"""WITH RECURSIVE {KEYWORD}, {_SPANS},
    x AS (SELECT chunk_id, text, regexp_replace({_FLATTEN.format('text')}, ' $', '') AS flat FROM top), y AS (SELECT *, length(flat) AS n FROM x),
    moved AS (SELECT y.chunk_id, least(length({_FLATTEN.format('substr(text, 1, s)')}), n) AS s, least(length({_FLATTEN.format('substr(text, 1, e)')}), n) AS e FROM y JOIN spans USING (chunk_id)),
    j AS (SELECT chunk_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY chunk_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM moved WHERE e > s)) GROUP BY chunk_id, g),
    h AS (SELECT chunk_id, list({{'s': s, 'e': e}} ORDER BY s) AS hits FROM j GROUP BY chunk_id),
    w1 AS (SELECT chunk_id, flat, n, coalesce(hits, []) AS hits, greatest(0, coalesce(hits[1].s, 0) - 14) AS lo FROM y LEFT JOIN h USING (chunk_id)), w2 AS (SELECT *, least(n, lo + 44) AS hi FROM w1),
    w3 AS (SELECT * REPLACE (CASE WHEN hi = n THEN greatest(0, n - 44) ELSE lo END AS lo) FROM w2),
    w4 AS (SELECT *, CASE WHEN regexp_matches(ahead, '{_EX}') THEN length(regexp_extract(ahead, '^([^。！？；，….!?;,\n]*)', 1)) + 1 ELSE 0 END AS p FROM (SELECT *, substr(flat, lo + 1, least(8, n - 1 - lo) + 1) AS ahead FROM w3)),
    w5 AS (SELECT * REPLACE (CASE WHEN lo > 0 AND p > 0 THEN least(n - 1, lo + p) ELSE lo END AS lo) FROM w4),
    w6 AS (SELECT *, greatest(0, hi - 8) AS low FROM w5), w7 AS (SELECT *, length(regexp_extract(substr(flat, low + 1, hi - low), '(?s)^(.*{_EX})', 1)) AS q FROM w6),
    w8 AS (SELECT * REPLACE (CASE WHEN hi < n AND q > 0 THEN least(low + q, lo + 44) ELSE hi END AS hi) FROM w7),
    w9 AS (SELECT * REPLACE (coalesce([x.s FOR x IN hits IF x.s < lo AND lo < x.e][1], lo) AS lo, coalesce([x.e FOR x IN hits IF x.s < hi AND hi < x.e][1], hi) AS hi) FROM w8), w10 AS (SELECT * REPLACE (least(n, greatest(hi, lo + 1)) AS hi) FROM w9),
    z AS (SELECT *, CASE WHEN lo > 0 THEN 1 ELSE 0 END - lo AS shift FROM w10)
    SELECT chunk_id, CASE WHEN n <= 44 THEN flat ELSE CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(flat, lo + 1, hi - lo) || CASE WHEN hi < n THEN '…' ELSE '' END END AS excerpt,
        array_to_string(list_slice(CASE WHEN n <= 44 THEN [x.s || '-' || x.e FOR x IN hits] ELSE [(x.s + shift) || '-' || (x.e + shift) FOR x IN hits IF x.s >= lo AND x.e <= hi] END, 1, 6), ',') AS highlights FROM z""")
def excerpts(spark, sf):
    hits = lexical.keyword_search(M.corpus(spark, sf), QUERY, 200)
    spans = hits.withColumn("spans", lexical.match_ranges(F.col("hay"), list(TERMS)))
    out = present.excerpts(spans.select("chunk_id", "text", "spans"))
    return out.select("chunk_id", "excerpt", F.array_join(F.transform("highlights", lambda h: F.concat_ws("-", h["s"].cast("string"), h["e"].cast("string"))), ",").alias("highlights"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'x' WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN source ELSE '无预览内容' END AS text, doc_id % 4 + 1 AS level FROM documents")
def excerpt_fallback(spark, sf):
    r = F.col("doc_id") % 4
    e = present.excerpt_fallback(F.when(r == 0, "x").otherwise(" \n"), F.when(r <= 1, F.col("lang")), F.when(r <= 2, F.col("source")).otherwise(""))
    return _docs(spark, sf).select("doc_id", e.alias("e")).select("doc_id", "e.text", F.col("e.level").cast("long").alias("level"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'top' WHEN lang = 'en' THEN 'transcript:b' || doc_id ELSE 'block:b' || doc_id END AS anchor FROM documents")
def result_anchor(spark, sf):
    a = present.anchor(F.when(F.col("lang") == "en", "transcript").otherwise("text"), F.concat(F.lit("b"), F.col("doc_id").cast("string")), F.col("doc_id") % 3 != 0)
    return _docs(spark, sf).select("doc_id", a.alias("anchor"))


# Notes


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id % 7 = 0 DESC, n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 100")
def note_list_sorted(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("note_id"), (F.col("doc_id") % 7 == 0).alias("is_pinned"), F.col("n_chars").alias("updated_at"))
    top = notes.note_order(d).limit(100)
    return top.select(F.col("note_id").alias("doc_id"), F.row_number().over(Window.orderBy(F.desc("is_pinned"), F.desc("updated_at"), "note_id")).alias("place"))


@query(f"WITH b AS ({_CB}), n AS (SELECT note_id, count(*) FILTER (kind = 'text' AND t <> '') AS a, count(*) FILTER (kind = 'audio') AS c, count(*) FILTER (kind = 'file') AS f FROM b GROUP BY note_id) SELECT note_id, nullif(concat_ws(' · ', CASE WHEN a > 0 THEN a || ' 段文字' END, CASE WHEN c > 0 THEN c || ' 段录音' END, CASE WHEN f > 0 THEN f || ' 个文档' END), '') AS kinds FROM n")
def kind_counts(spark, sf):
    return notes.kind_counts(M.conversation_blocks(spark, sf))


_KINDS = "kinds AS (SELECT note_id, nullif(concat_ws(' · ', CASE WHEN a > 0 THEN a || ' 段文字' END, CASE WHEN c > 0 THEN c || ' 段录音' END, CASE WHEN f > 0 THEN f || ' 个文档' END), '') AS kinds FROM (SELECT note_id, count(*) FILTER (kind = 'text' AND t <> '') AS a, count(*) FILTER (kind = 'audio') AS c, count(*) FILTER (kind = 'file') AS f FROM b GROUP BY note_id))"
# Markdown of conversation texts, as of documents above.
_CMD = _MD.replace("doc_id", "block_id").replace("FROM documents", "FROM (SELECT block_id, coalesce(raw, '') AS text FROM b WHERE kind = 'text')")


@query(rf"""WITH b AS ({_CB}), {_KINDS}, {_CMD}, f AS (SELECT b.note_id, b.ord, {TRIM.format("list_filter(string_split(plain, chr(10)), lambda x: x <> '')[1]")} AS line FROM b JOIN md USING (block_id)),
    g AS (SELECT note_id, arg_min(line, ord) AS line FROM f WHERE line <> '' GROUP BY note_id)
    SELECT note_id, coalesce(CASE WHEN length(note_id) % 2 = 0 THEN 'about ' || note_id END, CASE WHEN length(g.line) > 80 THEN substr(g.line, 1, 80) || '…' ELSE g.line END, kinds) AS line FROM kinds LEFT JOIN g USING (note_id)""")
def secondary_line(spark, sf):
    b = M.conversation_blocks(spark, sf)
    one = b.select("note_id").distinct().select("note_id", F.when(F.length("note_id") % 2 == 0, F.concat(F.lit(" about "), F.col("note_id"))).alias("one_liner"))
    return notes.secondary_line(b, one)


@query(f"WITH b AS ({_CB}) SELECT note_id, max(ord) + 1 AS next_ord FROM b GROUP BY note_id")
def next_order(spark, sf):
    return notes.next_order(M.conversation_blocks(spark, sf))


@query(f"WITH b AS ({_CB}), f AS (SELECT note_id, kind, min(ord) AS o FROM b GROUP BY note_id, kind) SELECT note_id, string_agg(kind, ',' ORDER BY o) AS kinds FROM f GROUP BY note_id")
def present_kinds(spark, sf):
    return notes.present_kinds(M.conversation_blocks(spark, sf))


@query("SELECT 'd' || doc_id AS note_id FROM documents WHERE doc_id % 9 = 0")
def empty_sweep(spark, sf):
    d = _docs(spark, sf).withColumn("note_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    none = F.lit(None).cast("string")
    b = d.select("note_id", F.lit("text").alias("kind"), F.when(F.col("doc_id") % 9 != 0, "x").otherwise("---\n \n").alias("text"), *[none.alias(c) for c in ("image_asset_ref", "audio_asset_ref", "file_name", "url")])
    return notes.empty_notes(b)


@query(rf"""WITH b AS ({_CB}), {_CMD}, s AS (SELECT b.note_id, b.ord, CASE b.kind WHEN 'text' THEN CASE WHEN plain <> '' THEN '【文字】' || chr(10) || plain END WHEN 'audio' THEN CASE WHEN t = '' THEN '【录音转写】(无转写文字)' ELSE '【录音转写】' || chr(10) || t END
    ELSE '【文档:system.txt · txt】' || chr(10) || CASE WHEN t = '' THEN '(未提取到文字)' WHEN length(t) > 8000 THEN substr(t, 1, 8000) || chr(10) || '…(文档过长,已截断)' ELSE t END END AS x FROM b LEFT JOIN md USING (block_id))
    SELECT note_id, sha256(whole) AS text_hash, length(whole) AS n FROM (SELECT note_id, concat_ws(chr(10) || chr(10), '【标题】' || note_id, string_agg(x, chr(10) || chr(10) ORDER BY ord)) AS whole FROM s GROUP BY note_id)""")
def aggregate_text(spark, sf):
    b = M.conversation_blocks(spark, sf)
    out = notes.aggregate_text(b, b.select("note_id", F.col("note_id").alias("title")).distinct())
    return out.select("note_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n"))


def _export_notes(b):
    return b.select("note_id", F.col("note_id").alias("title"), F.lit("inbox").alias("folder"), F.array(F.lit("a"), F.lit("b c")).alias("tags")).distinct()


_EXPORT = f"""WITH b AS ({_CB}), s AS (SELECT note_id, ord, CASE kind WHEN 'text' THEN nullif(t, '') WHEN 'audio' THEN '**录音转写:**' || CASE WHEN t = '' THEN '(无转写)' ELSE t END
    ELSE '**文档:**system.txt(txt)' || CASE WHEN t = '' THEN '' ELSE chr(10) || CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '…' ELSE t END END END AS x FROM b),
    j AS (SELECT note_id, string_agg(x, chr(10) || chr(10) ORDER BY ord) AS body FROM s GROUP BY note_id)
    SELECT note_id, sha256({TRIM.format("'# ' || note_id || chr(10) || '文件夹:inbox  ·  标签:#a #b c' || coalesce(chr(10) || chr(10) || body, '')")} || chr(10)) AS text_hash FROM j"""


@query(_EXPORT)
def export_text(spark, sf):
    b = M.conversation_blocks(spark, sf)
    return notes.export_text(b, _export_notes(b)).select("note_id", F.sha2("text", 256).alias("text_hash"))


@query("SELECT doc_id, CASE WHEN lower(lang) = lower(source) THEN lang ELSE lang || '|' || 'x ' || source END AS tags FROM documents")
def tags_sanitize(spark, sf):
    raw = F.array(F.concat(F.lit("  "), F.col("lang")), F.lit(" "), F.upper("lang"), F.concat(F.lit("x \n"), F.col("source")), F.concat(F.lit("X  "), F.upper("source")))
    return _docs(spark, sf).select("doc_id", F.array_join(notes.sanitize_tags(raw), "|").alias("tags"))


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_nationkey % 3 = 1 THEN 'ai' END, '未命名笔记') AS title FROM nation")
def display_title(spark, sf):
    r = F.col("n_nationkey") % 3
    return M.read(spark, sf, "nation").select("n_nationkey", notes.display_title(F.when(r == 0, F.col("n_name")).otherwise("  "), F.when(r == 1, " ai ")).alias("title"))


@query("SELECT row_number() OVER (ORDER BY g, o, chip) AS place, chip FROM (SELECT 1 AS g, 0 AS o, 'all' AS chip UNION ALL SELECT 2, 0, 'unfiled' UNION ALL SELECT 3, n_nationkey, n_name FROM nation UNION ALL SELECT 4, 0, 'manage')")
def folder_chips(spark, sf):
    folders = M.read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("sort_order"), F.col("n_name").alias("name"))
    cards = M.read(spark, sf, "customer").select(F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("folder"))
    return notes.folder_chips(folders, cards)


@query("SELECT n.n_name AS folder, count(c.c_custkey) AS cards FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def folder_counts(spark, sf):
    n, c = M.read(spark, sf, "nation"), M.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy(F.col("n_name").alias("folder")).agg(F.count("c_custkey").alias("cards"))


@query(f"""WITH {TEXTS} SELECT 'n' || d.doc_id AS note_id, d.source AS title, coalesce(CASE WHEN length(t.text) > 60 THEN substr(t.text, 1, 60) || '…' ELSE nullif(t.text, '') END, '（无可检索文本）') AS preview,
    row_number() OVER (ORDER BY d.n_chars DESC, 'n' || d.doc_id) AS place FROM documents d LEFT JOIN texts t ON t.note_id = 'n' || d.doc_id QUALIFY place <= 500""")
def note_summaries(spark, sf):
    """The 500 latest of the list, with their places."""
    t = M.texts(M.document_blocks(spark, sf))
    n = _docs(spark, sf).select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("note_id"), F.col("source").alias("title"), F.col("n_chars").alias("updated_at"))
    top = notes.note_summaries(t, n).limit(500)
    return top.select("note_id", "title", "preview", F.row_number().over(Window.orderBy(F.desc("updated_at"), "note_id")).alias("place"))


# Derived data

_STORED = f"""b AS ({_CB}), cur AS (SELECT block_id AS chunk_id, note_id, {_CHASH} AS h FROM b),
    st AS (SELECT chunk_id, note_id, CASE WHEN length(chunk_id) % 3 = 0 THEN 'old' ELSE h END AS h, CASE WHEN ends_with(chunk_id, '2') THEN 'e0' ELSE 'e1' END AS v FROM cur WHERE NOT ends_with(chunk_id, '0') UNION ALL SELECT 'gone-' || chunk_id, 'gone' || note_id, h, 'e1' FROM cur WHERE ends_with(chunk_id, '1'))"""


def _stored(spark, sf):
    b = M.conversation_blocks(spark, sf)
    cur = b.select(F.col("block_id").alias("chunk_id"), "note_id", T.content_hash({c: F.col(c) for c in b.columns}).alias("content_hash"), F.lit("block").alias("strategy"))
    old = cur.filter(~F.endswith("chunk_id", F.lit("0"))).select("chunk_id", "note_id", F.when(F.length("chunk_id") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.endswith("chunk_id", F.lit("2")), "e0").otherwise("e1").alias("embedding_version"))
    gone = cur.filter(F.endswith("chunk_id", F.lit("1"))).select(F.concat(F.lit("gone-"), F.col("chunk_id")).alias("chunk_id"), F.concat(F.lit("gone"), F.col("note_id")).alias("note_id"), "content_hash", F.lit("e1").alias("embedding_version"))
    return cur, old.unionByName(gone).withColumn("chunk_strategy", F.lit("block"))


@query(f"WITH {_STORED} SELECT coalesce(cur.chunk_id, st.chunk_id) AS chunk_id, CASE WHEN cur.chunk_id IS NULL THEN 'orphan' WHEN st.h = cur.h AND st.v = 'e1' THEN 'up_to_date' ELSE 'pending' END AS state FROM cur FULL JOIN st ON cur.chunk_id = st.chunk_id")
def work_plan(spark, sf):
    cur, stored = _stored(spark, sf)
    return derive.work_plan(cur, stored, "e1")


@query(f"WITH {_STORED} SELECT st.chunk_id, CASE WHEN st.note_id NOT IN (SELECT note_id FROM cur) THEN 'note_deleted' WHEN cur.chunk_id IS NULL THEN 'block_deleted' WHEN st.v <> 'e1' THEN 'version_changed' WHEN st.h <> cur.h THEN 'content_changed' ELSE 'accept' END AS decision FROM st LEFT JOIN cur ON cur.chunk_id = st.chunk_id AND cur.note_id = st.note_id")
def stale_guard(spark, sf):
    cur, stored = _stored(spark, sf)
    current = cur.select("note_id", F.col("chunk_id").alias("block_id"), F.col("content_hash").alias("current_hash"), F.lit("e1").alias("current_version"))
    return derive.guard(stored.withColumn("block_id", F.col("chunk_id")), current).select("chunk_id", "decision")


@query(f"""WITH {_STORED}, o AS (SELECT DISTINCT note_id FROM st WHERE note_id NOT IN (SELECT note_id FROM cur)), n AS (SELECT (SELECT count(DISTINCT note_id) FROM cur) AS live, (SELECT count(*) FROM o) AS gone, (SELECT count(DISTINCT note_id) FROM st) AS stored)
    SELECT library, live_notes, orphan_notes, orphan_notes = 0 AS is_consistent, NOT (live_notes = 0 AND orphan_notes > 0) AS is_safe FROM (
        SELECT 'whole' AS library, live AS live_notes, gone AS orphan_notes FROM n UNION ALL SELECT 'emptied', 0, stored FROM n UNION ALL SELECT 'nothing stored', live, 0 FROM n)""")
def consistency(spark, sf):
    """Of the library as it is, of one that lost all notes (not safe to reconcile), and of one without derived data."""
    cur, stored = _stored(spark, sf)
    live = cur.select("note_id").distinct()
    of = lambda name, live, stored: derive.consistency(live, derive.orphans(live, embeddings=stored, index=stored.limit(0))).withColumn("library", F.lit(name))
    return of("whole", live, stored).unionByName(of("emptied", live.limit(0), stored)).unionByName(of("nothing stored", live, stored.limit(0)))


@query(f"WITH {_STORED}, n AS (SELECT chunk_id, 'e2' AS v FROM cur WHERE ends_with(chunk_id, '3')) SELECT coalesce(n.chunk_id, st.chunk_id) AS chunk_id, coalesce(n.v, st.v) AS embedding_version FROM st FULL JOIN n ON n.chunk_id = st.chunk_id")
def embedding_upsert(spark, sf):
    cur, stored = _stored(spark, sf)
    new = cur.filter(F.endswith("chunk_id", F.lit("3"))).select("chunk_id", "note_id", "content_hash", F.lit("e2").alias("embedding_version"), F.lit("block").alias("chunk_strategy"), F.lit(2).alias("created_at"))
    return derive.upsert(stored.withColumn("created_at", F.lit(1)), new).select("chunk_id", "embedding_version")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND p > 0 THEN 'failed' WHEN p = 0 THEN 'ready' WHEN event_id % 3 = 0 THEN 'building' WHEN event_id % 2 = 0 THEN 'rebuilding' ELSE 'stale' END AS state,
    CASE WHEN NOT (event_id % 4 = 0 AND p > 0) AND p > 0 AND event_id % 3 = 0 THEN round((10 - p) / 10.0, 6) END AS progress FROM (SELECT event_id, event_id % 7 AS p FROM events)""")
def index_state(spark, sf):
    e = F.col("event_id")
    s = derive.index_state(F.lit(10), e % 7, F.when(e % 2 == 0, 1).otherwise(0), e % 3 != 0, F.when(e % 4 == 0, "down"))
    return M.read(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", "s.state", F.round("s.progress", 6).alias("progress"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'full' WHEN event_id % 7 = 0 THEN 'offline' WHEN event_id % 5 = 0 THEN 'semantic_unavailable' WHEN s = 'ready' THEN 'full' WHEN s = 'building' THEN 'index_building' WHEN s = 'failed' THEN 'semantic_unavailable' ELSE 'index_rebuilding' END AS capability
    FROM (SELECT event_id, ['ready', 'building', 'rebuilding', 'stale', 'failed'][(event_id % 5)::INT + 1] AS s FROM events)""")
def capability(spark, sf):
    e = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("ready", "building", "rebuilding", "stale", "failed"))), (e % 5 + 1).cast("int"))
    return M.read(spark, sf, "events").select("event_id", derive.capability(state, e % 5 != 0, e % 11 != 0, e % 7 == 0).alias("capability"))


@query("""SELECT event_id, CASE WHEN cloud AND consent THEN 'cloud' WHEN han AND zh THEN 'local_chinese' WHEN NOT han AND en THEN 'local_english' WHEN cloud THEN 'cloud_needs_consent' ELSE 'unavailable' END AS route
    FROM (SELECT event_id, event_id % 2 = 0 AS han, event_id % 3 = 0 AS zh, event_id % 5 = 0 AS en, event_id % 7 < 3 AS cloud, event_id % 11 < 4 AS consent FROM events)""")
def embed_route(spark, sf):
    e = F.col("event_id")
    return M.read(spark, sf, "events").select("event_id", derive.embed_route(e % 2 == 0, e % 3 == 0, e % 5 == 0, e % 7 < 3, e % 11 < 4).alias("route"))


@query("SELECT s, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s = 429 THEN 'rate_limited' WHEN s BETWEEN 400 AND 499 THEN 'rejected' ELSE 'transport' END AS error FROM (SELECT DISTINCT 200 + event_id % 350 AS s FROM events)")
def http_error_class(spark, sf):
    return M.read(spark, sf, "events").select((F.col("event_id") % 350 + 200).alias("s")).distinct().select("s", derive.error_class(F.col("s")).alias("error"))


# Differences

_DIFF = f"""WITH b AS ({_CB}), c AS (SELECT note_id, block_id, ord, kind, {_CHASH} AS h, CASE WHEN kind = 'text' THEN length(t) ELSE 0 END AS n FROM b),
    now AS (SELECT * FROM c WHERE ord % 5 <> 3), old AS (SELECT note_id, block_id, kind, CASE WHEN ord % 4 = 2 THEN 'x' ELSE h END AS h, CASE WHEN ord % 4 = 2 THEN n - 5 ELSE n END AS n FROM c WHERE ord % 6 <> 5),
    d AS (SELECT coalesce(now.note_id, old.note_id) AS note_id, coalesce(now.block_id, old.block_id) AS block_id, coalesce(now.kind, old.kind) AS kind, abs(coalesce(now.n, 0) - coalesce(old.n, 0)) AS delta,
        CASE WHEN old.h IS NULL THEN 'added' WHEN now.h IS NULL THEN 'deleted' WHEN now.h <> old.h THEN 'modified' END AS change FROM now FULL JOIN old ON now.block_id = old.block_id AND now.note_id = old.note_id)"""


def _snapshots(spark, sf):
    """(now, as of the last summary): some blocks are new, some gone, some changed."""
    b = M.conversation_blocks(spark, sf)
    c = {x: F.col(x) for x in b.columns}
    cur = b.select("note_id", "block_id", "ord", T.content_hash(c).alias("hash"), "kind", T.brief(c).alias("brief"), F.when(F.col("kind") == "text", F.length(T.trim(F.col("text")))).otherwise(0).alias("text_length"))
    changed = F.col("ord") % 4 == 2
    old = cur.filter("ord % 6 <> 5").withColumns({"hash": F.when(changed, "x").otherwise(F.col("hash")), "text_length": F.when(changed, F.col("text_length") - 5).otherwise(F.col("text_length"))})
    return cur.filter("ord % 5 <> 3").drop("ord"), old.drop("ord")


def _diff(spark, sf):
    return diff.snapshot_diff(*_snapshots(spark, sf))


@query(_DIFF + " SELECT note_id, block_id, change, kind, delta FROM d WHERE change IS NOT NULL")
def snapshot_diff(spark, sf):
    return _diff(spark, sf).select("note_id", "block_id", "change", "kind", "delta")


@query(_DIFF + " SELECT note_id, bool_or(change = 'deleted' OR kind <> 'text') OR coalesce(sum(delta) FILTER (change <> 'deleted' AND kind = 'text'), 0) >= 12 AS significant FROM d WHERE change IS NOT NULL GROUP BY note_id")
def diff_significance(spark, sf):
    return diff.significance(_diff(spark, sf))


# Evaluation


def _outcomes(spark, sf):
    return evaluate.outcomes(M.cases(spark, sf), evaluate.returned_notes(_case_results(spark, sf)))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {RESULTS} SELECT case_id, scope, origin, is_positive, expected_count, hit_at1, hit_at3, hit_at5, round(reciprocal_rank, 6) AS reciprocal_rank, returned_none FROM outcomes")
def eval_outcomes(spark, sf):
    return _rounded(_outcomes(spark, sf))


@query(f"WITH {RESULTS} SELECT {METRICS} FROM outcomes")
def eval_metrics(spark, sf):
    return _rounded(evaluate.metrics(_outcomes(spark, sf)))


@query(f"""WITH {RESULTS}, g AS (SELECT 'all' AS "group", * FROM outcomes UNION ALL SELECT 'golden', * FROM outcomes WHERE origin <> 'regression' UNION ALL SELECT 'regression', * FROM outcomes WHERE origin = 'regression'
    UNION ALL SELECT 'in_scope', * FROM outcomes WHERE is_positive AND scope = 'in_scope' UNION ALL SELECT 'cross_language', * FROM outcomes WHERE is_positive AND scope = 'cross_language'
    UNION ALL SELECT 'in_scope_regression', * FROM outcomes WHERE is_positive AND scope = 'in_scope' AND origin = 'regression') SELECT "group", {METRICS} FROM g GROUP BY "group" """)
def eval_groups(spark, sf):
    return _rounded(evaluate.metrics(evaluate.in_groups(_outcomes(spark, sf)), ["group"]))


@query(f"""WITH {RESULTS}, f AS (SELECT case_id, is_positive FROM outcomes WHERE CASE WHEN is_positive THEN NOT hit_at5 ELSE NOT returned_none END),
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    vec AS (SELECT q.vec_id::VARCHAR AS case_id, 'n' || v.vec_id AS note_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, v.vec_id) AS vector_rank FROM v, v AS q WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY vector_rank <= 5),
    arms AS (SELECT case_id, note_id, r.rank AS keyword_rank, vector_rank FROM results r FULL JOIN vec USING (case_id, note_id)),
    fused AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(coalesce(0.7::DOUBLE / keyword_rank, 0) + coalesce(0.3::DOUBLE / vector_rank, 0), 9) DESC, note_id) AS rank FROM arms),
    x AS (SELECT fused.*, c.expected[1] = note_id AS is_first, list_contains(c.expected, note_id) AS is_any FROM fused JOIN cases c USING (case_id))
    SELECT f.case_id, f.is_positive, min(keyword_rank) FILTER (is_first) AS keyword_rank, min(vector_rank) FILTER (is_first) AS vector_rank, min(rank) FILTER (is_any) AS hybrid_rank FROM f LEFT JOIN x USING (case_id) GROUP BY f.case_id, f.is_positive""")
def eval_failures(spark, sf):
    """Where each arm and both together rank what the failed cases expect; a case's vector is that of its number."""
    v = M.vectors(spark, sf)
    asked = v.join(M.read(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    near = vector.nearest(v.select("id", "vector"), asked, 5).select(F.col("query_id").cast("string").alias("case_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.col("rank").alias("vector_rank"))
    found = _case_results(spark, sf)
    kw = found.select("case_id", F.col("note_id").alias("id"), F.col("rank").alias("keyword_rank"))
    both = fuse.fuse(kw, near, F.round(fuse.weighted(F.col("keyword_rank"), F.col("vector_rank")), 9), ["case_id"]).select("case_id", F.col("id").alias("note_id"), "keyword_rank", "vector_rank", F.col("fused_rank").alias("rank"))
    cases = M.cases(spark, sf)
    of = evaluate.outcomes(cases, evaluate.returned_notes(found))
    return evaluate.failure_ranks(evaluate.failures(of), cases, both).select("case_id", "is_positive", "keyword_rank", "vector_rank", "hybrid_rank")


@query("SELECT event_type, list_sort(list(value))[(count(*) // 2)::INT + 1] AS p50, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95::DOUBLE))::INT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, sf):
    return evaluate.group_percentiles(M.read(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def _arm_metrics(spark, sf):
    """Metrics with latencies: of all cases, and of those in scope, against the latencies of two kinds of events."""
    o = _outcomes(spark, sf)
    p = evaluate.group_percentiles(M.read(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    of = lambda o, kind: _rounded(evaluate.metrics(o).select("recall_at1", "recall_at3", "recall_at5", "mrr")).join(F.broadcast(p.filter(F.col("event_type") == kind).select("p50", "p95")))
    return of(o, "view"), of(o.filter("scope = 'in_scope'"), "click")


_LAT = "lat AS (SELECT event_type, list_sort(list(value))[(count(*) // 2)::INT + 1] AS p50, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95::DOUBLE))::INT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type)"
_DELTAS = f"""{RESULTS}, {_LAT}, cm AS (SELECT {METRICS} FROM outcomes), bm AS (SELECT {METRICS} FROM outcomes WHERE scope = 'in_scope'),
    d AS (SELECT i, metric, label, cur AS current, base AS baseline, cur - base AS delta, low, CASE WHEN abs(cur - base) < 1e-9 THEN 'unchanged' WHEN (cur > base) <> low THEN 'better' ELSE 'worse' END AS direction FROM (
        SELECT 1 AS i, 'recall_at1' AS metric, 'Recall@1' AS label, cm.recall_at1::DOUBLE AS cur, bm.recall_at1::DOUBLE AS base, false AS low FROM cm, bm UNION ALL SELECT 2, 'recall_at3', 'Recall@3', cm.recall_at3, bm.recall_at3, false FROM cm, bm UNION ALL SELECT 3, 'recall_at5', 'Recall@5', cm.recall_at5, bm.recall_at5, false FROM cm, bm UNION ALL SELECT 4, 'mrr', 'MRR', cm.mrr, bm.mrr, false FROM cm, bm
        UNION ALL SELECT 5, 'p50', 'P50', a.p50, b.p50, true FROM lat a, lat b WHERE a.event_type = 'view' AND b.event_type = 'click' UNION ALL SELECT 6, 'p95', 'P95', a.p95, b.p95, true FROM lat a, lat b WHERE a.event_type = 'view' AND b.event_type = 'click'))"""


@query(f"WITH {_DELTAS} SELECT metric, round(current, 6) AS current, round(baseline, 6) AS baseline, round(delta, 6) AS delta, direction FROM d")
def metric_deltas(spark, sf):
    return _rounded(evaluate.metric_deltas(*_arm_metrics(spark, sf)))


@query(f"""WITH {_DELTAS}, t AS (SELECT coalesce(bool_or(NOT low AND direction = 'better'), false) AS up, coalesce(bool_or(NOT low AND direction = 'worse'), false) AS down, coalesce(bool_or(low AND direction = 'worse'), false) AS slow,
        coalesce(string_agg(label || ' ' || CASE WHEN delta > 0 THEN '+' WHEN delta < 0 THEN '−' ELSE '' END || CASE WHEN low THEN round(abs(delta))::BIGINT || ' ms' ELSE printf('%.3f', abs(delta)) END, ' · ' ORDER BY i) FILTER (direction <> 'unchanged'), '') AS detail FROM d)
    SELECT CASE WHEN up OR down OR slow THEN concat_ws('，', CASE WHEN up AND NOT down THEN '质量提升' WHEN down AND NOT up THEN '质量下降' WHEN up THEN '质量有涨有跌' END, CASE WHEN slow THEN '延迟回退' ELSE '延迟未回退' END) || '。' || detail || '。是否上线由 Release Gate 判定。' ELSE '与基线基本一致，没有可观察的差异。' END AS summary FROM t""")
def tradeoff_summary(spark, sf):
    return evaluate.tradeoff(evaluate.metric_deltas(*_arm_metrics(spark, sf)))


@query(f"""WITH {_DELTAS} SELECT '| arms | Recall@1 | Recall@3 | Recall@5 | MRR | P50 | P95 | 建索引 |' || chr(10) || '|---|---|---|---|---|---|---|---|' || chr(10)
    || (SELECT printf('| all | %.3f | %.3f | %.3f | %.3f | %.2f ms | %.2f ms | %.0f ms |', cm.recall_at1::DOUBLE, cm.recall_at3::DOUBLE, cm.recall_at5::DOUBLE, cm.mrr::DOUBLE, p50, p95, 12.0::DOUBLE) FROM cm, lat WHERE event_type = 'view') || chr(10)
    || (SELECT printf('| in scope | %.3f | %.3f | %.3f | %.3f | %.2f ms | %.2f ms | %.0f ms |', bm.recall_at1::DOUBLE, bm.recall_at3::DOUBLE, bm.recall_at5::DOUBLE, bm.mrr::DOUBLE, p50, p95, 12.0::DOUBLE) FROM bm, lat WHERE event_type = 'click') AS report""")
def experiment_report(spark, sf):
    arm = lambda df, i, name: df.select(F.lit(i).alias("place"), F.lit(name).alias("arm"), "*", F.lit(12.0).alias("build_ms"))
    a, b = _arm_metrics(spark, sf)
    return evaluate.arms_table(arm(a, 1, "all").unionByName(arm(b, 2, "in scope")), "arms")


@query(f"WITH {RESULTS} SELECT CASE WHEN case_id::BIGINT % 5 = 0 THEN 'exact_fact' ELSE 'paraphrase' END AS category, count(*) AS cases, count(*) FILTER (hit_at1) AS hits_at1, count(*) FILTER (hit_at3) AS hits_at3, count(*) FILTER (hit_at5) AS hits_at5, round(avg(hit_at1::INT), 6) AS recall_at1 FROM outcomes WHERE is_positive GROUP BY 1")
def eval_category(spark, sf):
    kinds = M.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.when(F.col("item_id") % 5 == 0, "exact_fact").otherwise("paraphrase").alias("category"))
    return _rounded(evaluate.by_category(_outcomes(spark, sf), kinds))


_SIGNALS = f"WITH {NEIGHBOURS}, r AS (SELECT *, round(similarity, 9) AS sim FROM ranked WHERE rank <= 10), s AS (SELECT query_id, max(sim) FILTER (rank = 1) AS top1, max(sim) FILTER (rank = 1) - max(sim) FILTER (rank = 2) AS margin, max(sim) FILTER (rank = 1) / avg(sim) FILTER (rank > 1) AS ratio, bool_or(id % 50 = 0) AS has_keyword, count(*) AS n FROM r GROUP BY query_id)"


def _signals(spark, sf):
    r = _near(spark, sf, 10).select("query_id", F.round("similarity", 9).alias("similarity"), F.when(F.col("id") % 50 == 0, 1).alias("keyword_rank"))
    return evaluate.abstention_signals(r)


@query(_SIGNALS + " SELECT query_id, round(top1, 6) AS top1, round(margin, 6) AS margin, round(ratio, 6) AS top1_to_mean, has_keyword, n FROM s")
def abstention_signals(spark, sf):
    return _rounded(_signals(spark, sf))


@query(_SIGNALS + """ SELECT query_id, CASE WHEN top1 < f THEN 'abstain' WHEN margin < 0.2 THEN 'abstain' WHEN top1 < f * 1.5 OR margin < 0.3 THEN 'uncertain' ELSE 'confident' END AS confidence FROM (SELECT *, CASE WHEN has_keyword THEN 0.5 ELSE 0.7 END AS f FROM s)""")
def abstention_judge(spark, sf):
    return _signals(spark, sf).select("query_id", evaluate.abstain(floor=0.5, min_margin=0.2, floor_without_keyword=0.7).alias("confidence"))


@query("""WITH s AS (SELECT value + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS top1, event_id % 3 = 0 AS is_positive FROM events WHERE value IS NOT NULL)
    SELECT min(top1) FILTER (is_positive) AS positive_min, max(top1) FILTER (NOT is_positive) AS negative_max, list_sort(list(top1) FILTER (is_positive))[(count(*) FILTER (is_positive) // 2)::INT + 1] AS positive_median,
    list_sort(list(top1) FILTER (NOT is_positive))[(count(*) FILTER (NOT is_positive) // 2)::INT + 1] AS negative_median, count(*) FILTER (NOT is_positive AND top1 < (SELECT min(top1) FROM s WHERE is_positive)) AS negatives_below,
    round(min(top1) FILTER (is_positive) - max(top1) FILTER (NOT is_positive), 6) AS gap, round(coalesce(min(top1) FILTER (is_positive) - max(top1) FILTER (NOT is_positive AND top1 < (SELECT min(top1) FROM s WHERE is_positive)), 0.0), 6) AS safety_margin FROM s""")
def abstention_calibration(spark, sf):
    positive = F.col("event_id") % 3 == 0
    s = M.read(spark, sf, "events").filter("value is not null").select((F.col("value") + F.when(positive, 1).otherwise(0)).alias("top1"), positive.alias("is_positive"))
    return _rounded(evaluate.calibration(s))


_M64 = "18446744073709551616::UHUGEINT"
# The generator's draw t, and the differences of the positive cases in order of their ids.
@query(f"""WITH {RESULTS}, x AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS i, reciprocal_rank - CASE WHEN case_id::INT % 2 = 0 THEN reciprocal_rank / 2 ELSE reciprocal_rank END AS d FROM outcomes WHERE is_positive),
    n AS (SELECT count(*) AS n FROM x), t AS (SELECT b, (b * n + j + 1)::UHUGEINT AS t, n FROM n, (SELECT unnest(range(2000)) AS b), (SELECT unnest(range(100000)) AS j) WHERE j < n),
    z0 AS (SELECT b, n, (1592594996::UHUGEINT + t * 11400714819323198485::UHUGEINT) % {_M64} AS z FROM t),
    z1 AS (SELECT b, n, (xor(z, z >> 30) % {_M64} * 13787848793156543929::UHUGEINT) % {_M64} AS z FROM z0), z2 AS (SELECT b, n, (xor(z, z >> 27) % {_M64} * 10723151780598845931::UHUGEINT) % {_M64} AS z FROM z1),
    m AS (SELECT b, avg(d) AS m FROM (SELECT b, (xor(z, z >> 31) % n::UHUGEINT)::BIGINT AS i FROM z2) JOIN x USING (i) GROUP BY b), r AS (SELECT list_sort(list(m)) AS ms FROM m)
    SELECT round((SELECT avg(d) FROM x), 6) AS delta, round(ms[51], 6) AS lower, round(ms[1951], 6) AS upper, n AS pairs FROM r, n WHERE n >= 8""")
def bootstrap_ci(spark, sf):
    o = _outcomes(spark, sf)
    base = o.withColumn("reciprocal_rank", F.when(F.col("case_id").cast("int") % 2 == 0, F.col("reciprocal_rank") / 2).otherwise(F.col("reciprocal_rank")))
    return _rounded(stats.bootstrap(o, base, "reciprocal_rank", None)).withColumn("pairs", F.col("pairs").cast("long"))


@query("SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 IN (0, 4, 7) THEN 'holdout' ELSE 'development' END AS split FROM documents")
def stratified_split(spark, sf):
    return evaluate.stratified_split(_docs(spark, sf).select("doc_id", "source"), "source", "doc_id").select("doc_id", "split")


@query(r"""WITH q AS (SELECT item_id, regexp_replace(lower(text), '[ \t\n\v\f\r]+', '', 'g') AS s FROM benchmark), h AS (SELECT doc_id, regexp_replace(lower(text), '[ \t\n\v\f\r]+', '', 'g') AS s FROM documents)
    SELECT CAST(item_id AS VARCHAR) AS case_id, doc_id AS note_id FROM q JOIN h ON contains(h.s, q.s) WHERE length(q.s) >= 12""")
def leakage(spark, sf):
    c = M.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("query"))
    return evaluate.leakage(c, _docs(spark, sf).select(F.col("doc_id").alias("note_id"), "text"))


@query(r"""WITH s AS (SELECT item_id AS id, regexp_replace(lower(text), '[ \t\n\v\f\r]+', '', 'g') AS s FROM benchmark), g AS (SELECT DISTINCT id, substr(s, i::INT, 3) AS gram FROM (SELECT id, s, unnest(generate_series(1, length(s) - 2)) AS i FROM s)),
    l AS (SELECT id, list(gram ORDER BY gram) AS grams FROM g GROUP BY id), r AS (SELECT min(id) AS id, len(grams) AS n FROM l GROUP BY grams), n AS (SELECT id, n FROM r),
    m AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id AND x.id IN (SELECT id FROM r) AND y.id IN (SELECT id FROM r) GROUP BY 1, 2)
    SELECT a, b, round(m::DOUBLE / (p.n + q.n - m), 6) AS similarity FROM m JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE m::DOUBLE / (p.n + q.n - m) >= 0.2""")
def trigram_jaccard(spark, sf):
    q = M.read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    return _rounded(evaluate.trigram_similarity(q, 0.2))


@query(r"""WITH s AS (SELECT doc_id AS id, regexp_replace(lower(text), '[ \t\n\v\f\r]+', '', 'g') AS s FROM documents), g AS (SELECT DISTINCT id, substr(s, i::INT, 3) AS gram FROM (SELECT id, s, unnest(generate_series(1, greatest(length(s) - 2, 1))) AS i FROM s WHERE s <> '')),
    l AS (SELECT id, list(gram ORDER BY gram) AS grams FROM g GROUP BY id) SELECT id, min(id) OVER (PARTITION BY grams) AS rep FROM l""")
def trigram_classes(spark, sf):
    """Documents whose whole texts have the same trigrams are one class."""
    return evaluate.query_classes(_docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("query")))


@query("SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_text(spark, sf):
    return _docs(spark, sf).groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(f"WITH {CASES} SELECT case_id, x AS note_id FROM (SELECT case_id, unnest(expected) AS x FROM cases) WHERE substr(x, 2)::BIGINT % 2 = 1")
def dangling_cases(spark, sf):
    even = _docs(spark, sf).filter("doc_id % 2 = 0").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("note_id"))
    return evaluate.dangling(M.cases(spark, sf), even)


@query("SELECT sha256(string_agg(d, '' ORDER BY b)) AS checksum FROM (SELECT substr(d, 1, 4) AS b, sha256(string_agg(d, '' ORDER BY d)) AS d FROM (SELECT sha256(item_id || '|' || text) AS d FROM benchmark) GROUP BY 1)")
def dataset_checksum(spark, sf):
    return evaluate.checksum(M.read(spark, sf, "benchmark"), "item_id", "text")


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM documents), 6) AS share FROM documents GROUP BY lang
    UNION ALL SELECT 'source', source, count(*), round(count(*) / (SELECT count(*)::DOUBLE FROM documents), 6) FROM documents GROUP BY source""")
def quality_profile(spark, sf):
    return _rounded(evaluate.profile(_docs(spark, sf), ["lang", "source"]))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY event_type")
def failure_breakdown(spark, sf):
    return evaluate.failure_breakdown(M.read(spark, sf, "events").filter("event_id % 3 = 0"), "event_type")


@query(f"WITH {RESULTS} SELECT CASE WHEN count(*) FILTER (m) = 0 THEN 1.0 ELSE round(coalesce(avg(hit_at5::INT) FILTER (m AND expected_count <= 5), 0), 6) END AS regression_rate FROM (SELECT *, is_positive AND origin = 'regression' AND scope = 'in_scope' AS m FROM outcomes)")
def regression_rate(spark, sf):
    return _rounded(evaluate.regression_rate(_outcomes(spark, sf)))


@query(f"WITH {RESULTS}, a AS (SELECT scope AS arm, {METRICS} FROM outcomes GROUP BY scope) SELECT arm AS leader FROM a ORDER BY recall_at5 DESC, mrr DESC, arm LIMIT 1")
def experiment_leader(spark, sf):
    arms = _rounded(evaluate.metrics(_outcomes(spark, sf), ["scope"])).withColumnRenamed("scope", "arm")
    return evaluate.leader(arms)


@query(f"WITH {RESULTS} SELECT scope, count(*) AS cases, count(r.case_id) AS with_hit, round(count(r.case_id) / count(*)::DOUBLE, 6) AS share FROM cases LEFT JOIN (SELECT DISTINCT case_id FROM results) r USING (case_id) GROUP BY scope")
def keyword_participation(spark, sf):
    return _rounded(evaluate.participation(M.cases(spark, sf), _case_results(spark, sf)))


# Streams, in batch form


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS new, event_id FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id AS note_id, count(*) AS edits, min(ts) AS started, max(ts) + INTERVAL 600 SECOND AS flushed FROM s GROUP BY user_id, k""")
def session_debounce(spark, sf):
    return edits.debounce(M.read(spark, sf, "events").select(F.col("user_id").alias("note_id"), "ts"), "600 seconds")


@query("SELECT DISTINCT user_id::VARCHAR AS note_id, event_type AS block_id, (event_id % 3)::INT AS chunk_index, md5(event_type) AS content_hash, 'e1' AS embedding_version FROM events")
def job_dedup(spark, sf):
    jobs = M.read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("note_id"), F.col("event_type").alias("block_id"), (F.col("event_id") % 3).cast("int").alias("chunk_index"), F.md5("event_type").alias("content_hash"), F.lit("e1").alias("embedding_version"), "ts", "event_id"
    )
    return edits.deduplicate(jobs).select("note_id", "block_id", "chunk_index", "content_hash", "embedding_version")


def _last_sql(key: str, n: int) -> str:
    return f"SELECT {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(ts) DESC, lpad(event_id::VARCHAR, 12, '0')) AS place, lpad(event_id::VARCHAR, 12, '0') AS payload FROM events QUALIFY place <= {n}"


def _last(spark, sf, key, n):
    t = M.read(spark, sf, "events").select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("payload"))
    return edits.last_traces_by_batch(t, n).select("key", "place", "payload")


@query(_last_sql("user_id", 20))
def trace_last_n(spark, sf):
    return _last(spark, sf, "user_id", 20)


@query(_last_sql("event_type", 500))
def latency_samples(spark, sf):
    """The last 500 samples of each kind."""
    return _last(spark, sf, "event_type", 500)


@query("SELECT count(*) FILTER (event_type = 'view') AS views, count(*) AS total, count(DISTINCT user_id) AS users FROM events")
def volume_counts(spark, sf):
    return M.read(spark, sf, "events").agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("views"), F.count("*").alias("total"), F.countDistinct("user_id").alias("users"))


@query("""WITH h AS (SELECT item_id, sha256('0|' || text) || sha256('1|' || text) AS h FROM benchmark),
    r AS (SELECT item_id, [(('0x' || substr(h, 2 * i + 1, 2))::INT - 128) / 128.0::DOUBLE FOR i IN range(48)] AS v FROM h), n AS (SELECT item_id, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM r)
    SELECT item_id, array_to_string([printf('%.6f', x / n + 1e-12) FOR x IN v], ',') AS vector FROM n""")
def mock_embedding(spark, sf):
    v = vector.mock_vector(F.col("text"), 48)
    return M.read(spark, sf, "benchmark").select("item_id", F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x + 1e-12)), ",").alias("vector"))
