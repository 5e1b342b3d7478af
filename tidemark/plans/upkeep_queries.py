"""Queries over sources, stores, answers of services, notes and the evaluation set, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import graphemes as G
from ..functions import payload
from ..functions import text as T
from ..functions.segment import Policy
from ..operators import chunk as C
from ..operators import derive, diff, evaluate, gate, lexical, notes, present, scan
from ..sources import io
from ..streaming import edits
from . import mapping as M
from . import queries as Q
from .queries import query

_DOC = "'n' || doc_id"


_new_path = io.new_path


def _note(df: DataFrame) -> F.Column:
    return F.concat(F.lit("n"), F.col("doc_id").cast("string"))


def _docs(spark, sf):
    return M.read(spark, sf, "documents")


# Sources and sinks


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf):
    return io.point(io.table(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "source"]), "doc_id", 42)


_RECORDS = t.StructType([t.StructField(c, t.StringType()) for c in ("chunk_id", "note_id", "block_id", "content_hash", "embedding_version", "chunk_strategy")] + [t.StructField("created_at", t.IntegerType())])


def _store(spark, sf):
    """A store that had its records, then new ones for some chunks, and then lost some notes."""
    cur, stored = Q._stored(spark, sf)
    row = lambda df, at: df.select("chunk_id", "note_id", F.col("chunk_id").alias("block_id"), "content_hash", "embedding_version", F.lit("block").alias("chunk_strategy"), F.lit(at).alias("created_at"))
    store = io.DerivedStore(spark, _new_path(spark, "store"), _RECORDS, buckets=8)
    store.upsert(row(stored, 1))
    store.upsert(row(cur.filter(F.endswith("chunk_id", F.lit("3"))).withColumn("embedding_version", F.lit("e2")), 2))
    store.delete(cur.filter(F.endswith("note_id", F.lit("7"))).select("note_id").distinct(), "note_id")
    return store


_KEPT = Q._STORED + ", n AS (SELECT chunk_id, note_id, 'e2' AS v FROM cur WHERE ends_with(chunk_id, '3')), kept AS (SELECT * FROM (SELECT coalesce(n.chunk_id, st.chunk_id) AS chunk_id, coalesce(n.note_id, st.note_id) AS note_id, coalesce(n.v, st.v) AS v FROM st FULL JOIN n ON n.chunk_id = st.chunk_id) WHERE note_id NOT IN (SELECT note_id FROM cur WHERE ends_with(note_id, '7')))"


@query(f"WITH {_KEPT} SELECT chunk_id, note_id, v AS embedding_version FROM kept")
def derived_store(spark, sf):
    return _store(spark, sf).load().select("chunk_id", "note_id", "embedding_version")


@query(f"WITH {_KEPT} SELECT chunk_id FROM kept WHERE v = 'e2'")
def vector_index_load(spark, sf):
    return _store(spark, sf).load("e2").select("chunk_id")


@query(f"WITH {_KEPT} SELECT chunk_id, v AS embedding_version FROM kept WHERE note_id = 'c12'")
def derived_note_read(spark, sf):
    return _store(spark, sf).load(note_id="c12").select("chunk_id", "embedding_version")


@query(f"WITH {_KEPT} SELECT (SELECT count(*) FROM kept) AS chunks, (SELECT count(DISTINCT note_id) FROM kept) AS notes, (SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM kept WHERE chunk_id = 't-12-1') AS of_block")
def index_reads(spark, sf):
    store = _store(spark, sf)
    one = store.load().agg(F.count("*").alias("chunks")).join(F.broadcast(store.note_ids().agg(F.count("*").alias("notes"))))
    return one.join(F.broadcast(store.chunk_ids("t-12-1").agg(F.nullif(F.array_join(F.array_sort(F.collect_list("chunk_id")), ","), F.lit("")).alias("of_block"))))


@query(f"WITH {Q._STORED} SELECT 'chunk' AS by, chunk_id FROM st WHERE chunk_id NOT IN (SELECT chunk_id FROM cur WHERE ends_with(chunk_id, '1')) UNION ALL SELECT 'note', chunk_id FROM st WHERE note_id NOT IN (SELECT note_id FROM cur WHERE ends_with(note_id, '4'))")
def index_mutations(spark, sf):
    cur, stored = Q._stored(spark, sf)
    by_chunk = derive.remove(stored, cur.filter(F.endswith("chunk_id", F.lit("1"))), "chunk_id").select(F.lit("chunk").alias("by"), "chunk_id")
    return by_chunk.unionByName(derive.remove(stored, cur.filter(F.endswith("note_id", F.lit("4"))), "note_id").select(F.lit("note").alias("by"), "chunk_id"))


@query(f"WITH {Q._STORED}, gone AS (SELECT DISTINCT note_id FROM cur WHERE ends_with(note_id, '5')) SELECT 'embeddings' AS origin, count(*) AS n FROM st WHERE note_id NOT IN (SELECT note_id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM cur WHERE note_id NOT IN (SELECT note_id FROM gone)")
def delete_cascade(spark, sf):
    cur, stored = Q._stored(spark, sf)
    left = derive.cascade(cur.filter(F.endswith("note_id", F.lit("5"))), embeddings=stored, chunks=cur)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("origin"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


_OCR = f"""{Q.TEXTS}, o AS (SELECT t.block_id, CASE WHEN d.doc_id % 2 = 0 THEN t.content_hash ELSE 'old' END AS h, CASE WHEN d.doc_id % 3 = 0 THEN ' ' ELSE 'sign ' || d.doc_id END AS text FROM documents d JOIN texts t ON t.block_id = 'b' || d.doc_id WHERE d.doc_id % 5 = 2),
    j AS (SELECT t.*, CASE WHEN o.h = t.content_hash AND trim(o.text) <> '' THEN o.text END AS ocr FROM texts t LEFT JOIN o USING (block_id))"""


def _with_ocr(spark, sf):
    b = M.document_blocks(spark, sf)
    b = b.withColumn("content_hash", T.content_hash({c: F.col(c) for c in b.columns}))
    n = F.substring("block_id", 2, 20).cast("long")
    overlay = b.filter("kind = 'image'").select("note_id", "block_id", F.when(n % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"), F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("sign "), n.cast("string"))).alias("text"))
    return io.ocr_text(b, overlay)


@query(f"WITH {_OCR} SELECT block_id, ocr FROM j")
def ocr_overlay(spark, sf):
    return _with_ocr(spark, sf).select("block_id", "ocr")


@query(f"WITH {_OCR} SELECT block_id, sha256(CASE WHEN ocr IS NULL THEN text ELSE concat_ws(chr(10), nullif(text, ''), trim(ocr)) END) AS text_hash FROM j WHERE text <> '' OR ocr IS NOT NULL")
def resolved_text(spark, sf):
    """What of a block is searched: an image's caption and the text recognised in it."""
    b = _with_ocr(spark, sf)
    r = T.retrievable({c: F.col(c) for c in b.columns if c not in ("ocr", "content_hash")}, F.col("ocr"))
    return b.select("block_id", r.alias("r")).filter("r is not null").select("block_id", F.sha2("r.text", 256).alias("text_hash"))


def _dataset(spark, sf):
    """An evaluation set in sixteen files, one JSON object each, written and read again."""
    b = M.read(spark, sf, "benchmark")
    i = F.col("item_id")
    s = i.cast("string")
    candidate = F.struct(
        s.alias("id"), F.col("text").alias("query"), F.when(i % 3 == 1, F.array(F.concat(F.lit("n"), s), F.lit("m"))).alias("expectedNoteIDs"), F.when(i % 4 != 0, F.when(i % 4 == 1, "in_scope").otherwise("cross_language")).alias("scope"),
        F.when(i % 2 == 0, "fact").alias("category"), F.when(i % 5 == 0, "holdout").alias("split"), F.when(i % 3 == 0, F.create_map(F.concat(F.lit("z"), s), F.lit(3), F.lit("a"), F.lit(2), F.lit("low"), F.lit(1))).alias("relevance"), (i % 7 == 0).alias("isRegression"),
    )
    negative = F.struct(F.concat(F.lit("x"), s).alias("id"), F.lit("nothing").alias("query"), F.when(i % 5 == 1, "holdout").alias("split"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("item_id", c.alias("c")))), lambda x: x["c"])
    each = b.groupBy((i % 16).alias("part")).agg(F.lit("1").alias("version"), ordered(F.struct(F.concat(F.lit("n"), s).alias("id"), F.lit("t").alias("title"), F.col("text").alias("content"))).alias("notes"), ordered(F.to_json(candidate)).alias("c"), ordered(negative).alias("negatives"))
    schema = next(f.dataType.elementType for f in spark.createDataFrame([], io.DATASET).schema if f.name == "candidates")
    path = _new_path(spark, "dataset")
    io.write_json(each.withColumn("candidates", F.transform("c", lambda x: F.from_json(x, schema))).drop("c"), path, "part")
    return io.eval_dataset(spark, path)


_CASES = """c AS (SELECT item_id::VARCHAR AS case_id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'a,z' || item_id WHEN item_id % 3 = 1 THEN 'n' || item_id || ',m' ELSE '' END AS expected, CASE item_id % 4 WHEN 0 THEN 'in_scope' WHEN 1 THEN 'in_scope' ELSE 'cross_language' END AS scope,
    CASE WHEN item_id % 7 = 0 THEN 'regression' ELSE 'golden' END AS origin, CASE WHEN item_id % 5 = 0 THEN 'holdout' ELSE 'development' END AS split FROM benchmark
    UNION ALL SELECT 'x' || item_id, 'nothing', '', 'in_scope', 'golden', CASE WHEN item_id % 5 = 1 THEN 'holdout' ELSE 'development' END FROM benchmark)"""


@query(f"WITH {_CASES} SELECT case_id, query, expected, scope, origin, split FROM c")
def dataset_cases(spark, sf):
    """Graded labels count from 2 on; cases without a split belong to development."""
    return io.dataset_cases(_dataset(spark, sf)).select("case_id", "query", F.array_join("expected", ",").alias("expected"), "scope", "origin", "split")


@query(f"WITH {_CASES} SELECT case_id FROM c WHERE split = 'holdout'")
def dataset_holdout(spark, sf):
    return io.dataset_cases(_dataset(spark, sf), "holdout").select("case_id")


@query("""WITH n AS (SELECT item_id % 16 AS part, 'n' || item_id AS id, '{"content":' || to_json(text)::VARCHAR || ',"id":"n' || item_id || '","title":"t"}' AS note FROM benchmark)
    SELECT 'sha256:' || sha256('{"notes":[' || string_agg(note, ',' ORDER BY id) || '],"version":"1"}') AS checksum, count(*) AS notes FROM n GROUP BY part""")
def dataset_canonical(spark, sf):
    """The canonical checksum of each of the sixteen objects, of their notes and version."""
    d = _dataset(spark, sf).select("version", "checksum", "notes")
    return evaluate.dataset_checksum(d).select(F.col("computed").alias("checksum"), F.size("notes").cast("long").alias("notes"))


@query("SELECT 'n' || item_id AS id, sha256(text) AS content_hash FROM benchmark")
def dataset_notes(spark, sf):
    return io.dataset_notes(_dataset(spark, sf)).select("id", F.sha2("content", 256).alias("content_hash"))


@query("SELECT sha256(string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY item_id) || chr(10)) AS text_hash, 'txt' AS file_type, false AS extraction_unavailable FROM benchmark GROUP BY item_id % 16")
def document_import(spark, sf):
    """Sixteen text files, written by as many tasks as there are, and read back one row each."""
    path = _new_path(spark, "texts")
    lines = M.read(spark, sf, "benchmark").select((F.col("item_id") % 16).alias("part"), "item_id", F.regexp_replace("text", "\n", " ").alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "item_id").select("part", "value").write.partitionBy("part").text(path)
    return io.documents(spark, path).select(F.sha2("extracted_text", 256).alias("text_hash"), "file_type", "extraction_unavailable")


@query(Q._EXPORT)
def export_sink(spark, sf):
    """Exports as they are read back from their files."""
    b, path = M.conversation_blocks(spark, sf), _new_path(spark, "exports")
    io.write_exports(notes.export_text(b, Q._export_notes(b)), path)
    return spark.read.schema("note_id string, text string").json(path).select("note_id", F.sha2("text", 256).alias("text_hash"))


# Answers of services


@query("SELECT vec_id // 4 AS request, vec_id % 4 AS place, round(embedding[1]::DOUBLE, 5) AS first, len(embedding) AS dimension FROM embeddings WHERE (vec_id // 4) % 9 <> 0")
def embedding_answers(spark, sf):
    """Batches of four vectors, answered in another order, every ninth with a vector that is too short (and so refused)."""
    v = M.read(spark, sf, "embeddings").withColumn("request", F.floor(F.col("vec_id") / 4))
    item = F.struct((F.col("vec_id") % 4).cast("int").alias("index"), F.when((F.col("request") % 9 == 0) & (F.col("vec_id") % 4 == 1), F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"))
    body = v.groupBy("request").agg(F.to_json(F.struct(F.reverse(F.array_sort(F.collect_list(item))).alias("data"))).alias("body"))
    sent = v.groupBy("request").agg(F.count("*").alias("sent"))
    rows = body.join(sent, "request").select("request", F.posexplode(payload.embeddings_in_order(F.col("body"), 64, F.col("sent"))).alias("place", "v"))
    return rows.select("request", F.col("place").cast("long").alias("place"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"), F.size("v").cast("long").alias("dimension"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 97 WHEN 1 THEN event_id % 89 WHEN 2 THEN event_id % 83 END AS tokens FROM events""")
def embedding_usage(spark, sf):
    """The tokens that each answer says it took: as prompt or total tokens, in no whole number, or not at all."""
    e = F.col("event_id")
    n = lambda m: (e % m).cast("string")
    bodies = (
        F.concat(F.lit('{"usage":{"prompt_tokens":'), n(97), F.lit(',"total_tokens":1}}')), F.concat(F.lit('{"usage":{"prompt_tokens":null,"total_tokens":'), n(89), F.lit("}}")),
        F.concat(F.lit('{"data":[],"usage":{"total_tokens":'), n(83), F.lit("}}")), F.lit('{"usage":{"prompt_tokens":"7","total_tokens":7}}'), F.lit('{"usage":null}'),
    )
    return M.read(spark, sf, "events").select("event_id", payload.prompt_tokens(F.element_at(F.array(*bodies), (e % 5 + 1).cast("int"))).alias("tokens"))


def _answers(spark, sf):
    return _docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("n"))


def _one_of(n: int, *bodies: F.Column) -> F.Column:
    return F.element_at(F.array(*bodies), (F.col("doc_id") % n + 1).cast("int"))


def _c(*parts: str) -> F.Column:
    """The parts with the row's number between them."""
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [F.col("n"), F.lit(p)]
    return F.concat(*out)


@query(r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"id": ' || doc_id || ', "note": "a } \" { b", "in": {"k": ' || doc_id || '}}' WHEN 1 THEN '{"a":' || doc_id || '}' END AS object FROM documents""")
def json_object(spark, sf):
    body = _one_of(3, _c('Here it is:\n```json\n{"id": ', ', "note": "a } \\" { b", "in": {"k": ', '}}\n```\nand {"x": 1}'), _c('{"a":', '}'), _c("no object { in ", " \" here"))
    return _answers(spark, sf).select("doc_id", payload.json_object(body).alias("object"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text ' || doc_id WHEN 1 THEN 'a ' || doc_id || 'b' END AS content, CASE WHEN doc_id % 3 = 2 THEN 'busy ' || doc_id END AS error FROM documents""")
def chat_content(spark, sf):
    body = _one_of(3, _c('{"choices":[{"message":{"content":"text ', '"}}]}'), _c('{"choices":[{"message":{"content":[{"type":"text","text":"a ', '"},{"text":"b"},{"type":"image"}]}}]}'), _c('{"error":{"message":"busy ', '"}}'))
    return _answers(spark, sf).select("doc_id", payload.message_content(body).alias("content"), payload.service_error(body).alias("error"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 'x ' || doc_id ELSE '' END AS title, CASE doc_id % 5 WHEN 3 THEN 'one' WHEN 4 THEN 'a,' || doc_id ELSE '' END AS topics FROM documents""")
def defensive_fields(spark, sf):
    body = _one_of(5, _c('{"other":', '}'), F.lit('{"title":null,"topics":null}'), _c('{"title":', ',"topics":{"a":1}}'), _c('{"title":" x ', ' ","topics":" one "}'), _c('{"title":["x"],"topics":[" a ",""," ', ' "]}'))
    return _answers(spark, sf).select("doc_id", payload.text_field(body, "title").alias("title"), F.array_join(payload.list_field(body, "topics"), ",").alias("topics"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'said ' || doc_id END AS text, CASE doc_id % 4 WHEN 1 THEN 'too long' WHEN 0 THEN NULL ELSE 'invalid_response' END AS error,
    CASE doc_id % 4 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/m4a' WHEN 2 THEN 'audio/wav' ELSE 'application/octet-stream' END AS mime FROM documents""")
def transcript_answers(spark, sf):
    body = _one_of(4, _c('{"text":"  said ', '\\n"}'), F.lit('{"error":{"message":"too long"}}'), _c("oops ", ""), _c('{"text":', "}"))
    name = _one_of(4, _c("a", ".MP3"), _c("a.b", ".aac"), _c("", ".wav"), _c("a", ".xyz"))
    return _answers(spark, sf).select("doc_id", payload.transcript(body).alias("r"), payload.audio_type(name).alias("mime")).select("doc_id", "r.text", "r.error", "mime")


@query("SELECT item_id::VARCHAR AS chunk_id, length(text)::DOUBLE AS first, 1 AS tries FROM benchmark")
def embedding_jobs(spark, sf):
    jobs = M.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    return edits.run_jobs(jobs, lambda texts: [[float(len(x))] for x in texts]).select("chunk_id", F.get("vector", F.lit(0)).alias("first"), "tries")


@query("""SELECT item_id::VARCHAR AS chunk_id, CASE WHEN length(text) % 3 = 2 THEN length(text)::DOUBLE END AS first, CASE WHEN length(text) % 3 = 1 THEN 3 ELSE 1 END AS tries, CASE length(text) % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'ConnectionError' END AS error FROM benchmark""")
def embedding_failures(spark, sf):
    """A service that refuses some texts, which fail at once, and is never reached for others, which are tried three times."""

    def work(texts):
        n = len(texts[0])
        if n % 3 == 0:
            raise ValueError
        if n % 3 == 1:
            raise ConnectionError
        return [[float(n)]]

    jobs = M.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    return edits.run_jobs(jobs, work, wait=0.0, size=1).select("chunk_id", F.get("vector", F.lit(0)).alias("first"), "tries", "error")


# Text


@query(r"""SELECT doc_id, sha256(regexp_replace(replace(replace(strip_accents(lower('  ÀÇ ' || text || ' ＡＢ ')), 'ａｂ', 'ab'), '　', ' '), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')) AS text_hash FROM documents""")
def text_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.normalize(F.concat(F.lit("  ÀÇ "), "text", F.lit(" ＡＢ "))), 256).alias("text_hash"))


@query(r"""WITH l AS (SELECT unnest(string_split('# ' || source || chr(10) || '- ' || lang || chr(10) || '---' || chr(10) || text, chr(10))) AS line FROM documents), k AS (SELECT line, CASE WHEN regexp_matches(line, '^\s{0,3}#{1,6}\s+.*$') THEN 'heading'
    WHEN regexp_matches(regexp_replace(line, '^[ \t]+|[ \t]+$', '', 'g'), '^(-{3,}|\*{3,}|_{3,})$') THEN 'divider' WHEN regexp_matches(line, '^\s*[-*+]\s+.*$') THEN 'bullet' WHEN regexp_matches(line, '^\s*\d+[.)]\s+.*$') THEN 'ordered' ELSE 'text' END AS kind FROM l)
    SELECT kind, count(*) AS lines, sum(length(CASE kind WHEN 'heading' THEN regexp_extract(line, '^\s{0,3}#{1,6}\s+(.*)$', 1) WHEN 'divider' THEN '' WHEN 'bullet' THEN regexp_extract(line, '^\s*[-*+]\s+(.*)$', 1) WHEN 'ordered' THEN regexp_extract(line, '^\s*\d+[.)]\s+(.*)$', 1) ELSE line END))::BIGINT AS chars FROM k GROUP BY kind""")
def line_kinds(spark, sf):
    lines = _docs(spark, sf).select(F.explode(F.split(F.concat(F.lit("# "), "source", F.lit("\n- "), "lang", F.lit("\n---\n"), "text"), "\n")).alias("line"))
    return lines.select(T.line_kind(F.col("line")).alias("k")).groupBy("k.kind").agg(F.count("*").alias("lines"), F.sum(F.length("k.content")).alias("chars"))


_ENDS = ".!?;\\n。！？；…"
_SENTENCES = rf"""s AS (SELECT block_id, note_id, text, unnest(regexp_extract_all(text, '[^{_ENDS}]*[{_ENDS}]|[^{_ENDS}]+$')) AS sentence, generate_subscripts(regexp_extract_all(text, '[^{_ENDS}]*[{_ENDS}]|[^{_ENDS}]+$'), 1) AS i FROM texts WHERE length(text) > 0),
    u AS (SELECT block_id, sum(length(sentence)) OVER (PARTITION BY block_id ORDER BY i) AS upto FROM s),
    walk AS (SELECT block_id, 0::HUGEINT AS s, coalesce(max(upto) FILTER (upto <= 240), min(upto)) AS e, 0 AS step FROM u GROUP BY block_id
        UNION ALL SELECT w.block_id, any_value(w.e), coalesce(max(u.upto) FILTER (u.upto - w.e <= 240), min(u.upto)), any_value(w.step) + 1 FROM walk w JOIN u ON u.block_id = w.block_id AND u.upto > w.e GROUP BY w.block_id),
    p AS (SELECT w.*, note_id, {Q.TRIM.format("substr(text, (s + 1)::BIGINT, (e - s)::BIGINT)")} AS t FROM walk w JOIN texts USING (block_id))"""


@query(f"WITH RECURSIVE {Q.TEXTS}, {_SENTENCES} SELECT note_id || '/' || block_id || '/' || (row_number() OVER (PARTITION BY block_id ORDER BY step) - 1) AS chunk_id, sha256(t) AS text_hash, s::BIGINT AS char_start, e::BIGINT AS char_end FROM p WHERE t <> ''")
def chunk_sentence(spark, sf):
    c = C.chunk(M.texts(M.document_blocks(spark, sf)), "sentence", 240)
    return c.select("chunk_id", F.sha2("text", 256).alias("text_hash"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"WITH RECURSIVE {Q.CHUNKS} SELECT chunk_id, char_start, char_end FROM chunks")
def chunk_graphemes(spark, sf):
    """Texts with an accent after every e as a character of its own: cut where the plain texts are."""
    t = M.texts(M.document_blocks(spark, sf)).withColumn("text", F.replace("text", F.lit("e"), F.lit("e\u0301")))
    return C.chunk(t).select("chunk_id", "char_start", "char_end")


@query("SELECT doc_id, length_grapheme(t) AS graphemes, length(t) AS code_points, length_grapheme(text) AS place FROM (SELECT doc_id, text, text || '👩‍👩‍👧e' || chr(769) || '🇩🇪🇫🇷' AS t FROM documents)")
def grapheme_lengths(spark, sf):
    """Texts with a family, an accent and two flags after them."""
    d = _docs(spark, sf).withColumn("t", F.concat("text", F.lit("👩‍👩‍👧e\u0301🇩🇪🇫🇷")))
    place = G.grapheme_places(F.col("t"), F.array(F.length("text") + 2))
    return d.select("doc_id", G.grapheme_count(F.col("t")).cast("long").alias("graphemes"), F.length("t").cast("long").alias("code_points"), F.get(place, F.lit(0)).cast("long").alias("place"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 = 0")
def scope_unfiled(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("folder"), (F.col("doc_id") % 3 == 0).alias("is_pinned"), F.array().cast("array<string>").alias("tags"))
    return d.filter(notes.in_scope(notes.UNFILED, True)).select("doc_id")


_POLICIES = [(0.15, 3, True), (0.34, 1, False), (0.25, 2, True), (0.5, 2, False)]


def _swept(ratio: float, floor: int, latin: bool) -> str:
    sql = Q.HAN_RESULTS.replace("0.15::DOUBLE", f"{ratio}::DOUBLE").replace("greatest(3,", f"greatest({floor},")
    return sql if latin else sql.replace("WHEN query_id IN (SELECT query_id FROM latin) THEN 1", "WHEN false THEN 1")


@query(" UNION ALL ".join(f"SELECT {r}::DOUBLE AS ratio, {f} AS floor, {x} AS latin_relaxes, count(DISTINCT query_id) AS answered, count(*) AS hits FROM (WITH {_swept(r, f, x)} SELECT query_id FROM han WHERE rank <= 10)" for r, f, x in _POLICIES))
def segmentation_sweep(spark, sf):
    """How many queries with Han characters are answered, and by how much, under several rules of matching."""
    c, q = Q._han_parts(spark, sf)
    found = scan.scanned_policies(c, q, 10, [Policy(*p) for p in _POLICIES], digits=9, keep=())
    hits = found.groupBy("policy").agg(F.countDistinct("query_id").alias("answered"), F.count("*").alias("hits"))
    swept = spark.createDataFrame([(i, *p) for i, p in enumerate(_POLICIES)], "policy int, ratio double, floor int, latin_relaxes boolean")  # four rows
    none = F.lit(0).cast("long")
    return swept.join(hits, "policy", "left").select("ratio", "floor", "latin_relaxes", F.coalesce("answered", none).alias("answered"), F.coalesce("hits", none).alias("hits"))


# Notes


@query(f"""WITH b AS ({Q._CB}), n AS (SELECT DISTINCT note_id FROM b), f AS (SELECT note_id, bool_or(CASE WHEN kind = 'text' THEN false ELSE true END) AS media FROM b GROUP BY note_id)
    SELECT note_id, length(note_id) % 2 = 0 OR media OR ends_with(note_id, '3') AS meaningful, ends_with(note_id, '1') AND NOT (length(note_id) % 2 = 0 OR media OR ends_with(note_id, '3')) AS discarded FROM n JOIN f USING (note_id)""")
def draft_policy(spark, sf):
    """Notes whose text blocks were emptied: by title, by what other blocks hold, by recognised text; new ones without any go."""
    b = M.conversation_blocks(spark, sf).withColumn("text", F.lit(" \n"))
    n = b.select("note_id").distinct().select("note_id", F.when(F.length("note_id") % 2 == 0, "t").otherwise(" ").alias("title"), F.array(F.lit(" ")).alias("tags"))
    seen = n.filter(F.endswith("note_id", F.lit("3"))).select("note_id", F.lit("sign").alias("text"))
    new = F.endswith("note_id", F.lit("1"))
    return notes.meaningful_notes(b, n, seen).select("note_id", "meaningful", notes.discard_on_exit(new, F.col("meaningful")).alias("discarded"))


@query("""SELECT doc_id, concat_ws(chr(10), '标题:' || source, CASE WHEN doc_id % 2 = 0 THEN '一句话:about ' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN '主题:' || lang || '、b' END, CASE WHEN doc_id % 5 = 0 THEN '要点:' || chr(10) || '- ' || doc_id || chr(10) || '- y' END, '总结:s') AS summary FROM documents""")
def previous_summary(spark, sf):
    n, i = F.col("doc_id").cast("string"), F.col("doc_id")
    none = F.array().cast("array<string>")
    s = notes.previous_summary(F.col("source"), F.when(i % 2 == 0, F.concat(F.lit("about "), n)).otherwise(""), F.lit(None).cast("string"), F.when(i % 3 == 0, F.array("lang", F.lit("b"))).otherwise(none), F.when(i % 5 == 0, F.array(n, F.lit("y"))).otherwise(none), F.lit("s"))
    return _docs(spark, sf).select("doc_id", s.alias("summary"))


@query(f"SELECT {_DOC} AS note_id, CASE WHEN doc_id % 6 = 0 THEN '未知笔记（已删除）' ELSE source END AS title FROM documents")
def title_lookup(spark, sf):
    all_notes = _docs(spark, sf).select(_note(None).alias("note_id"), F.col("source").alias("title"), "doc_id")
    return notes.titles(all_notes.select("note_id"), all_notes.filter("doc_id % 6 <> 0"))


@query("SELECT doc_id, concat_ws('，', source, CASE doc_id % 3 WHEN 0 THEN '来自录音转写' WHEN 1 THEN '来自链接' END, CASE WHEN doc_id % 2 = 0 THEN 'found' END, 'today') AS label FROM documents")
def result_labels(spark, sf):
    source = F.element_at(F.array(*map(F.lit, ("transcript", "link", "text"))), (F.col("doc_id") % 3 + 1).cast("int"))
    label = present.accessibility_label(F.col("source"), source, F.when(F.col("doc_id") % 2 == 0, " found ").otherwise("  "), F.lit(""), F.lit("today"))
    return _docs(spark, sf).select("doc_id", label.alias("label"))


@query("SELECT event_id, CASE WHEN h <= 0 OR h <= 25 THEN NULL WHEN 50 - h <= 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, 10.0 / (50 - h))), 6) END AS target FROM (SELECT event_id, value * 3 AS h FROM events)")
def scroll_target(spark, sf):
    h = F.col("value") * 3
    return M.read(spark, sf, "events").select("event_id", F.round(present.scroll_target(h, F.lit(50.0), F.lit(10.0)), 6).alias("target"))


@query(f"""WITH b AS ({Q._CB}), {Q._CMD}, x AS (SELECT b.note_id, b.block_id, b.ord, b.kind, CASE b.kind WHEN 'text' THEN CASE WHEN plain <> '' THEN '【文字】' || chr(10) || plain END WHEN 'audio' THEN CASE WHEN t = '' THEN '【录音转写】(无转写文字)' ELSE '【录音转写】' || chr(10) || t END
        ELSE '【文档:system.txt · txt】' || chr(10) || CASE WHEN t = '' THEN '(未提取到文字)' WHEN length(t) > 8000 THEN substr(t, 1, 8000) || chr(10) || '…(文档过长,已截断)' ELSE t END END AS s FROM b LEFT JOIN md USING (block_id)),
    parts AS (SELECT note_id, CASE WHEN ord % 3 = 0 THEN 1 ELSE 2 END AS p, ord, '' AS id, CASE WHEN ord % 3 = 0 THEN '【新增】' ELSE '【修改】' END || chr(10) || s AS line FROM x WHERE ord % 3 < 2 AND s IS NOT NULL
        UNION ALL SELECT note_id, 3, 0, block_id, '【删除】' || CASE kind WHEN 'text' THEN '文字' WHEN 'audio' THEN '录音' ELSE '文档' END || ':was ' || block_id FROM x WHERE ord % 3 = 2)
    SELECT note_id, sha256(string_agg(line, chr(10) || chr(10) ORDER BY p, ord, id)) AS text_hash FROM parts GROUP BY note_id""")
def change_set_text(spark, sf):
    b = M.conversation_blocks(spark, sf)
    changed = b.filter("ord % 3 < 2").withColumn("change", F.when(F.col("ord") % 3 == 0, "added").otherwise("modified"))
    deleted = b.filter("ord % 3 = 2").select("note_id", "block_id", "kind", F.concat(F.lit("was "), "block_id").alias("brief"))
    return notes.change_set_text(changed, deleted).select("note_id", F.sha2("text", 256).alias("text_hash"))


@query(Q._DIFF + """, k AS (SELECT note_id FROM d WHERE change IS NOT NULL GROUP BY note_id HAVING bool_or(change = 'deleted' OR kind <> 'text') OR coalesce(sum(delta) FILTER (change <> 'deleted' AND kind = 'text'), 0) >= 12),
    f AS (SELECT note_id FROM now WHERE note_id NOT IN (SELECT note_id FROM old))
    SELECT note_id, block_id, h AS hash FROM old WHERE note_id NOT IN (SELECT note_id FROM k) UNION ALL SELECT note_id, block_id, h FROM now WHERE note_id IN (SELECT note_id FROM k UNION SELECT note_id FROM f)""")
def summary_snapshots(spark, sf):
    """The snapshots after a run of summaries: renewed only where the change was significant."""
    cur, old = Q._snapshots(spark, sf)
    found = diff.significance(diff.snapshot_diff(cur, old))
    return diff.next_snapshot(cur, old, found).select("note_id", "block_id", "hash")


# Derived data


@query(f"WITH {Q._STORED}, p AS (SELECT CASE WHEN cur.chunk_id IS NULL THEN 'orphan' WHEN st.h = cur.h AND st.v = 'e1' THEN 'up_to_date' ELSE 'pending' END AS state FROM cur FULL JOIN st ON cur.chunk_id = st.chunk_id) SELECT count(*) FILTER (state <> 'orphan') AS total, count(*) FILTER (state = 'pending') AS pending, (SELECT count(*) FROM cur WHERE ends_with(chunk_id, '6')) AS running FROM p")
def state_totals(spark, sf):
    cur, stored = Q._stored(spark, sf)
    return derive.state_totals(derive.work_plan(cur, stored, "e1"), cur.filter(F.endswith("chunk_id", F.lit("6"))))


@query(f"WITH {Q._CB.join(['b AS (', ')'])} SELECT note_id, block_id, NOT ends_with(note_id, '2') AS note_exists, CASE WHEN coalesce(raw, '') <> '' THEN {Q._CHASH} END AS current_hash FROM b")
def write_context(spark, sf):
    b = M.conversation_blocks(spark, sf)
    text = F.coalesce("text", "transcript", "extracted_text")
    rows = b.select("note_id", "block_id", text.alias("body"), T.content_hash({c: F.col(c) for c in b.columns}).alias("content_hash")).withColumnRenamed("body", "text")
    return derive.write_context(rows, rows.select("note_id").distinct().filter(~F.endswith("note_id", F.lit("2"))))


@query(f"""WITH f AS (SELECT {_DOC} AS note_id, doc_id % 97 = 0 OR doc_id % 5 = 3 AND doc_id % 3 = 0 OR regexp_matches(text, '[㐀-䶿一-鿿豈-﫿]') AS has_han, doc_id % 89 = 0 OR regexp_matches(source, '[A-Za-zÀ-ɏ]') OR regexp_matches(text, '[A-Za-zÀ-ɏ]') AS has_latin FROM documents) SELECT note_id, has_han, has_latin FROM f""")
def script_flags(spark, sf):
    """Over titles, tags, texts and text recognised in images."""
    i = F.col("doc_id")
    d = _docs(spark, sf).withColumn("note_id", _note(None))
    own = d.select("note_id", F.when(i % 97 == 0, "笔记").alias("user_title"), F.when(i % 89 == 0, "Note").alias("ai_title"), F.array("source").alias("tags"))
    seen = d.filter("doc_id % 5 = 3 and doc_id % 3 = 0").select("note_id", F.lit("招牌").alias("text"))
    return derive.script_flags(own, d.select("note_id", "text").unionByName(seen))


@query("""SELECT event_id, route, CASE WHEN route IN ('local_chinese', 'local_english') AND event_id % 13 <> 0 THEN route WHEN route = 'cloud' AND event_id % 17 <> 0 THEN 'cloud' END AS provider, route = 'local_english' AND han AS skips,
        event_id % 19 <> 0 AND cloud AND NOT consent AND han AND event_id % 2 = 1 AND route IN ('local_chinese', 'local_english') AS upgrade
    FROM (SELECT *, CASE WHEN cloud AND consent THEN 'cloud' WHEN han AND zh THEN 'local_chinese' WHEN NOT han AND en THEN 'local_english' WHEN cloud THEN 'cloud_needs_consent' ELSE 'unavailable' END AS route
    FROM (SELECT event_id, event_id % 4 < 2 AS han, event_id % 3 = 0 AS zh, event_id % 5 = 0 AS en, event_id % 7 < 3 AS cloud, event_id % 11 < 4 AS consent FROM events))""")
def provider_decision(spark, sf):
    e = F.col("event_id")
    han, cloud, consent = e % 4 < 2, e % 7 < 3, e % 11 < 4
    d = M.read(spark, sf, "events").select("event_id", derive.embed_route(han, e % 3 == 0, e % 5 == 0, cloud, consent).alias("route"))
    r = F.col("route")
    return d.select("event_id", "route", derive.provider(r, e % 13 != 0, e % 17 != 0).alias("provider"), derive.skip_semantic(r, han).alias("skips"), derive.offer_upgrade(r, cloud, consent, han, e % 2 == 1, e % 19 != 0).alias("upgrade"))


# The index of each user's events: views are pending, clicks running, errors its failure, purchases what is embedded already.
_USER_STATE = """u AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS running, count(*) FILTER (event_type = 'purchase') > 0 AS has, count(*) FILTER (event_type = 'error') > 2 AS down FROM events GROUP BY user_id),
    s AS (SELECT user_id, CASE WHEN down AND pending > 0 THEN 'failed' WHEN pending = 0 THEN 'ready' WHEN NOT has THEN 'building' WHEN running > 0 THEN 'rebuilding' ELSE 'stale' END AS state FROM u)"""


@query(f"WITH {_USER_STATE} SELECT user_id, state, state IN ('ready', 'rebuilding', 'stale') AS vector, true AS keyword FROM s")
def allowed_arms(spark, sf):
    """Which searches the index of each user allows, by the state that its counts give."""
    is_ = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    u = M.read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"), is_("view").alias("pending"), is_("click").alias("running"), (is_("purchase") > 0).alias("has"), F.when(is_("error") > 2, "down").alias("failure"))
    c = F.col
    s = u.select("user_id", derive.index_state(c("total"), c("pending"), c("running"), c("has"), c("failure"))["state"].alias("state"))
    return s.select("user_id", "state", derive.allows_vector(c("state")).alias("vector"), derive.allows_keyword(c("state")).alias("keyword"))


_LOG = """log AS (SELECT epoch_us(ts) // 1000000 AS moment, user_id AS job_key, CASE event_type WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'attempt' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'retried' END AS event FROM events)"""


@query(f"""WITH {_LOG}, began AS (SELECT job_key, min(moment) AS moment FROM log WHERE event = 'attempt' GROUP BY job_key), ended AS (SELECT job_key, max(moment) AS moment FROM log WHERE event IN ('succeeded', 'failed', 'cancelled') AND job_key IN (SELECT job_key FROM began) GROUP BY job_key),
    s AS (SELECT moment, sum(step) AS step FROM (SELECT moment, 1 AS step FROM began UNION ALL SELECT moment, -1 FROM ended) GROUP BY moment), p AS (SELECT max(r) AS peak FROM (SELECT sum(step) OVER (ORDER BY moment) AS r FROM s))
    SELECT count(*) FILTER (event = 'submitted') AS submitted, count(*) FILTER (event = 'deduplicated') AS deduplicated, count(*) FILTER (event = 'attempt') AS attempt, count(*) FILTER (event = 'succeeded') AS succeeded, count(*) FILTER (event = 'failed') AS failed,
        count(*) FILTER (event = 'cancelled') AS cancelled, count(*) FILTER (event = 'retried') AS retried, coalesce((SELECT peak FROM p), 0)::BIGINT AS peak FROM log""")
def job_statistics(spark, sf):
    kind = F.when(F.col("event_type") == "view", "submitted").when(F.col("event_type") == "click", "attempt").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("retried")
    log = M.read(spark, sf, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("user_id").alias("job_key"), kind.alias("event"))
    return derive.job_statistics(log)


# Evaluation


@query("SELECT source AS cluster, count(*) AS n, count(*) > 5 AS beyond FROM documents WHERE source IS NOT NULL GROUP BY source")
def cluster_sizes(spark, sf):
    return evaluate.clusters(_docs(spark, sf), "source")


@query("SELECT sha256(text) AS value, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_queries(spark, sf):
    """Texts that are asked more than once, each by its hash."""
    return evaluate.duplicates(_docs(spark, sf), "text").withColumn("value", F.sha2("value", 256))


@query("SELECT coalesce(sum(event_id % 100) FILTER (event_type = 'view'), 0)::BIGINT AS tokens, count(*) FILTER (event_type = 'view') AS reported_calls, count(*) FILTER (event_type <> 'view') AS unreported_calls FROM events")
def token_totals(spark, sf):
    return evaluate.token_totals(M.read(spark, sf, "events").select(F.when(F.col("event_type") == "view", F.col("event_id") % 100).alias("prompt_tokens")))


@query("SELECT lang, count(DISTINCT split) AS splits FROM (SELECT lang, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 IN (0, 4, 7) THEN 'holdout' ELSE 'development' END AS split FROM documents) GROUP BY lang HAVING count(DISTINCT split) > 1")
def split_overlap(spark, sf):
    s = evaluate.stratified_split(_docs(spark, sf).select("doc_id", "source", "lang"), "source", "doc_id")
    return evaluate.split_overlap(s, "lang")


@query("SELECT query, string_agg(e, ',' ORDER BY e) AS expected FROM (SELECT DISTINCT trim(text) AS query, item_id % 2 AS k, unnest(['a', 'b' || item_id % 2]) AS e FROM benchmark) GROUP BY query, k")
def cases_added(spark, sf):
    """Cases of the first half of the items, then all of them with padded queries and the labels turned round: none is there twice."""
    i = F.col("item_id") % 2
    label = F.concat(F.lit("b"), i.cast("string"))
    b = M.read(spark, sf, "benchmark").withColumn("query", T.trim(F.col("text")))
    have = b.filter("item_id % 2 = 0").select(F.col("item_id").cast("string").alias("case_id"), "query", F.array(F.lit("a"), label).alias("expected"))
    have = have.dropDuplicates(["query", "expected"])
    new = b.select(F.concat(F.lit("x"), F.col("item_id").cast("string")).alias("case_id"), F.concat(F.lit(" "), "query", F.lit("\n")).alias("query"), F.array(label, F.lit("a")).alias("expected"))
    return evaluate.add_cases(have, new).select(T.trim(F.col("query")).alias("query"), F.array_join(F.array_sort("expected"), ",").alias("expected"))


# A current run, and as baseline the same with one metric higher than it can reach, or all of them lower.
_GATE = f"""{Q.RESULTS}, {Q._LAT}, m AS (SELECT {Q.METRICS} FROM outcomes), l AS (SELECT p50, p95 FROM lat WHERE event_type = 'view'),
    r AS (SELECT CASE WHEN count(*) FILTER (m) = 0 THEN 1.0 ELSE round(coalesce(avg(hit_at5::INT) FILTER (m AND expected_count <= 5), 0), 6) END AS rate FROM (SELECT *, is_positive AND origin = 'regression' AND scope = 'in_scope' AS m FROM outcomes)),
    k AS (SELECT 'raised' AS baseline, 0.2 AS up UNION ALL SELECT 'lowered', -0.1),
    c AS (SELECT baseline, unnest([{{'check': 'recall', 'passed': recall_at1 >= recall_at1 + up - 1e-9 AND recall_at5 >= recall_at5 + up - 1e-9, 'actual': recall_at1::DOUBLE}}, {{'check': 'mrr', 'passed': mrr >= mrr + up - 0.01 - 1e-9, 'actual': mrr::DOUBLE}},
        {{'check': 'floor', 'passed': recall_at1 >= 0.35 - 1e-9 AND recall_at5 >= 0.40 - 1e-9 AND mrr >= 0.38 - 1e-9, 'actual': recall_at1::DOUBLE}}, {{'check': 'latency', 'passed': p50 <= 100 AND p95 <= 250, 'actual': p95}},
        {{'check': 'regression', 'passed': rate >= 1 - 1e-9, 'actual': rate::DOUBLE}}], recursive := true) FROM m, l, r, k)"""


def _checks(spark, sf):
    of = Q._outcomes(spark, sf)
    p = evaluate.group_percentiles(M.read(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).filter("event_type = 'view'").select("p50", "p95")
    now = Q._rounded(evaluate.metrics(of)).join(F.broadcast(p)).join(F.broadcast(Q._rounded(evaluate.regression_rate(of))))
    base = lambda up: now.withColumns({c: F.col(c) + up for c in ("recall_at1", "recall_at5", "mrr")})
    return {name: gate.checks(now, base(up)) for name, up in (("raised", 0.2), ("lowered", -0.1))}


@query(f'WITH {_GATE} SELECT baseline, "check", passed, round(actual, 6) AS actual FROM c')
def gate_checks(spark, sf):
    found = _checks(spark, sf)
    parts = [df.select(F.lit(name).alias("baseline"), "check", "passed", F.round("actual", 6).alias("actual")) for name, df in found.items()]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {_GATE} SELECT baseline, CASE WHEN bool_and(passed) THEN 'pass' ELSE 'blocked' END AS status, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (NOT passed), '') AS reason FROM c GROUP BY baseline""")
def gate_verdict(spark, sf):
    parts = [gate.verdict(df).withColumn("baseline", F.lit(name)) for name, df in _checks(spark, sf).items()]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {Q._LAT}, m AS (SELECT CASE event_type WHEN 'view' THEN 'first_result' WHEN 'click' THEN 'semantic_local' ELSE 'semantic_cloud' END AS layer, event_type, p50 * 10 AS p50, p95 * 10 AS p95 FROM lat)
    SELECT event_type, layer, CASE layer WHEN 'first_result' THEN p50 <= 100 AND p95 <= 250 WHEN 'semantic_local' THEN p95 <= 250 END AS passed FROM m""")
def latency_gate(spark, sf):
    p = evaluate.group_percentiles(M.read(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    layer = F.when(F.col("event_type") == "view", "first_result").when(F.col("event_type") == "click", "semantic_local").otherwise("semantic_cloud")
    return gate.latency_checks(p.select("event_type", layer.alias("layer"), (F.col("p50") * 10).alias("p50"), (F.col("p95") * 10).alias("p95"))).select("event_type", "layer", "passed")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'build configuration' WHEN event_id % 3 = 0 THEN 'device class' WHEN event_id % 5 = 0 THEN 'low-power mode' WHEN event_id % 7 = 0 THEN 'thermal state' WHEN event_id % 11 = 0 THEN 'region' END AS reason FROM events""")
def measuring_environment(spark, sf):
    e = F.col("event_id")
    r = gate.disqualification(F.when(e % 2 != 0, "release"), F.when(e % 3 == 0, "simulator").otherwise("physical"), e % 5 == 0, F.when(e % 7 == 0, "fair").otherwise("nominal"), F.when(e % 11 != 0, "here"), needs_region="here")
    return M.read(spark, sf, "events").select("event_id", r.alias("reason"))


@query(f"""WITH {Q._STORED}, o AS (SELECT DISTINCT note_id FROM st WHERE note_id NOT IN (SELECT note_id FROM cur)), s AS (SELECT * FROM st WHERE note_id NOT IN (SELECT note_id FROM o))
    SELECT coalesce(cur.chunk_id, s.chunk_id) AS chunk_id, CASE WHEN cur.chunk_id IS NULL THEN 'orphan' WHEN s.h = cur.h AND s.v = 'e1' THEN 'up_to_date' ELSE 'pending' END AS state FROM cur FULL JOIN s ON cur.chunk_id = s.chunk_id""")
def startup_plan(spark, sf):
    """Load, reconcile, scan: the plan no longer holds the orphans of notes that are gone."""
    cur, stored = Q._stored(spark, sf)
    row = stored.select("chunk_id", "note_id", F.col("chunk_id").alias("block_id"), "content_hash", "embedding_version", F.lit("block").alias("chunk_strategy"), F.lit(1).alias("created_at"))
    store = io.DerivedStore(spark, _new_path(spark, "store"), _RECORDS, buckets=8)
    store.upsert(row)
    return derive.start(store.load, cur.select("note_id").distinct(), lambda gone: store.delete(gone, "note_id"), lambda left: derive.work_plan(cur, left, "e1"))


def _rebuilt(spark, sf, chunks, version, clear):
    """The store after the library was indexed anew, from records of the old strategy and provider."""
    cur, stored = Q._stored(spark, sf)
    row = lambda df, strategy, at: df.select("chunk_id", "note_id", F.col("chunk_id").alias("block_id"), "content_hash", "embedding_version", strategy.alias("chunk_strategy"), F.lit(at).alias("created_at"))
    store = io.DerivedStore(spark, _new_path(spark, "store"), _RECORDS)
    store.upsert(row(stored, F.lit("block"), 1))
    embed = lambda pending: row(pending.withColumn("embedding_version", F.lit(version)), F.col("strategy"), 2)
    derive.bring_up(chunks(cur), store.load, store.delete, embed, store.upsert, version, store.clear if clear else None)
    return store.load().select("chunk_id", "note_id", "embedding_version", "chunk_strategy", "created_at")


@query(f"WITH {Q._STORED} SELECT chunk_id || '/0' AS chunk_id, note_id, 'e1' AS embedding_version, 'fixed-240-40' AS chunk_strategy, 2 AS created_at FROM cur")
def strategy_change(spark, sf):
    """Another way of chunking: no record of the old one is left, and every new chunk has one."""
    return _rebuilt(spark, sf, lambda cur: cur.withColumns({"chunk_id": F.concat("chunk_id", F.lit("/0")), "strategy": F.lit("fixed-240-40")}), "e1", False)


@query(f"WITH {Q._STORED} SELECT chunk_id, note_id, 'e3' AS embedding_version, 'block' AS chunk_strategy, 2 AS created_at FROM cur")
def provider_change(spark, sf):
    """Another provider: all records go at once, and every chunk is embedded again."""
    return _rebuilt(spark, sf, lambda cur: cur, "e3", True)
