import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import payload, segment
from tidemark.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, folded",
    [("ÀÉîõü", "aeiou"), ("ＡＢＣ１２", "abc12"), ("Straße", "straße"), ("é", "é"), ("组会", "组会"), ("", "")],
)
def test_fold_keeps_length(spark, raw, folded):
    assert one(spark, T.haystack(F.col("t")), t=raw) == folded
    assert T.fold_text(raw) == folded


def test_groups_of_mixed_scripts():
    g = segment.groups("组会改到周四")
    assert g == [segment.Group(("组会", "会改", "改到", "到周", "周四"), 3, True)]
    relaxed = segment.groups("CS5330作业几号截止")
    assert relaxed[0].min_matched == 1 and relaxed[-1] == segment.Group(("cs5330",), 1, False)
    assert segment.groups("one two")[0].min_matched == 2
    assert segment.groups("one two three four five")[0].min_matched == 3
    assert segment.groups("One one ONE")[0] == segment.Group(("one",), 1, False)
    assert segment.groups("谁") == [segment.Group(("谁",), 1, False)]
    assert segment.groups("谁 钱") == [] and segment.groups("  ") == []
    # A full-width comma is a run of its own that isn't Han: a mandatory term that relaxes the pairs.
    assert segment.groups("你好，世界")[-1].terms == (",",) and segment.groups("你好，世界")[0].min_matched == 1
    assert segment.groups("人人人人")[0].terms == ("人人",)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 组会,，", max_size=12))
def test_groups_are_satisfiable(query):
    for g in segment.groups(query):
        assert 1 <= g.min_matched <= len(g.terms) == len(set(g.terms))


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("# Title\n\n\n\n- **bold** and *it*\n1. [a](http://b) `c` ~~d~~\n---\nend", "Title\n\nbold and it\na c d\nend"),
        ("__x__ _y_", "x y"), ("***", ""), ("  plain  ", "plain"), ("####### seven", "####### seven"), (None, ""),
    ],
)
def test_markdown(spark, raw, plain):
    assert one(spark, T.markdown_plain(F.col("t")), t=raw) == plain


def test_formatting_and_lines(spark):
    marked = ["# a", "- a", "2) a", "**a**", "*a*", "[a](b)", "---"]
    assert all(one(spark, T.has_formatting(F.col("t")), t=m) for m in marked)
    assert not any(one(spark, T.has_formatting(F.col("t")), t=m) for m in ["a", "a * b * c", "--", "", None])
    assert tuple(one(spark, T.line_kind(F.col("t")), t="## Head")) == ("heading", 2, "Head")
    assert tuple(one(spark, T.line_kind(F.col("t")), t="12. item")) == ("ordered", 12, "item")
    assert tuple(one(spark, T.line_kind(F.col("t")), t="* item"))[0] == "bullet"


def test_scripts_and_gate(spark):
    gate = lambda q: one(spark, T.runs_semantic(F.col("t")), t=q)
    assert [gate(q) for q in ("延期", "延", "ab", "abc", "a延", " ", "かな", None)] == [True, False, False, True, False, False, True, False]
    assert one(spark, T.has_han(F.col("t")), t="ab延") and not one(spark, T.has_han(F.col("t")), t="かな")
    assert one(spark, T.has_latin(F.col("t")), t="é") and not one(spark, T.has_latin(F.col("t")), t="延1")


def test_hash_ignores_place_and_counts_ocr(spark):
    columns = ("kind", "text", "image_caption", "image_asset_ref", "transcript", "audio_asset_ref", "file_name", "file_type", "extracted_text", "url", "link_title", "link_description", "ocr")
    df = spark.createDataFrame([tuple("image" if c == "kind" else ("r" if c == "image_asset_ref" else None) for c in columns)], ", ".join(f"{c} string" for c in columns)).withColumn("extraction_unavailable", F.lit(None).cast("boolean"))
    b = {c: F.col(c) for c in df.columns}
    plain, blank, with_ocr = (df.withColumn("ocr", F.lit(v).cast("string")).select(T.content_hash(b, F.col("ocr")).alias("h")).first().h for v in (None, " \n", "sign"))
    import hashlib

    assert plain == blank == hashlib.sha256(b"v2|image|ref=r|caption=").hexdigest()
    assert with_ocr == hashlib.sha256(b"v2|image|ref=r|caption=|ocr=sign").hexdigest()
    assert df.select(T.retrievable(b).alias("r")).first().r is None
    assert tuple(df.withColumn("ocr", F.lit("sign")).select(T.retrievable(b, F.col("ocr")).alias("r")).first().r) == ("ocr", "sign")


def test_payloads(spark):
    assert payload.first_object('x ```json\n{"a": "}{", "b": {"c": "\\""}} tail {') == '{"a": "}{", "b": {"c": "\\""}}'
    assert payload.first_object("{ open") is None and payload.first_object(None) is None
    get = lambda c, body: one(spark, c, t=body)
    assert get(payload.message_content(F.col("t")), '{"choices":[{"message":{"content":"hi"}}]}') == "hi"
    assert get(payload.message_content(F.col("t")), '{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}') == "ab"
    assert get(payload.list_field(F.col("t"), "k"), '{"k":[" a ","",  "b"]}') == ["a", "b"]
    assert get(payload.list_field(F.col("t"), "k"), '{"k":"a"}') == ["a"]
    assert get(payload.list_field(F.col("t"), "k"), "no json") == []
    assert get(payload.text_field(F.col("t"), "k"), '{"k":5}') == "" and get(payload.text_field(F.col("t"), "k"), '{"k":" x "}') == "x"
    assert get(payload.embeddings_in_order(F.col("t"), 2), '{"data":[{"index":1,"embedding":[3,4]},{"index":0,"embedding":[1,2]}]}') == [[1.0, 2.0], [3.0, 4.0]]
    assert get(payload.embeddings_in_order(F.col("t"), 3), '{"data":[{"index":0,"embedding":[1,2]}]}') is None
    assert get(payload.audio_type(F.col("t")), "a.b.MP3") == "audio/mpeg"


CLUSTERED = ["", "plain text.", "e\u0301a\u0300\u0323", "👩‍👩‍👧👍🏽", "🇩🇪🇫🇷🇪", "a\r\nb\rc", "각각", "नमस्ते", "周四👨‍👩‍👦。改", "x" * 30 + "e\u0301. " * 20, "©️1️⃣"]


def test_graphemes(spark):
    from tidemark.functions import graphemes as G

    by_hand = {"e\u0301a\u0300\u0323": 2, "👩‍👩‍👧👍🏽": 2, "🇩🇪🇫🇷🇪": 3, "a\r\nb\rc": 5, "plain text.": 11, "©️1️⃣": 2, "각각": 2}
    for t in CLUSTERED:
        parts = G.clusters(t)
        assert "".join(parts) == t and G.edges(t).tolist() == [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        assert len(parts) == by_hand.get(t, len(parts))
        assert not G.is_simple(t) or parts == list(t) == __import__("regex").findall(r"\X", t)
    # Every range stands alone: next to itself and to a letter.
    for a, b in G.ALONE:
        for c in {a, b, (a + b) // 2}:
            t = f"a{chr(c)}{chr(c)}b"
            assert __import__("regex").findall(r"\X", t) == list(t), hex(c)
    df = spark.createDataFrame([(t, list(range(len(t) + 1))) for t in CLUSTERED] + [(None, [0])], "t string, p array<int>")
    rows = df.select("t", G.grapheme_count(F.col("t")).alias("n"), G.grapheme_places(F.col("t"), F.col("p")).alias("p")).collect()
    for r in rows:
        if r.t is None:
            assert (r.n, r.p) == (None, None)
            continue
        parts = G.clusters(r.t)
        assert r.n == len(parts) and r.p == [i for i, x in enumerate(parts) for _ in x] + [len(parts)]


def test_chunks_by_grapheme(spark):
    from test_operators import plain_fixed
    from tidemark.functions.graphemes import clusters
    from tidemark.operators.chunk import fixed_chunks

    texts = [t * 7 + ". " + t for t in CLUSTERED]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in fixed_chunks(df, 12, 3, "t").orderBy("i", "chunk_index").collect():
        got.setdefault(r.i, []).append((r.s, r.e, r.t))
    for i, t in enumerate(texts):
        parts = clusters(t)
        want = [(s, e, "".join(parts[s:e]).strip(" \t\n\v\f\r")) for s, e in plain_fixed(parts, 12, 3)]
        assert got.get(i, []) == [w for w in want if w[2]]
