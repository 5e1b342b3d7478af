"""Notes and their blocks: lists, titles, tags, emptiness, aggregation and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import markdown_plain, normalize, trim

# Kinds in their order, units and section labels.
KINDS = ("text", "image", "audio", "file", "link")
KIND_UNIT = {"text": "段文字", "image": "张图片", "audio": "段录音", "file": "个文档", "link": "个链接"}
DOCUMENT_CHARS, LINE_CHARS, EXPORT_CHARS, PREVIEW_CHARS = 8000, 80, 500, 60
UNTITLED = "未命名笔记"
NO_TEXT = "（无可检索文本）"
GONE = "未知笔记（已删除）"
BLOCK_LABEL = {"text": "文字", "image": "图片", "audio": "录音", "file": "文档", "link": "链接"}


def _clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def cols(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def note_order(df: DataFrame) -> DataFrame:
    """Pinned first, then the latest; ids part ties."""
    return df.orderBy(F.desc("is_pinned"), F.desc("updated_at"), "note_id")


def display_title(user: Column, ai: Column, fallback: str = UNTITLED) -> Column:
    return F.coalesce(F.nullif(trim(user), F.lit("")), F.nullif(trim(ai), F.lit("")), F.lit(fallback))


def empty_block(b: dict[str, Column]) -> Column:
    asset = {"image": "image_asset_ref", "audio": "audio_asset_ref", "file": "file_name", "link": "url"}
    out = markdown_plain(b["text"]) == ""
    for kind, column in asset.items():
        out = F.when(b["kind"] == kind, F.coalesce(b[column], F.lit("")) == "").otherwise(out)
    return out


def kind_counts(blocks: DataFrame) -> DataFrame:
    """Rows (note_id, kinds): counts of the blocks that aren't empty, by kind in fixed order; notes of empty blocks have null."""
    used = blocks.withColumn("used", ~empty_block(cols(blocks)))
    counts = used.groupBy("note_id").agg(*[F.sum(F.when(F.col("used") & (F.col("kind") == k), 1).otherwise(0)).alias(k) for k in KINDS])
    parts = [F.when(F.col(k) > 0, F.concat_ws(" ", F.col(k).cast("string"), F.lit(KIND_UNIT[k]))) for k in KINDS]
    return counts.select("note_id", F.nullif(F.concat_ws(" · ", *parts), F.lit("")).alias("kinds"))


def secondary_line(blocks: DataFrame, one_liners: DataFrame) -> DataFrame:
    """Rows (note_id, line): the one-liner, else the first line of the first text block that has one, else the kinds."""
    some = blocks.filter("kind = 'text'").withColumn("line", trim(F.try_element_at(F.filter(F.split(markdown_plain(F.col("text")), "\n"), lambda x: x != ""), F.lit(1)))).filter("line <> ''")
    first = some.groupBy("note_id").agg(F.min_by("line", "ord").alias("first"))
    joined = kind_counts(blocks).join(first, "note_id", "left").join(one_liners, "note_id", "left")
    return joined.select("note_id", F.coalesce(_clip(F.nullif(trim(F.col("one_liner")), F.lit("")), LINE_CHARS), _clip(F.col("first"), LINE_CHARS), "kinds").alias("line"))


def empty_notes(blocks: DataFrame) -> DataFrame:
    """Ids of notes all of whose blocks are empty: the drafts to sweep."""
    return blocks.groupBy("note_id").agg(F.bool_and(empty_block(cols(blocks))).alias("e")).filter("e").select("note_id")


def meaningful_notes(blocks: DataFrame, notes: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """Rows (note_id, meaningful): a title, a tag, a block that isn't empty, or derived text; ``notes``: note_id, title, tags; ``derived``: note_id, text."""
    some = blocks.groupBy("note_id").agg(F.bool_or(~empty_block(cols(blocks))).alias("has_block"))
    out = notes.join(some, "note_id", "left")
    if derived is not None:
        out = out.join(derived.groupBy("note_id").agg(F.bool_or(trim(F.col("text")) != "").alias("has_derived")), "note_id", "left")
    own = (trim(F.col("title")) != "") | F.coalesce(F.exists("tags", lambda t: trim(t) != ""), F.lit(False))
    return out.select("note_id", (own | F.coalesce("has_block", F.lit(False)) | (F.coalesce("has_derived", F.lit(False)) if derived is not None else F.lit(False))).alias("meaningful"))


def discard_on_exit(is_new: Column, meaningful: Column) -> Column:
    """Only a new draft without content goes; a note that was emptied stays."""
    return is_new & ~meaningful


def section(b: dict[str, Column]) -> Column:
    """A block as a labelled section of text; null for blocks that have none."""
    t = {k: trim(v) for k, v in b.items() if k not in ("kind", "extraction_unavailable")}
    lit = F.lit
    text = F.when(markdown_plain(b["text"]) != "", F.concat(lit("【文字】\n"), markdown_plain(b["text"])))
    audio = F.when(t["transcript"] == "", "【录音转写】(无转写文字)").otherwise(F.concat(lit("【录音转写】\n"), t["transcript"]))
    kind = F.when(t["file_type"] == "", "").otherwise(F.concat(lit(" · "), t["file_type"]))
    header = F.concat(lit("【文档:"), F.when(t["file_name"] == "", "未命名").otherwise(t["file_name"]), kind, lit("】"))
    body = F.when(F.length(t["extracted_text"]) > DOCUMENT_CHARS, F.concat(F.substring(t["extracted_text"], 1, DOCUMENT_CHARS), lit("\n…(文档过长,已截断)"))).otherwise(t["extracted_text"])
    file = F.concat(header, lit("\n"), F.when(F.coalesce(b["extraction_unavailable"], lit(False)), "(该文档类型暂不支持提取文字)").when(t["extracted_text"] == "", "(未提取到文字)").otherwise(body))
    part = lambda label, c: F.when(c != "", F.concat(lit(label), c))
    link = F.when(t["url"] != "", F.concat_ws("\n", lit("【链接】"), part("网址:", t["url"]), part("标题:", t["link_title"]), part("描述:", t["link_description"])))
    image = F.when(t["image_caption"] == "", "【图片】(见所附图片)").otherwise(F.concat(lit("【图片说明】"), t["image_caption"]))
    out = lit(None).cast("string")
    for k, v in (("text", text), ("audio", audio), ("file", file), ("link", link), ("image", image)):
        out = F.when(b["kind"] == k, v).otherwise(out)
    return out


def _ordered(column: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("ord", column)))), lambda x: x[column]), sep)


def aggregate_text(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows (note_id, text): title and labelled sections of a note in order, parted by blank lines."""
    made = blocks.withColumn("s", section(cols(blocks))).groupBy("note_id").agg(_ordered("s", "\n\n").alias("body"))
    head = F.when(trim(F.col("title")) != "", F.concat(F.lit("【标题】"), trim(F.col("title"))))
    return made.join(titles, "note_id", "left").select("note_id", F.concat_ws("\n\n", head, F.nullif("body", F.lit(""))).alias("text"))


def change_set_text(changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows (note_id, text): what was added, then modified, each in order of the blocks, then deleted.

    ``changed``: a block's columns with ``change``; ``deleted``: note_id, block_id, kind and brief.
    """
    mark = F.when(F.col("change") == "added", "【新增】\n").otherwise("【修改】\n")
    made = changed.withColumn("s", section(cols(changed))).filter("s is not null").select("note_id", F.when(F.col("change") == "added", 1).otherwise(2).alias("place"), "ord", F.lit("").alias("id"), F.concat(mark, "s").alias("line"))
    gone = deleted.select("note_id", F.lit(3).alias("place"), F.lit(0).alias("ord"), F.col("block_id").alias("id"), F.concat(F.lit("【删除】"), _by_kind(F.col("kind"), BLOCK_LABEL), F.lit(":"), F.col("brief")).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("place", "ord", "id", "line")))
    return made.unionByName(gone).groupBy("note_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))


def _by_kind(kind: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def previous_summary(title: Column, one_liner: Column, kind: Column, topics: Column, points: Column, summary: Column) -> Column:
    """The summary so far as labelled lines; parts that are empty are left out."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    many = lambda label, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, sep)))
    return F.concat_ws("\n", part("标题:", title), part("一句话:", one_liner), part("类型:", kind), many("主题:", topics, "、"), many("要点:\n- ", points, "\n- "), part("总结:", summary))


def titles(ids: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (note_id, title) for ``ids``; notes that are gone have a title that says so."""
    return ids.select("note_id").join(notes.select("note_id", "title"), "note_id", "left").select("note_id", F.coalesce("title", F.lit(GONE)).alias("title"))


def export_section(b: dict[str, Column], markdown: bool = True) -> Column:
    t = {k: trim(v) for k, v in b.items() if k not in ("kind", "extraction_unavailable")}
    lit = F.lit
    label = lambda name, c: F.concat(lit(f"**{name}:**" if markdown else f"{name}:"), c)
    text = F.when(t["text"] != "", t["text"] if markdown else markdown_plain(t["text"]))
    name = F.when(t["file_name"] == "", "未命名文档").otherwise(t["file_name"])
    kind = F.when(t["file_type"] == "", "").otherwise(F.concat(lit("("), t["file_type"], lit(")")))
    body = F.when(F.coalesce(b["extraction_unavailable"], lit(False)), "(暂不支持提取文字)").when(t["extracted_text"] == "", "").otherwise(F.concat(lit("\n"), _clip(t["extracted_text"], EXPORT_CHARS)))
    link = F.concat(lit("🔗 "), F.when(t["link_title"] == "", t["url"]).otherwise(F.concat(lit("["), t["link_title"], lit("]("), t["url"], lit(")")))) if markdown else F.concat(lit("链接:"), F.concat_ws(" ", F.nullif(t["link_title"], lit("")), t["url"]))
    link = F.when(t["url"] != "", F.concat(link, F.when(t["link_description"] == "", "").otherwise(F.concat(lit("\n"), t["link_description"]))))
    out = lit(None).cast("string")
    for k, v in (
        ("text", text), ("audio", label("录音转写", F.when(t["transcript"] == "", "(无转写)").otherwise(t["transcript"]))),
        ("image", label("图片", F.when(t["image_caption"] == "", "(无说明)").otherwise(t["image_caption"]))), ("file", label("文档", F.concat(name, kind, body))), ("link", link),
    ):
        out = F.when(b["kind"] == k, v).otherwise(out)
    return out


def export_text(blocks: DataFrame, notes: DataFrame, markdown: bool = True) -> DataFrame:
    """Rows (note_id, text): each note as one document; ``notes`` has title, folder and tags."""
    made = blocks.withColumn("s", export_section(cols(blocks), markdown)).groupBy("note_id").agg(_ordered("s", "\n\n").alias("body"))
    mark = "#" if markdown else ""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("标签:"), F.array_join(F.transform("tags", lambda x: F.concat(F.lit(mark), x)), " ")))
    folder = F.when(F.coalesce("folder", F.lit("")) != "", F.concat(F.lit("文件夹:"), F.col("folder")))
    meta = F.nullif(F.concat_ws("  ·  " if markdown else " · ", folder, tags), F.lit(""))
    title = F.concat(F.lit("# " if markdown else ""), F.when(F.coalesce("title", F.lit("")) == "", UNTITLED).otherwise(F.col("title")))
    body = F.when(F.col("body") != "", F.concat(F.lit("\n"), F.col("body")))
    return made.join(notes, "note_id").select("note_id", F.concat(trim(F.concat_ws("\n", title, meta, body)), F.lit("\n")).alias("text"))


def tag_key(tag: Column) -> Column:
    return normalize(tag)


def sanitize_tags(tags: Column) -> Column:
    """White space collapsed, blank tags dropped, and of tags with the same folded key the first kept."""
    clean = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    start = F.array().cast("array<string>")
    return F.aggregate(clean, start, lambda out, t: F.when(F.exists(out, lambda o: tag_key(o) == tag_key(t)), out).otherwise(F.concat(out, F.array(t))))


def merge_tags(a: Column, b: Column) -> Column:
    return sanitize_tags(F.concat(a, b))


def remove_tag(tags: Column, tag: Column) -> Column:
    return F.filter(tags, lambda t: tag_key(t) != tag_key(tag))


def has_tag(tags: Column, tag: Column) -> Column:
    return F.exists(tags, lambda t: tag_key(t) == tag_key(tag))


#: As the folder of a scope: notes in no folder.
UNFILED = object()


def in_scope(folder: str | object | None = None, pinned: bool = False, tags: tuple[str, ...] = ()) -> Column:
    """Scope of a search: a folder (or ``UNFILED``), pinned notes only, and all of some tags.

    A list applies it after its limit; filter notes first where a full list of the scope is wanted.
    """
    out = F.lit(True)
    if folder is UNFILED:
        out = out & F.col("folder").isNull()
    elif folder is not None:
        out = out & (F.col("folder") == folder)
    if pinned:
        out = out & F.col("is_pinned")
    for t in tags:
        out = out & has_tag(F.col("tags"), F.lit(t))
    return out


def folder_chips(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (place, chip): all, unfiled (if a note is), the folders in their order, manage; none without folders."""
    some = folders.agg(F.count("*").alias("n")).filter("n > 0")
    unfiled = notes.filter("folder is null").agg(F.count("*").alias("u")).filter("u > 0")
    named = folders.select(F.lit(3).alias("group"), "sort_order", F.col("name").alias("chip"))
    fixed = lambda g, name, df: df.select(F.lit(g).alias("group"), F.lit(0).alias("sort_order"), F.lit(name).alias("chip"))
    all_chips = fixed(1, "all", some).unionByName(fixed(2, "unfiled", some.join(F.broadcast(unfiled)).select("n"))).unionByName(named).unionByName(fixed(4, "manage", some))
    return all_chips.select(F.row_number().over(Window.orderBy("group", "sort_order", "chip")).alias("place"), "chip")


def note_summaries(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (note_id, title, preview, updated_at) with the first 60 characters of each note, latest first; ``texts``: note_id, ord, text."""
    first = texts.filter("text <> ''").groupBy("note_id").agg(_clip(F.min_by("text", "ord"), PREVIEW_CHARS).alias("preview"))
    return notes.join(first, "note_id", "left").select("note_id", "title", F.coalesce("preview", F.lit(NO_TEXT)).alias("preview"), "updated_at").orderBy(F.desc("updated_at"), "note_id")


def next_order(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("note_id").agg((F.max("ord") + 1).alias("next_ord"))


def present_kinds(blocks: DataFrame) -> DataFrame:
    firsts = blocks.groupBy("note_id", "kind").agg(F.min("ord").alias("o"))
    return firsts.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
