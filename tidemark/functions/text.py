"""Column functions over note text: folding, trimming, Markdown, hashes, scripts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, prefixes and labels that results depend on.
HAN_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
KANA_RANGE = (0x3040, 0x30FF)
HASH_PREFIX = "v2|"
TERMINATORS = ".!?;\n。！？；…"
HEADING = r"^\s{0,3}#{1,6}\s+"
LIST_MARKER = r"^\s*([-*+]\s+|\d+[.)]\s+)"
LINK = r"\[([^\]]+)\]\([^)]*\)"
BOLD = r"(\*\*|__)(.+?)\1"
ITALIC = r"(\*|_)(.+?)\1"
CODE = r"`([^`]+)`"
STRIKE = r"~~(.+?)~~"
DIVIDER = r"^(-{3,}|\*{3,}|_{3,})$"
BRIEF_PREFIX = {"text": "", "image": "图片", "audio": "录音", "file": "文档", "link": "链接"}


def _char_class(*ranges: tuple[int, int]) -> str:
    return "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges) + "]"


HAN = _char_class(*HAN_RANGES)
CJK = _char_class(*HAN_RANGES, KANA_RANGE)
LATIN = r"[A-Za-zÀ-ɏ]"


def _fold_table() -> tuple[str, str]:
    """Accented lower-case letters and full-width forms with what they fold to, one character each."""
    a, b = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), 0x3000):
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD" if code >= 0x3000 else "NFD", c) if not unicodedata.combining(x)).lower()
        if len(c) == 1 and len(base) == 1 and base != c:
            a.append(c)
            b.append(base)
    return "".join(a), "".join(b)


_FROM, _TO = _fold_table()


def trim(text: Column) -> Column:
    """Without white space at either end; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Case, accents and width folded, character by character."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), _FROM, _TO)


def haystack(text: Column) -> Column:
    """Folded text with the offsets of the original; only lower case where folding would change the length."""
    return F.when(F.length(fold(text)) == F.length(text), fold(text)).otherwise(F.lower(text))


def normalize(text: Column) -> Column:
    return trim(fold(text))


def tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), normalize), lambda t: t != "")


def fold_text(text: str) -> str:
    """:func:`fold` for one driver-side string."""
    return text.lower().translate(str.maketrans(_FROM, _TO))


def has_han(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(HAN)


def has_latin(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(LATIN)


def runs_semantic(query: Column, cjk_min: int = 2, latin_min: int = 3) -> Column:
    """Whether a query is long enough for vector search: by the CJK minimum only if over half its characters are CJK."""
    meaningful = F.regexp_replace(F.coalesce(query, F.lit("")), r"\s", "")
    n = F.length(meaningful)
    cjk = n - F.length(F.regexp_replace(meaningful, CJK, ""))
    return (n > 0) & (n >= F.when(cjk * 2 > n, cjk_min).otherwise(latin_min))


def clip(text: Column, limit: int = 40) -> Column:
    t = trim(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def is_divider(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t]+|[ \t]+$", "").rlike(DIVIDER)


def strip_inline(line: Column) -> Column:
    for pattern, group in ((LINK, "$1"), (BOLD, "$2"), (ITALIC, "$2"), (CODE, "$1"), (STRIKE, "$1")):
        line = F.regexp_replace(line, pattern, group)
    return line


def markdown_plain(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~is_divider(x))
    lines = F.transform(lines, lambda x: strip_inline(F.regexp_replace(F.regexp_replace(x, HEADING, ""), LIST_MARKER, "")))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def has_formatting(text: Column) -> Column:
    tests = (HEADING, LIST_MARKER, r"(\*\*|__).+?(\*\*|__)", r"\*(?=\S)[^*\n]+?(?<=\S)\*", r"\[[^\]]+\]\([^)]*\)")
    line = lambda x: is_divider(x) | F.concat(*(F.when(x.rlike(p), "1").otherwise("") for p in tests)).rlike("1")
    return F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def line_kind(line: Column) -> Column:
    """struct(kind, level, content): heading, divider, bullet, ordered or text."""
    heading, bullet, ordered = r"^\s{0,3}(#{1,6})\s+(.*)$", r"^\s*[-*+]\s+(.*)$", r"^\s*(\d+)[.)]\s+(.*)$"
    of = lambda kind, level, content: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), content.alias("content"))
    none = F.lit(None)
    return (
        F.when(line.rlike(heading), of("heading", F.length(F.regexp_extract(line, heading, 1)), F.regexp_extract(line, heading, 2)))
        .when(is_divider(line), of("divider", none, F.lit("")))
        .when(line.rlike(bullet), of("bullet", none, F.regexp_extract(line, bullet, 1)))
        .when(line.rlike(ordered), of("ordered", F.regexp_extract(line, ordered, 1), F.regexp_extract(line, ordered, 2)))
        .otherwise(of("text", none, line))
    )


def canonical(b: dict[str, Column]) -> Column:
    """The string of a block's content that hashes are taken of; ``b`` maps block columns."""
    t = {k: trim(v) if k not in ("kind", "extraction_unavailable") else v for k, v in b.items()}
    lit = F.lit
    return (
        F.when(b["kind"] == "text", F.concat(lit("text|"), t["text"]))
        .when(b["kind"] == "image", F.concat(lit("image|ref="), t["image_asset_ref"], lit("|caption="), t["image_caption"]))
        .when(b["kind"] == "audio", F.concat(lit("audio|ref="), t["audio_asset_ref"], lit("|transcript="), t["transcript"]))
        .when(b["kind"] == "file", F.concat(lit("file|name="), t["file_name"], lit("|type="), t["file_type"], lit("|text="), t["extracted_text"], lit("|unavail="), F.coalesce(b["extraction_unavailable"], lit(False)).cast("string")))
        .when(b["kind"] == "link", F.concat(lit("link|url="), t["url"], lit("|title="), t["link_title"], lit("|desc="), t["link_description"]))
    )


def content_hash(b: dict[str, Column], ocr: Column | None = None) -> Column:
    """SHA-256 of a block's content; text recognised in an image belongs to it."""
    body = canonical(b)
    if ocr is not None:
        body = F.when((b["kind"] == "image") & (trim(ocr) != ""), F.concat(body, F.lit("|ocr="), trim(ocr))).otherwise(body)
    return F.sha2(F.concat(F.lit(HASH_PREFIX), body), 256)


def brief(b: dict[str, Column]) -> Column:
    """A block in some 40 characters, with a label by kind."""
    colon = lambda kind, c: F.when(clip(c) == "", BRIEF_PREFIX[kind]).otherwise(F.concat(F.lit(BRIEF_PREFIX[kind] + ":"), clip(c)))
    title = F.when(clip(b["link_title"]) == "", clip(b["url"])).otherwise(clip(b["link_title"]))
    return (
        F.when(b["kind"] == "text", clip(b["text"]))
        .when(b["kind"] == "image", colon("image", b["image_caption"]))
        .when(b["kind"] == "audio", colon("audio", b["transcript"]))
        .when(b["kind"] == "file", F.concat(F.lit("文档:"), clip(b["file_name"])))
        .when(b["kind"] == "link", F.concat(F.lit("链接:"), title))
    )


def retrievable(b: dict[str, Column], ocr: Column | None = None) -> Column:
    """struct(source, text) of a block, null if it has no text to search."""
    t = {k: trim(v) for k, v in b.items() if k not in ("kind", "extraction_unavailable")}
    part = lambda c: F.nullif(c, F.lit(""))
    image = t["image_caption"] if ocr is None else F.concat_ws("\n", part(t["image_caption"]), part(trim(ocr)))
    link = F.concat_ws(" — ", part(t["link_title"]), part(t["link_description"]), part(t["url"]))
    of = {"text": ("text", t["text"]), "audio": ("transcript", t["transcript"]), "image": ("ocr", image), "file": ("extracted", t["extracted_text"]), "link": ("link", link)}
    out = F.lit(None).cast("struct<source:string,text:string>")
    for kind, (source, text) in of.items():
        out = F.when((b["kind"] == kind) & (text != ""), F.struct(F.lit(source).alias("source"), text.alias("text"))).otherwise(out)
    return out
