"""Answers of models and services: JSON found in text, decoded without failing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import trim


def first_object(text: str | None) -> str | None:
    """The first balanced {...} outside of strings, code fences taken off; None if there is none."""
    if text is None:
        return None
    start, depth, quoted, escaped = -1, 0, False, False
    for i, c in enumerate(text):
        if start < 0:
            if c == "{":
                start, depth = i, 1
            continue
        if quoted:
            quoted = c != '"' or escaped
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted, escaped = True, False
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def json_object(text: Column) -> Column:
    """:func:`first_object` of a column, in Arrow batches."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return run(text)


def message_content(body: Column) -> Column:
    """Text of a chat answer: a string, or the parts of an array joined."""
    path = "$.choices[0].message.content"
    parts = F.from_json(F.get_json_object(body, path), "array<struct<text:string>>")
    raw = F.get_json_object(body, path)
    return F.when(raw.startswith("["), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(raw)


def text_field(body: Column, name: str) -> Column:
    """A string field, trimmed; missing, null or of another type is empty."""
    v = F.try_variant_get(F.try_parse_json(body), f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant"))
    return F.coalesce(F.when(kind == "STRING", trim(v)), F.lit(""))


def list_field(body: Column, name: str) -> Column:
    """An array field without blanks; a single string is an array of one."""
    one = text_field(body, name)
    many = F.coalesce(F.try_variant_get(F.try_parse_json(body), f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return F.when(one != "", F.array(one)).otherwise(F.filter(F.transform(many, lambda x: trim(x)), lambda x: x != ""))


def service_error(body: Column) -> Column:
    """The message of a service's error answer; null if it is none."""
    return F.try_variant_get(F.try_parse_json(body), "$.error.message", "string")


def transcript(body: Column) -> Column:
    """struct(text, error) of a transcription answer: its trimmed text, the service's message, or ``invalid_response``."""
    parsed = F.try_parse_json(body)
    text = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant")) == "STRING", F.try_variant_get(parsed, "$.text", "string"))
    error = F.coalesce(service_error(body), F.when(text.isNull(), "invalid_response"))
    return F.struct(F.when(error.isNull(), trim(text)).alias("text"), error.alias("error"))


def embeddings_in_order(body: Column, dimension: int, expected: Column | None = None) -> Column:
    """Vectors of an embedding answer by their index; null if one has another dimension, or if there are not as many as ``expected``."""
    rows = F.from_json(body, "data array<struct<index:int,embedding:array<float>>>")["data"]
    ordered = F.transform(F.array_sort(rows), lambda r: r["embedding"])
    fits = F.forall(ordered, lambda v: F.size(v) == dimension)
    return F.when(fits if expected is None else fits & (F.size(ordered) == expected), ordered)


def prompt_tokens(body: Column) -> Column:
    """The tokens that a service says it counted, ``usage.prompt_tokens`` or else ``usage.total_tokens``; null if it doesn't say, or not in whole numbers.

    It has no say in whether the answer itself can be used.
    """
    parsed = F.try_parse_json(body)
    field = lambda name: F.try_variant_get(parsed, f"$.usage.{name}", "variant")
    whole = lambda name: F.coalesce(F.schema_of_variant(field(name)).isin("BIGINT", "VOID"), F.lit(True))
    value = lambda name: F.try_variant_get(parsed, f"$.usage.{name}", "bigint")
    return F.when(whole("prompt_tokens") & whole("total_tokens"), F.coalesce(value("prompt_tokens"), value("total_tokens")))


#: Audio types by file extension.
AUDIO_TYPES = {
    "m4a": "audio/m4a", "mp4": "audio/m4a", "aac": "audio/m4a", "mp3": "audio/mpeg", "mpeg": "audio/mpeg", "mpga": "audio/mpeg",
    "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "webm": "audio/webm",
}


def audio_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in AUDIO_TYPES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out
