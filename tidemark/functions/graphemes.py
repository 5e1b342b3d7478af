"""Characters as readers see them: offsets by grapheme where a text has graphemes of several code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_CLUSTER = regex.compile(r"\X")
# Ranges of code points that stand alone whatever is next to them, CR apart; texts of these only have as many graphemes as code points.
ALONE = ((0x00, 0x0C), (0x0E, 0xA8), (0xAA, 0xAD), (0xAF, 0x02FF), (0x0370, 0x03FF), (0x0400, 0x0482), (0x2010, 0x2027), (0x2030, 0x203B), (0x3000, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFF01, 0xFF9D))
_SIMPLE = regex.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ALONE) + "]*")


def is_simple(text: str) -> bool:
    """Whether each code point is a grapheme, as far as the ranges tell."""
    return _SIMPLE.fullmatch(text) is not None


def clusters(text: str) -> list[str]:
    """The graphemes of a text (extended clusters)."""
    return list(text) if is_simple(text) else _CLUSTER.findall(text)


def edges(text: str) -> np.ndarray:
    """Where its graphemes begin, in code points, and last its length."""
    return np.arange(len(text) + 1) if is_simple(text) else np.array([0, *(m.end() for m in _CLUSTER.finditer(text))])


def grapheme_count(text: Column) -> Column:
    """The number of graphemes; null for null."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(edges(t)) - 1 for t in texts.to_pylist()], pa.int32())

    return count(text)


def grapheme_places(text: Column, places: Column) -> Column:
    """Places in code points (an array) as places in graphemes: that of the grapheme which has the code point, the number of graphemes for the text's end."""

    @F.arrow_udf("array<int>")
    def moved(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            out.append(None if t is None or p is None else (np.searchsorted(edges(t), p, side="right") - 1).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return moved(text, places)
