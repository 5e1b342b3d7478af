"""Words of many texts at a time, as Arrow and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 4 << 20


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of ``texts`` of about ``size`` bytes (one text at least) and where they begin; nulls become empty."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct, offsets): word j of text i is ``distinct[codes[offsets[i] + j]]``; words are parted by blanks and 0x09 to 0x0D."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    return codes, distinct, offsets
