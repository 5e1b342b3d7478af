"""Ids of many texts at once under a lower-casing byte-pair vocabulary with word ends.

White space parts tokens and is dropped by such a vocabulary, so a text's ids
are those of its words.  Words are told apart by Arrow; plain Latin words, most
of the distinct ones, are merged side by side in numpy, and all other words and
marks go through the tokenizer itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import coded_words

#: Letters whose lower case and composed form are themselves one letter each.
PLAIN = r"^([A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ſƀ-ƿǝ-ǿ]*)([!-/:-@\[-`{-~]*)$"
LONGEST = 32
_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """The tokenizer and, as arrays, its byte symbols and merges."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        for code in range(0x250):
            shown = level.pre_tokenize_str(chr(code))[0][0] if code != 0x20 else "Ġ"
            for byte, symbol in zip(chr(code).encode(), shown, strict=True):
                self.inner[byte], self.last[byte] = ids[symbol], ids[symbol + "</w>"]
        self.size = max(ids.values()) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.append(order, len(order)).astype(np.int32)
        self.merged = np.append(np.array([ids[a + b] for a, b in merges], np.int64)[order], 0)
        self._slots(18)

    def _slots(self, bits: int) -> None:
        """Two hash tables of places in ``keys``; a key is in one of them, the few that fit in neither make the tables larger."""
        self.shift = np.uint64(64 - bits)
        self.odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
        self.table = np.full((2, 1 << bits), len(self.keys), np.int32)
        left = np.arange(len(self.keys))
        for t in (0, 1):
            slot = self._hash(self.keys[left], t)
            _, first = np.unique(slot, return_index=True)
            self.table[t][slot[first]] = left[first]
            left = np.delete(left, first)
        if len(left):
            self._slots(bits + 1)

    def _hash(self, keys: np.ndarray, t: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.odd[t]) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair of symbols among the merges, their number for pairs that don't merge."""
        n = len(self.keys)
        keys = a * self.size + b
        at = self.table[0][self._hash(keys, 0)]
        miss = np.flatnonzero(self.keys[np.minimum(at, n - 1)] != keys)
        other = self.table[1][self._hash(keys[miss], 1)]
        at[miss] = np.where(self.keys[np.minimum(other, n - 1)] == keys[miss], other, n)
        return at

    def merge(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words given as bytes; of all pairs the first merge applies, from the left, until none does."""
        n, out_sizes = len(self.keys), sizes.copy()
        order = np.argsort(sizes, kind="stable")
        flat = np.zeros(int(sizes.sum()), np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for width in np.unique(sizes):
            rows = order[np.searchsorted(sizes[order], width) : np.searchsorted(sizes[order], width, side="right")]
            if width == 0:
                continue
            word = self.inner[codes[starts[rows][:, None] + np.arange(width)]]
            word[:, -1] = self.last[codes[starts[rows] + width - 1]]
            live = np.arange(len(rows))
            pair = self.find(word[:, :-1].ravel(), word[:, 1:].ravel()).reshape(len(rows), width - 1)
            current = np.full(len(rows), width)
            symbols = word
            while len(live) and symbols.shape[1] > 1:
                best = self.rank[pair].argmin(axis=1)
                r = np.arange(len(live))
                chosen = pair[r, best]
                done = chosen == n
                if done.any():
                    keep = ~done
                    ended = live[done]
                    m = symbols.shape[1]
                    word[ended, :m] = symbols[done]
                    current[ended] = m
                    live, symbols, pair, best, chosen = live[keep], symbols[keep], pair[keep], best[keep], chosen[keep]
                    r = np.arange(len(live))
                    if not len(live):
                        break
                m = symbols.shape[1] - 1
                take = np.arange(m) + (np.arange(m) > best[:, None])
                symbols = np.take_along_axis(symbols, take, axis=1)
                symbols[r, best] = self.merged[chosen]
                pair = np.take_along_axis(pair, np.arange(max(m - 1, 0)) + (np.arange(max(m - 1, 0)) >= best[:, None]), axis=1)
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < m - 1)
                pair[left, best[left] - 1] = self.find(symbols[left, best[left] - 1], symbols[left, best[left]])
                pair[right, best[right]] = self.find(symbols[right, best[right]], symbols[right, best[right] + 1])
            if len(live):
                word[live, : symbols.shape[1]] = symbols
                current[live] = symbols.shape[1]
            out_sizes[rows] = current
            flat[offsets[rows][:, None] + np.arange(width)] = word
        keep = np.repeat(offsets[:-1] + out_sizes, sizes) > np.arange(len(flat))
        return flat[keep], out_sizes

    def plain_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of plain letters; empty ones have none."""
        lowered = pc.utf8_lower(words).cast(pa.binary())
        offsets = np.frombuffer(lowered.buffers()[1], np.int32)[lowered.offset : lowered.offset + len(lowered) + 1].astype(np.int64)
        codes = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)
        return self.merge(codes, offsets[:-1], np.diff(offsets))

    def any_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.int64), sizes


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _gather(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = sizes[which]
    place = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return ids[place], n


def _word_ids(v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of distinct words: plain letters, then marks, or else whatever the tokenizer makes of the word."""
    split = pc.extract_regex(words, pattern="(?s)" + PLAIN.replace("^(", "^(?P<a>", 1).replace(")(", ")(?P<p>", 1))
    fits = pc.and_(split.is_valid(), pc.less_equal(pc.binary_length(words), LONGEST)).to_numpy(zero_copy_only=False)
    simple, odd = np.flatnonzero(fits), np.flatnonzero(~fits)
    some = split.take(pa.array(simple))
    letters = pc.struct_field(some, "a").dictionary_encode()
    marks = pc.struct_field(some, "p").dictionary_encode()
    a_ids, a_n = v.plain_ids(letters.dictionary)
    m_ids, m_n = v.any_ids(marks.dictionary.to_pylist())
    o_ids, o_n = v.any_ids(words.take(pa.array(odd)).to_pylist())
    # All pieces in one table: letters, marks, others; a simple word takes two of them.
    ids, sizes = np.concatenate([a_ids, m_ids, o_ids]), np.concatenate([a_n, m_n, o_n])
    pieces = np.full((len(words), 2), -1)
    pieces[simple, 0] = letters.indices.to_numpy(zero_copy_only=False)
    pieces[simple, 1] = len(a_n) + marks.indices.to_numpy(zero_copy_only=False)
    pieces[odd, 0] = len(a_n) + len(m_n) + np.arange(len(odd))
    which = pieces[pieces >= 0]
    out, n = _gather(ids, sizes, which)
    per_word = np.zeros(len(words), np.int64)
    np.add.at(per_word, np.nonzero(pieces >= 0)[0], n)
    return out, per_word


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): the ids of all texts and how many each has.  Texts with a special token's string are encoded whole."""
    v = vocabulary(path)
    whole = np.zeros(len(texts), bool)
    for s in v.special:
        whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    rest = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts) if whole.any() else texts
    codes, distinct, offsets = coded_words(rest)
    ids, n = _word_ids(v, distinct) if len(distinct) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out, each = _gather(ids, n, codes)
    ends = np.concatenate([[0], np.cumsum(each)])[offsets]
    sizes = np.diff(ends)
    if not whole.any():
        return out.astype("<u4"), sizes
    parts = [out[a:b].astype("<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for i in np.flatnonzero(whole):
        parts[i] = np.array(v.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4")
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
