"""Query segmentation into groups of terms (driver side, a few strings)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

from .text import HAN_RANGES, fold_text


@dataclass(frozen=True)
class Group:
    terms: tuple[str, ...]
    min_matched: int
    is_bigram: bool


@dataclass(frozen=True)
class Policy:
    """How many terms of a group must match.  Fixed values: the defaults."""

    ratio: float = 0.15
    floor: int = 3
    latin_relaxes_cjk: bool = True
    latin_ratio: float | None = 0.5
    latin_and_below: int = 2

    def cjk_min(self, n: int) -> int:
        return max(self.floor, math.ceil(self.ratio * n))


def is_han(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in HAN_RANGES)


def _runs(token: str) -> list[tuple[bool, str]]:
    return [(han, "".join(cs)) for han, cs in groupby(token, is_han)]


def groups(query: str, policy: Policy = Policy()) -> list[Group]:
    """Groups of a query: overlapping pairs of each Han run, then one group of all other runs.

    A run that isn't Han counts as Latin, marks included.  A single Han character
    counts only if it is the whole query.
    """
    raw = [_runs(t) for t in query.split()]
    latin = [f for token in raw for han, r in token if not han and (f := fold_text(r).strip())]
    found: list[Group] = []
    for token in raw:
        for han, r in token:
            chars = fold_text(r).strip() if han else ""
            if len(chars) >= 2:
                pairs = tuple(dict.fromkeys(a + b for a, b in zip(chars, chars[1:], strict=False)))
                need = 1 if latin and policy.latin_relaxes_cjk else policy.cjk_min(len(pairs))
                found.append(Group(pairs, min(max(1, need), len(pairs)), True))
            elif chars and len(raw) == 1 and len(token) == 1:
                found.append(Group((chars,), 1, False))
    if latin:
        terms = tuple(dict.fromkeys(latin))
        some = policy.latin_ratio is not None and len(terms) > policy.latin_and_below
        found.append(Group(terms, max(1, math.ceil(policy.latin_ratio * len(terms))) if some else len(terms), False))
    return found
