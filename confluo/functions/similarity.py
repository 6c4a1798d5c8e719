"""Weighted string ratio (0–100) of two keys, as an Arrow-batched scorer.

Definition (public, from the insertion/deletion distance): ``ratio = 200·LCS/(|a|+|b|)``.
For lengths within a factor 1.5 the score is the best of ``ratio`` and 0.95 times the
sorted-token and shared-token ratios; beyond it, of ``ratio`` and scaled window ratios.
"""

from __future__ import annotations

from collections.abc import Set
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_SCALE = 0.95
LENGTH_FACTOR = 1.5


def _positions(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def _lcs(masks: dict[str, int], width: int, other: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step per char."""
    row = full = (1 << width) - 1
    for ch in other:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return width - row.bit_count()


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _lcs(_positions(a), len(a), b) / total if total else 100.0


def _window_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window, full or cut at an end, of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    masks, n = _positions(short), len(short)
    best = 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n):end]
        if window:
            best = max(best, 200.0 * _lcs(masks, n, window) / (n + len(window)))
            if best == 100.0:
                break
    return best


def _set_ratio(a: Set[str], b: Set[str]) -> float:
    """Ratio by shared tokens: 100 where one side has no other, 0 where one side has none at all."""
    shared = a & b
    only_a, only_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if not only_a or not only_b:
        return 100.0 if shared else 0.0
    base = len(" ".join(shared))
    len_a, len_b = (base + bool(shared) + len(x) for x in (only_a, only_b))
    distance = len(only_a) + len(only_b) - 2 * _lcs(_positions(only_a), len(only_a), only_b)
    token = 100.0 - 100.0 * distance / (len_a + len_b)
    return max(token, 200.0 * base / (base + len_a), 200.0 * base / (base + len_b)) if shared else token


def wratio_text(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    best = _ratio(a, b)
    words_a, words_b = sorted(a.split()), sorted(b.split())
    set_a, set_b = set(words_a), set(words_b)
    only_a, only_b = " ".join(sorted(set_a - set_b)), " ".join(sorted(set_b - set_a))
    shared = set_a & set_b
    if longer / shorter < LENGTH_FACTOR:
        token = max(_ratio(" ".join(words_a), " ".join(words_b)), _set_ratio(set_a, set_b))
        return max(best, TOKEN_SCALE * token)
    scale = 0.9 if longer / shorter <= 8.0 else 0.6
    if shared:
        token = 100.0
    else:
        token = _window_ratio(" ".join(words_a), " ".join(words_b))
        if len(words_a) != len(set_a) or len(words_b) != len(set_b):
            token = max(token, _window_ratio(only_a, only_b))
    return max(best, scale * _window_ratio(a, b), TOKEN_SCALE * scale * token)


@dataclass(frozen=True)
class Prepared:
    """A key with what every comparison needs of it."""

    text: str
    words: tuple[str, ...]
    joined: str
    set: frozenset[str]
    masks: dict[str, int]
    joined_masks: dict[str, int]

    @classmethod
    def of(cls, text: str) -> Prepared:
        words = tuple(sorted(text.split()))
        joined = " ".join(words)
        masks = _positions(text)
        return cls(text, words, joined, frozenset(words), masks, masks if joined == text else _positions(joined))


def wratio_above(a: Prepared, b: Prepared, floor: float) -> float:
    """The weighted ratio where it reaches ``floor``, else some value below it.

    A window of the longer text shares no longer subsequence than the whole text does, so most
    window ratios need not be computed.
    """
    la, lb = len(a.text), len(b.text)
    if not la or not lb:
        return 0.0
    longer, shorter = max(la, lb), min(la, lb)
    common = _lcs(a.masks, la, b.text)
    best = 200.0 * common / (la + lb)
    shared = a.set & b.set
    if longer / shorter < LENGTH_FACTOR:
        if TOKEN_SCALE * 100.0 < floor:
            return best
        total = len(a.joined) + len(b.joined)
        token = 200.0 * _lcs(a.joined_masks, len(a.joined), b.joined) / total if total else 100.0
        return max(best, TOKEN_SCALE * max(token, _set_ratio(a.set, b.set)))
    scale = 0.9 if longer / shorter <= 8.0 else 0.6
    cut = floor - 1e-9  # bounds may round differently
    if scale * 200.0 * common / (shorter + common) >= cut:
        best = max(best, scale * _window_ratio(a.text, b.text))
    if shared:
        return max(best, TOKEN_SCALE * scale * 100.0)
    if TOKEN_SCALE * scale * 100.0 >= floor:
        common = _lcs(a.joined_masks, len(a.joined), b.joined)
        repeated = len(a.words) != len(a.set) or len(b.words) != len(b.set)
        blank = not a.joined and not b.joined
        if repeated or blank or TOKEN_SCALE * scale * 200.0 * common / (min(len(a.joined), len(b.joined)) + common or 1) >= cut:
            token = _window_ratio(a.joined, b.joined)
            if repeated:
                token = max(token, _window_ratio(" ".join(sorted(a.set)), " ".join(sorted(b.set))))
            best = max(best, TOKEN_SCALE * scale * token)
    return best


def _char_gap(a: str, b: str) -> int:
    """Lower bound of the insertions and deletions between any two arrangements of the texts."""
    counts: dict[str, int] = {}
    for ch in a:
        counts[ch] = counts.get(ch, 0) + 1
    for ch in b:
        counts[ch] = counts.get(ch, 0) - 1
    return sum(map(abs, counts.values()))


def score_at_least(a: str | None, b: str | None, floor: float) -> float:
    """The weighted ratio where it reaches ``floor`` (above 90), else 0 after cheap tests."""
    if not a or not b or max(len(a), len(b)) >= LENGTH_FACTOR * min(len(a), len(b)):
        return 0.0
    if _ratio(a, b) < floor:
        need = floor / TOKEN_SCALE
        slack = (1 - need / 100) * (len(a) + len(b)) + 1e-6
        words_a, words_b = set(a.split()), set(b.split())
        only_a, only_b = words_a - words_b, words_b - words_a
        inside = min(sum(map(len, only_a)), sum(map(len, only_b))) <= slack
        if need > 100 or not (inside or _char_gap("".join(only_a), "".join(only_b)) <= slack or _char_gap(a, b) <= slack):
            return 0.0
    score = wratio_text(a, b)
    return score if score >= floor else 0.0


@F.pandas_udf(T.DoubleType())
def _wratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([wratio_text(x, y) for x, y in zip(a, b)], dtype="float64")


def wratio(a: Column, b: Column) -> Column:
    return _wratio(a, b)


def wratio_from(a: Column, b: Column, floor: float) -> Column:
    """Like ``wratio`` where the score reaches ``floor``, else 0."""

    @F.pandas_udf(T.DoubleType())
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([score_at_least(p, q, floor) for p, q in zip(x, y)], dtype="float64")

    return scored(a, b)
