"""Upper bounds of the weighted string ratio for many pairs at once, and best-first search with them.

A common subsequence is no longer than what two texts share as multisets of characters, and
the shared-token ratio depends on lengths of shared and other tokens, which two matrix
products give exactly, and on a common subsequence of the other tokens, which is bounded
likewise. So one pass of numpy over a tile of keys bounds every score. A key's candidates are
then scored from the highest bound down, until no bound reaches the best score found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from confluo.functions.similarity import LENGTH_FACTOR, TOKEN_SCALE, Prepared, wratio_above

#: Keys whose bounds are computed together.
TILE = 64
#: Rounding that a bound may lack.
SLACK = 1e-9


class Profiles:
    """Lengths, character counts and token incidence of keys, over an alphabet and a vocabulary.

    Of the vocabulary only words matter that keys of both sides have.
    """

    def __init__(self, keys: Sequence[Prepared], alphabet: dict[str, int], vocabulary: dict[str, int]):
        n = len(keys)
        letters = np.array(sorted(map(ord, alphabet)), np.uint32)
        rows = np.array([alphabet[chr(c)] for c in letters.tolist()], np.int64)

        def counts(texts: list[str]) -> np.ndarray:
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
            owner = np.repeat(np.arange(n), [len(t) for t in texts])
            found = np.bincount(rows[np.searchsorted(letters, codes)] * n + owner, minlength=len(alphabet) * n)
            return found.reshape(len(alphabet), n).astype(np.int32)

        self.chars, self.words, self.single = (
            counts(t) for t in ([k.text for k in keys], ["".join(k.words) for k in keys], ["".join(k.set) for k in keys])
        )
        self.tokens = np.zeros((n, len(vocabulary)), np.float32)
        for i, key in enumerate(keys):
            self.tokens[i, [vocabulary[w] for w in key.set if w in vocabulary]] = 1
        self.lengths = np.array([len(w) for w in vocabulary], np.float32)
        self.size = np.array([len(k.text) for k in keys], np.int64)
        self.n_words = np.array([len(k.words) for k in keys], np.int64)
        self.joined = np.array([len(k.joined) for k in keys], np.int64)
        self.n_set = np.array([len(k.set) for k in keys], np.int64)
        self.set_size = np.array([sum(map(len, k.set)) for k in keys], np.int64)


def _common(a: np.ndarray, b: np.ndarray, rows: slice) -> np.ndarray:
    """(rows, b) characters that two texts share, repeats counted.

    A count becomes a row of ones up to it, so that the sum of minima is one matrix product. Its
    numbers are small integers, exact in single precision.
    """
    some = a[:, rows]
    most = np.minimum(some.max(axis=1, initial=0), b.max(axis=1, initial=0))
    row = np.repeat(np.arange(len(most)), most)
    step = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
    left, right = (x[row] > step[:, None] for x in (some, b))
    return np.rint(left.T.astype(np.float32) @ right.astype(np.float32)).astype(np.int32)


def _window(common: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Bound of the best window: the window is no longer than the common part."""
    return 200.0 * common / np.maximum(shorter + common, 1)


def upper_bounds(a: Profiles, b: Profiles, rows: slice) -> np.ndarray:
    """No pair (row of ``a``, key of ``b``) scores more, but for rounding."""
    la, lb = a.size[rows, None], b.size[None, :]
    longer, shorter = np.maximum(la, lb), np.minimum(la, lb)
    common = _common(a.chars, b.chars, rows)
    blanks = np.maximum(np.minimum(a.n_words[rows, None], b.n_words[None, :]) - 1, 0)
    words = _common(a.words, b.words, rows) + blanks
    single = _common(a.single, b.single, rows)
    shared_n = np.rint(a.tokens[rows] @ b.tokens.T).astype(np.int32)
    shared_len = np.rint((a.tokens[rows] * a.lengths) @ b.tokens.T).astype(np.int32)
    shared = shared_n > 0

    best = 200.0 * common / np.maximum(la + lb, 1)
    ja, jb = a.joined[rows, None], b.joined[None, :]
    blank = ja + jb == 0  # two texts without words are alike
    token = np.where(blank, 100.0, 200.0 * words / np.maximum(ja + jb, 1))

    na, nb = a.n_set[rows, None] - shared_n, b.n_set[None, :] - shared_n
    only_a = a.set_size[rows, None] - shared_len + np.maximum(na - 1, 0)
    only_b = b.set_size[None, :] - shared_len + np.maximum(nb - 1, 0)
    base = np.where(shared, shared_len + shared_n - 1, 0)
    len_a, len_b = base + shared + only_a, base + shared + only_b
    other = single - shared_len + np.maximum(np.minimum(na, nb) - 1, 0)
    distance = np.maximum(np.abs(only_a - only_b), only_a + only_b - 2 * other)
    both = (na > 0) & (nb > 0)
    sets = np.where(both, 100.0 - 100.0 * distance / np.maximum(len_a + len_b, 1), 0.0)
    inside = np.maximum(200.0 * base / np.maximum(base + len_a, 1), 200.0 * base / np.maximum(base + len_b, 1))
    sets = np.where(shared, np.where(both, np.maximum(sets, inside), 100.0), sets)
    near = np.maximum(best, TOKEN_SCALE * np.maximum(token, sets))

    scale = np.where(longer <= 8.0 * shorter, 0.9, 0.6)
    parts = np.maximum(_window(words, np.minimum(ja, jb)), _window(np.maximum(other, 0), np.minimum(only_a, only_b)))
    far = np.maximum(np.maximum(best, scale * _window(common, shorter)), TOKEN_SCALE * scale * np.where(shared | blank, 100.0, parts))
    bound = np.where(longer < LENGTH_FACTOR * shorter, near, far)
    return np.where(shorter > 0, bound, 0.0)


def _profiles(a: Sequence[Prepared], b: Sequence[Prepared]) -> tuple[Profiles, Profiles]:
    alphabet = {c: i for i, c in enumerate(sorted(set("".join([k.text for k in (*a, *b)]))))}
    shared = set().union(*(k.set for k in a)) & set().union(*(k.set for k in b))
    vocabulary = {w: i for i, w in enumerate(sorted(shared))}
    return Profiles(a, alphabet, vocabulary), Profiles(b, alphabet, vocabulary)


def pairs_above(keys: Sequence[str], names: Sequence[str], floor: float, tile: int = TILE) -> Iterator[tuple[int, int, float]]:
    """(key, name, score) as indexes: all pairs whose score reaches ``floor``."""
    a, b = [Prepared.of(k) for k in keys], [Prepared.of(n) for n in names]
    left, right = _profiles(a, b)
    for start in range(0, len(a), tile):
        bounds = upper_bounds(left, right, slice(start, start + tile))
        for i, j in zip(*(x.tolist() for x in np.nonzero(bounds >= floor - SLACK)), strict=True):
            score = wratio_above(a[start + i], b[j], floor)
            if score >= floor:
                yield start + i, j, score


def best_matches(keys: Sequence[str], names: Sequence[str], tile: int = TILE) -> Iterator[tuple[int, int, float]]:
    """(key, name, score) as indexes: the best name of each key, the first of equally good ones.

    Exact at any score. ``names`` must not be empty.
    """
    a, b = [Prepared.of(k) for k in keys], [Prepared.of(n) for n in names]
    left, right = _profiles(a, b)
    for start in range(0, len(a), tile):
        bounds = upper_bounds(left, right, slice(start, start + tile))
        for i, bound in enumerate(bounds, start):
            best, at = -1.0, -1
            for j in np.argsort(-bound, kind="stable").tolist():
                if bound[j] < best - SLACK:
                    break
                score = wratio_above(a[i], b[j], best)
                if score > best or (score == best and j < at):
                    best, at = score, j
            yield i, at, best
