"""Deobfuscation against all paths, the language model against plain counts, scores held out."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import PROSE, SCHEMA, awkward, empty, rows
from confluo.llm import toxicity as T

TOXIC = ["idiot", "moron", "scum", "worthless"]
CLEAN = (PROSE * 4 + "in other words a mp3 for all of us and for them too she was going home at noon ").split()


def texts(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = draw.choices(CLEAN, k=draw.randrange(20, 40)) + [f"id{draw.randrange(10**6)}x"]
        if i % 4 == 0:
            words[draw.randrange(len(words))] = TOXIC[i // 4 % 4]
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def logp():
    counts = np.zeros(T.GRAMS, np.int64)
    T.gram_counts(texts(400), counts)
    return T.log_probabilities(counts)


def test_grams_and_probabilities(monkeypatch):
    sample = ["Ab, ab", "", "é日 x2y", "  ", PROSE]
    counts = np.zeros(T.GRAMS, np.int64)
    T.gram_counts(sample, counts)
    parts = np.zeros(T.GRAMS, np.int64)
    monkeypatch.setattr(T, "STEP", 3)
    T.gram_counts(sample, parts)
    assert (counts == parts).all()
    s = [0]
    for c in "\n".join([*sample, ""]):
        x = int(T.symbols(c)[0])
        if x or s[-1]:
            s.append(x)
    want = Counter(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    assert {tuple(int(x) for x in np.unravel_index(g, (28,) * 4)): n for g, n in zip(np.flatnonzero(counts), counts[counts > 0], strict=True)} == want
    p = np.exp(T.log_probabilities(counts).astype(float).reshape(-1, 28))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_best_path_is_the_best_of_all(logp):
    def cost(path):
        state, total = [0, 0, 0], 0.0
        for emitted, _, price in [*path, ((0,), "", 0.0)]:
            total -= price
            for s in emitted:
                if s or state[-1]:
                    total += logp[np.ravel_multi_index([*state, s], (28,) * 4)]
                    state = [*state[1:], s]
        return total

    for string in ("1d10t", "m.o.r.o.n", "sc um", "wo0rrr", "$cum!", "a m o", "x", "日日1a"):
        units = T.lattice(string)
        scores = {}
        for path in itertools.product(*units):
            text = "".join(shown for _, shown, _ in path)
            scores[text] = max(scores.get(text, -math.inf), cost(path))
        assert math.isclose(scores[T.best_path(units, logp)], max(scores.values()), abs_tol=1e-4), string


@pytest.mark.parametrize("word", TOXIC)
def test_disguises_are_undone(logp, word):
    restorer = T.Restorer.of(logp)
    signs = str.maketrans("oiea", "013@")
    for shown in (word.upper(), word.translate(signs), " ".join(word), ".".join(word), word[0] * 4 + word[1:], word[:2] + "-" + word[2:], word + "!!", "ï".join(word.split("i"))):
        assert word in restorer.words(f"he was {shown} there"), shown
    assert restorer.text(" The  quick brown FOX ") == "the quick brown fox" and restorer.text(None) == ""


def test_scores_on_held_out_rows(spark):
    found = texts(900, 2)
    disguised = {i: t.replace("idiot", "1d10t").replace("scum", "s c u m") for i, t in enumerate(found) if i % 3 == 0}
    table = spark.createDataFrame(rows([disguised.get(i, t) for i, t in enumerate(found)]), SCHEMA)
    labels = spark.createDataFrame([(i, None, int(i % 4 == 0)) for i in range(900)] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.toxicity_scores(table, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 900 and all(r.held_out == (i in held) for i, r in got.items())
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_words_of_copies_carry_little_weight(spark):
    same = "zonk " + PROSE
    found = [f"{same} {i}" for i in range(60)] + texts(400, 3)
    table = spark.createDataFrame(rows(found), SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i < 60 or (i - 60) % 4 == 0)) for i in range(460)], "doc_id long, quality int, toxic int")
    lexicon = T.learn(table, labels, T.language_model(table))
    assert lexicon.words.get("zonk", 0) < 0.5 < min(lexicon.words[w] for w in TOXIC)


def test_interval(spark):
    for ones, n in ((1, 1), (5, 5), (3, 40), (200, 200)):
        p, z = ones / n, T.Z
        want = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        got = spark.range(1).select(T.lower_end(T.F.lit(ones), T.F.lit(n)).alias("x")).first().x
        assert math.isclose(got, want)


def test_awkward_rows(spark):
    table = awkward(spark, ["1d10t " * 3000, "a b c d e f g " * 500, "é.é.é.é", "퟿" * 40 + "$$$"])
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 1, 1), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = T.toxicity_scores(table, labels).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert {r.score for r in T.toxicity_scores(table, labels.limit(0)).collect()} == {0.0}
    assert T.toxicity_scores(empty(spark), labels).collect() == []
    assert T.restored_texts(table, T.language_model(table)).count() == table.count()
