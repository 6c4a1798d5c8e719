"""Weights and cosines by blocks: equal to counting by hand, and moving distinct terms only."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from confluo.operators import term_blocks, tfidf

ROWS = [
    (1, "aa bb aa cc"), (2, "bb, AA bb"), (None, "aa zz cc dd"), (3, None), (4, ""), (5, "x aa"), (2, "cc cc bb"), (6, "ää ßß aa bb"),
    (7, "dd " * 40), (1, "aa bb"), (8, "aa bb aa cc"), (None, "bb"), (9, "dd zz zz"), (2, None),
]


def by_hand(rows, query, pattern=r"\w{2,}", kept=None):
    """``{(key, term, weight)}`` counts and ``{key: cosine}``."""
    def grams(text):
        t = re.findall(pattern, (text or "").lower())
        return Counter(t + [" ".join(p) for p in zip(t, t[1:])])

    counts, asked = [(k, grams(t)) for k, t in rows], grams(query)
    df = Counter(t for _, c in counts for t in c) + Counter(list(asked))
    idf = {t: math.log((2 + len(rows)) / (1 + d)) + 1 for t, d in df.items() if kept is None or t in kept}
    squares, dot = defaultdict(float), defaultdict(float)
    for k, c in counts:
        for t in c.keys() & idf.keys():
            squares[k] += (c[t] * idf[t]) ** 2
            dot[k] += c[t] * idf[t] * asked[t] * idf[t]
    weights = Counter((k, t, round(n * idf[t] / math.sqrt(squares[k]), 9)) for k, c in counts if k is not None for t, n in c.items() if t in idf)
    length = math.sqrt(sum((asked[t] * idf[t]) ** 2 for t in asked if t in idf)) or 1
    return weights, {k: pytest.approx(dot[k] / math.sqrt(squares[k]) / length) for k in squares}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(term_blocks, "blocks", partial(term_blocks.blocks, block_words=7))
    monkeypatch.setattr(term_blocks, "RANGE_TERMS", 2)


def got(docs, query, **how):
    weights = Counter((r.id, r.term, round(r.weight, 9)) for r in tfidf.tfidf_weights(docs, query, **how).collect())
    return weights, {r.id: r.cosine for r in tfidf.cosine_to_query(docs, query, **how).collect()}


def test_shared_and_missing_keys_over_many_blocks(spark, small):
    docs = spark.createDataFrame(ROWS, "id bigint, text string").coalesce(2)
    assert got(docs, "aa bb unheard aa") == by_hand(ROWS, "aa bb unheard aa")


def test_vocabulary_bound(spark, small):
    docs = spark.createDataFrame(ROWS, "id bigint, text string").coalesce(1)
    kept = {r.term for r in tfidf.fit_vocabulary(docs, "aa bb", max_features=4).terms.collect()}
    assert len(kept) == 4 and got(docs, "aa bb", max_features=4) == by_hand(ROWS, "aa bb", kept=kept)


def test_words_with_spaces_read_like_pairs(spark):
    rows = [(1, "aa bb cc"), (2, "aa, bb"), (3, "aa bb, aa, bb")]
    pattern = r"\w+(?: \w+)?"
    docs = spark.createDataFrame(rows, "id bigint, text string")
    assert got(docs, "aa bb", pattern=pattern) == by_hand(rows, "aa bb", pattern)


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([("a", ""), ("b", None)], "id string, text string")
    assert got(docs, "aa") == got(docs.limit(0), "") == (Counter(), {})


def test_only_blocks_are_exchanged(spark):
    """No exchange of terms or postings, no join on them: frequencies come to the blocks."""
    docs = spark.createDataFrame([(i, f"alpha beta word{i % 9} gamma") for i in range(200)], "id bigint, text string")
    plan = tfidf.tfidf_weights(docs, "alpha")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and all("hashpartitioning(block" in line for line in moved)


def test_cosine_joins_no_postings(spark):
    docs = spark.createDataFrame([(i, f"alpha beta word{i % 9} gamma") for i in range(200)], "id bigint, text string")
    assert "Join" not in tfidf.cosine_to_query(docs, "alpha word3")._jdf.queryExecution().executedPlan().toString()


def test_a_block_sends_each_term_once():
    """A hundred copies of a document ask for as many bytes as two."""
    def bytes_of(n):
        words = pa.array([f"w{i}" for i in range(500)])
        own = term_blocks.Terms(words, np.tile(np.arange(500), n), np.full(n, 500))
        assert own.documents().tolist() == [n] * 999
        return term_blocks._asked(0, own.h, own.g, own.documents(), 4).nbytes

    assert bytes_of(100) <= bytes_of(2) + 100


def test_equal_first_hashes_are_told_apart():
    h, g = np.array([5, 1, 5, 5, 1], np.uint64), np.array([9, 3, 2, 9, 3], "<u4")
    order, starts = term_blocks._in_order(h, g)
    assert list(zip(h[order].tolist(), g[order].tolist())) == [(1, 3), (1, 3), (5, 2), (5, 9), (5, 9)]
    assert starts.tolist() == [True, False, True, True, False]
