"""Awkward rows that every operator must take: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row_no long, stats string"

PROSE = "the quick brown fox jumps over a lazy dog and then it sleeps under the old tree near the river bank "


def rows(texts, langs=("en", "fr", None)):
    return [
        (i, t, langs[i % len(langs)], f"s{i % 2}", None if t is None else len(t), "x", 7, "y") for i, t in enumerate(texts)
    ]


def awkward(spark, more=()):
    texts = [None, "", " \n\t ", "a", "A b c", PROSE, PROSE, PROSE.upper(), PROSE * 400, "x" * 30_000, "é" * 50 + " 日本語 🎉 " * 9, *more]
    data = rows(texts)
    data += [data[5], data[5], (None, "no id here but words", None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
