"""TF-IDF weights and cosine similarity to one query text, in long form.

Documents are read once and cut into blocks (``term_blocks``). Blocks exchange their distinct
terms, as 96-bit hashes, for document frequencies; weights, norms and dot products are then made
in the block, so no text, term or posting is shuffled. (Two terms of equal hash would add their
document frequencies; among a billion terms the odds of any such pair are 1 to 10¹¹.) The query is
one more document of the corpus. The sums of documents that share a key are added up by key.

A bounded vocabulary is fitted on occurrences counted inside the row: a document's n-grams are
sorted and each run becomes one ``(term, tf)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from confluo import defaults as D
from confluo.functions.labels import let
from confluo.operators import term_blocks
from confluo.operators.ordering import rank_position
from confluo.session import materialize, own_exchange, spread

_ROWS = 1 << 16  # of an Arrow batch


@dataclass(frozen=True)
class Vocabulary:
    """``terms(term, idf)`` and the number of documents it was fitted on."""

    terms: DataFrame
    n_docs: int


def tokens(text: Column, *, pattern: str = D.TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def ngrams(words: Column) -> Column:
    """Unigrams followed by space-joined bigrams."""

    def both(v: Column) -> Column:
        w = v["w"]
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return F.concat(w, pairs)

    return let({"w": words}, both)


def _runs(grams: Column) -> Column:
    """``array<struct<term, tf>>`` of an array: sorted, then one entry per run of equal values."""

    def counted(v: Column) -> Column:
        a = v["a"]
        starts = F.filter(F.transform(a, lambda _, i: i), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return let(
            {"a": a, "s": starts},
            lambda w: F.transform(
                w["s"],
                lambda at, k: F.struct(
                    F.get(w["a"], at).alias("term"), (F.coalesce(F.get(w["s"], k + 1), F.size(w["a"])) - at).alias("tf")
                ),
            ),
        )

    return let({"a": F.sort_array(grams)}, counted)


def term_counts(docs: DataFrame, *, key: str = "id", text: str = "text", pattern: str = D.TOKEN_PATTERN) -> DataFrame:
    """``(key, term, tf)``, one row per document row and distinct n-gram."""
    grams = ngrams(tokens(F.col(text), pattern=pattern))
    return spread(docs.select(F.col(key), F.col(text))).select(F.col(key), F.inline(_runs(grams)))


def _query_counts(docs: DataFrame, query: str, *, pattern: str) -> DataFrame:
    """``(term, tf)`` of the query text. Bounded by the words of the query."""
    one = docs.sparkSession.range(1).select("id", F.lit(query).alias("text"))
    return term_counts(one, pattern=pattern).select("term", "tf")


def _idf(n_docs: int, df: Column) -> Column:
    return F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def most_frequent(stats: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of ``stats(term, tf, …)`` by falling ``tf``, then term.

    A histogram of ``tf`` (as many rows as different frequencies) tells the frequency at which
    the list ends. More frequent terms are kept unsorted; only the terms of just that frequency
    are put in order, in range partitions.
    """
    above = Window.orderBy(F.col("tf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = stats.groupBy("tf").count().withColumn("above", F.coalesce(F.sum("count").over(above), F.lit(0)))
    cut = levels.filter((F.col("above") < n) & (F.col("above") + F.col("count") >= n)).first()
    if cut is None:  # fewer terms than that
        return stats
    last = rank_position(stats.filter(F.col("tf") == cut["tf"]), order=[F.col("term").asc()])
    ending = last.filter(F.col("rank_position") < n - cut["above"]).drop("rank_position")
    return stats.filter(F.col("tf") > cut["tf"]).unionByName(ending)


def fit_vocabulary(
    docs: DataFrame,
    query: str,
    *,
    text: str = "text",
    max_features: int | None = None,
    pattern: str = D.TOKEN_PATTERN,
) -> Vocabulary:
    """Terms of documents plus query with smooth idf; the ``max_features`` most frequent (ties by
    term), if given."""
    rows = docs.select(F.lit(0).alias("id"), F.col(text).alias("text"))
    counts = term_counts(rows, pattern=pattern).select("term", "tf").unionByName(_query_counts(docs, query, pattern=pattern))
    stats = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        stats = most_frequent(materialize(stats, "term-counts"), max_features)
    n_docs = docs.count() + 1
    return Vocabulary(materialize(stats.select("term", "df", _idf(n_docs, F.col("df")).alias("idf")), "vocabulary"), n_docs)


@dataclass(frozen=True)
class _Corpus:
    """Blocks of documents, the query as one more document, and the frequencies each of them got."""

    held: DataFrame
    found: DataFrame
    query: term_blocks.Terms
    n_docs: int

    def idf(self) -> Callable[[np.ndarray], np.ndarray]:
        """idf by document frequency; 0 for terms that are not kept."""
        n = self.n_docs
        return lambda df: np.where(df > 0, np.log((1.0 + n) / (1.0 + df)) + 1.0, 0.0)


def _corpus(docs: DataFrame, query: str, *, key: str, text: str, max_features: int | None, pattern: str) -> _Corpus:
    rows = docs.select(F.col(key), F.col(text))
    held = term_blocks.blocks(rows, tokens(F.col(text), pattern=pattern), key=key)
    words = docs.sparkSession.range(1).select(tokens(F.lit(query), pattern=pattern)).first()[0]
    asked = term_blocks.query_terms(words)
    kept = None if max_features is None else fit_vocabulary(docs, query, text=text, max_features=max_features, pattern=pattern).terms
    n_docs = held.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] + 1
    return _Corpus(held, materialize(term_blocks.frequencies(held, asked, kept=kept), "frequencies"), asked, n_docs)


def _shared_norms(corpus: _Corpus, *, key: str) -> DataFrame | None:
    """``(block, norms)``: for documents whose key others have too, place in the block and the norm
    over all of them. None if keys are unique, as they mostly are."""
    rows = corpus.held.select("block", F.posexplode("keys").alias("at", key)).filter(F.col(key).isNotNull())
    shared = materialize(rows.join(own_exchange(rows.groupBy(key).count().filter("count > 1").select(key)), key), "shared-keys")
    if shared.isEmpty():
        return None
    idf = corpus.idf()

    def squares(block: pa.RecordBatch, terms: term_blocks.Terms, df: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        w = terms.tf * idf(df)[terms.number[terms.term]]
        at, row = np.unique(terms.row, return_inverse=True)
        yield {"block": pa.repeat(block.column("block")[0], len(at)), "at": pa.array(at), "squares": pa.array(np.bincount(row, w * w, len(at)))}

    kind = StructType().add("block", LongType()).add("at", IntegerType()).add("squares", DoubleType())
    some = corpus.held.join(shared.select("block").distinct(), "block", "left_semi")
    parts = shared.join(term_blocks.per_block(some, corpus.found, squares, kind), ["block", "at"])
    norms = parts.groupBy(key).agg(F.sqrt(F.sum("squares")).alias("norm"))
    return shared.join(own_exchange(norms), key).groupBy("block").agg(F.collect_list(F.struct("at", "norm")).alias("norms"))


def tfidf_weights(
    docs: DataFrame,
    query: str,
    *,
    key: str = "id",
    text: str = "text",
    max_features: int | None = None,
    pattern: str = D.TOKEN_PATTERN,
) -> DataFrame:
    """``(key, term, weight)``, L2-normalised over the kept terms of each key. Rows without a key
    count as documents only."""
    corpus = _corpus(docs, query, key=key, text=text, max_features=max_features, pattern=pattern)
    idf, held = corpus.idf(), corpus.held
    norms = _shared_norms(corpus, key=key)
    shared = norms is not None
    if shared:
        held = held.join(norms, "block", "left")

    def weights(block: pa.RecordBatch, terms: term_blocks.Terms, df: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        w = terms.tf * idf(df)[terms.number[terms.term]]
        squares = np.bincount(terms.row, w * w, len(block.column("keys").flatten()))
        norm = np.sqrt(squares)
        if shared:
            of = block.column("norms").flatten()
            norm[of.field("at").to_numpy()] = of.field("norm").to_numpy()
        keys, names = block.column("keys").flatten(), terms.names()
        there = np.flatnonzero(w)
        for i in range(0, len(there), _ROWS):
            some = there[i : i + _ROWS]
            row = terms.row[some]
            yield {key: keys.take(pa.array(row)), "term": names.take(pa.array(terms.term[some])), "weight": pa.array(w[some] / norm[row])}

    kind = StructType().add(key, docs.schema[key].dataType).add("term", StringType()).add("weight", DoubleType())
    return term_blocks.per_block(held, corpus.found, weights, kind).filter(F.col(key).isNotNull())


def cosine_to_query(
    docs: DataFrame,
    query: str,
    *,
    key: str = "id",
    text: str = "text",
    max_features: int | None = None,
    pattern: str = D.TOKEN_PATTERN,
) -> DataFrame:
    """``(key, cosine)`` for documents with at least one kept term; others have similarity 0
    and are absent."""
    corpus = _corpus(docs, query, key=key, text=text, max_features=max_features, pattern=pattern)
    idf, asked = corpus.idf(), corpus.query
    found = corpus.found
    # the words of the query
    mine = term_blocks.in_hash_order(found.filter(F.col("block") == term_blocks.QUERY).select("part", "df").collect())
    wanted = np.zeros(len(asked.h))
    wanted[asked.number[asked.term]] = asked.tf * idf(mine)[asked.number[asked.term]]
    wanted /= np.sqrt((wanted * wanted).sum()) or 1.0
    by_hash = {(int(h), int(g)): w for h, g, w in zip(asked.h, asked.g, wanted, strict=True)}

    def sums(block: pa.RecordBatch, terms: term_blocks.Terms, df: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        of = np.zeros(len(terms.h))
        for i in np.flatnonzero(np.isin(terms.h, np.array([h for h, _ in by_hash], np.uint64))):
            of[i] = by_hash.get((int(terms.h[i]), int(terms.g[i])), 0.0)
        number = terms.number[terms.term]
        w = terms.tf * idf(df)[number]
        keys = block.column("keys").flatten()
        squares, dot = np.bincount(terms.row, w * w, len(keys)), np.bincount(terms.row, w * of[number], len(keys))
        there = np.flatnonzero(squares)
        yield {key: keys.take(pa.array(there)), "squares": pa.array(squares[there]), "dot": pa.array(dot[there])}

    kind = StructType().add(key, docs.schema[key].dataType).add("squares", DoubleType()).add("dot", DoubleType())
    per_doc = term_blocks.per_block(corpus.held, found, sums, kind).groupBy(key).agg(F.sum("squares").alias("squares"), F.sum("dot").alias("dot"))
    return per_doc.select(key, (F.col("dot") / F.sqrt("squares")).alias("cosine"))
