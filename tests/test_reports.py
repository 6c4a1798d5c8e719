"""Ranking end to end, push selection and digest."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.operators import tfidf
from confluo.operators.aggregates import agg_skip_reasons
from confluo.operators.ordering import rank_order, rank_position
from confluo.plans import digest, push, rank
from confluo.sinks.writers import sink_ranked

JOBS = "id bigint, title string, company string, location string, description string, source string, is_remote boolean, url string, arrival bigint"


def jobs(spark):
    rows = [
        (1, "Senior GTM Engineer", "Acme", "Remote, US", "gtm engineer and revops", "jobspy", True, "https://j/1", 1),
        (2, "Senior  GTM Engineer ", "ACME", "Remote, US", "gtm engineer", "greenhouse", True, "https://j/2", 2),
        (3, "Registered Nurse", "Clinic", "Remote", "nurse", "lever", True, "https://j/3", 3),
        (4, "GTM Engineer", None, "Remote", "gtm", "lever", True, "https://j/4", 4),
        (5, "Growth Engineer", "Vercel", "Office", "us growth engineer", "lever", False, "https://j/5", 5),
        (6, "Growth Engineer", "Beta", "London", "growth", "lever", True, "https://j/6", 6),
        (7, "Forward Deployed Engineer", "Gamma", "Remote", "customer engineer", "ashby", True, "https://j/7", 7),
    ]
    return spark.createDataFrame(rows, JOBS)


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta")], "id bigint, text string")
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf_weights(docs, "alpha").collect()}
    idf = lambda df: math.log((1 + 3) / (1 + df)) + 1
    raw = {"alpha": 2 * idf(2), "beta": idf(2), "alpha beta": idf(1), "beta alpha": idf(1)}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    assert {t: pytest.approx(w / norm) for t, w in raw.items()} == {t: w for (i, t), w in got.items() if i == 1}
    assert got[(2, "beta")] == pytest.approx(1.0)
    cosine = {r.id: r.cosine for r in tfidf.cosine_to_query(docs, "alpha").collect()}
    assert cosine == {1: pytest.approx(raw["alpha"] / norm), 2: 0.0}


def test_vocabulary_cap(spark):
    docs = spark.createDataFrame([(1, "bb aa aa"), (2, "cc")], "id bigint, text string")
    vocabulary = tfidf.fit_vocabulary(docs, "aa", max_features=3)
    assert sorted(r.term for r in vocabulary.terms.collect()) == ["aa", "aa aa", "bb"] and vocabulary.n_docs == 3


def test_most_frequent_equals_a_sort(spark):
    rows = [(f"t{i:04}", 1 + 1000 // (i + 1)) for i in range(900)]
    table = spark.createDataFrame(rows, "term string, tf long").repartition(7)
    for n in (1, 5, 30, 31, 500, 899, 900, 901):
        want = sorted(t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:n])
        assert sorted(r.term for r in tfidf.most_frequent(table, n).collect()) == want


def test_counts_are_folded_inside_the_row(spark):
    docs = spark.createDataFrame([(1, "aa bb aa bb aa"), (2, ""), (3, None), (3, "cc")], "id bigint, text string")
    got = sorted(tuple(r) for r in tfidf.term_counts(docs).collect())
    assert got == [(1, "aa", 3), (1, "aa bb", 2), (1, "bb", 2), (1, "bb aa", 2), (3, "cc", 1)]
    plan = tfidf.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_cosine_moves_numbers_only(spark):
    """No exchange or sort of the plan has a text or a term in it, and weights agree with it."""
    docs = spark.createDataFrame([(i, "alpha beta " * (i % 5) + f"word{i} gamma") for i in range(50)], "id bigint, text string")
    cosine = tfidf.cosine_to_query(docs, "alpha beta delta")
    plan = cosine._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "regexp_extract_all" not in plan
    weights = {(r.id, r.term): r.weight for r in tfidf.tfidf_weights(docs, "alpha beta delta").collect()}
    asked = tfidf.fit_vocabulary(docs, "alpha beta delta").terms.filter("term in ('alpha', 'beta', 'delta', 'alpha beta', 'beta delta')")
    idf = {r.term: r.idf for r in asked.collect()}
    norm = math.sqrt(sum(x * x for x in idf.values()))
    for r in cosine.collect():
        assert r.cosine == pytest.approx(sum(weights.get((r.id, t), 0) * x / norm for t, x in idf.items()))
    bounded = {r.id: r.cosine for r in tfidf.cosine_to_query(docs, "alpha beta delta", max_features=2).collect()}
    assert bounded[1] == pytest.approx(sum(idf[t] ** 2 for t in ("alpha", "beta")) / math.sqrt(sum(idf[t] ** 2 for t in ("alpha", "beta"))) ** 2, abs=1) and 0 not in bounded


def test_rank_and_decide(spark):
    ranked = rank_position(rank.rank_relevant(jobs(spark), min_score=0.01), order=rank_order(arrival="position"))
    rows = {r.id: r for r in rank.decide_ranked(ranked).collect()}
    assert set(rows) == {2, 5, 7}
    assert rows[2].position == 1 and rows[2].decision == "promoted"
    assert rows[5].decision == "promoted_whitelist_remote" and rows[7].decision == "rejected_title"
    assert rows[7].decision_reason == r"\bforward deployed\b"
    assert sorted(r.rank_position for r in rows.values()) == [0, 1, 2]
    assert rank.rank_relevant(jobs(spark).limit(0)).count() == 0
    audit = rank.score_audit(rank.decide_ranked(ranked), jobs(spark), now=F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r.job_id for r in audit.collect()} == {2, 5, 7}


def test_positions_of_a_long_list(spark):
    """Every row has its position, whatever the number of range partitions; no task has them all."""
    rows = spark.range(100_000).select(
        "id", F.concat(F.lit("Role "), (F.col("id") % 7).cast("string")).alias("title"), F.lit("s").alias("source"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("similarity"), F.col("id").alias("arrival"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.rank_position for r in rank_position(rows).select("id", "rank_position").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(((-r.similarity, r.id) for r in rows.collect()))
    assert [got[i] for _, i in want] == list(range(100_000))
    assert sorted(r.rank_position for r in rank_position(rows, n=10).collect()) == list(range(10))
    assert rank_position(rows.limit(0)).count() == 0


def test_long_lists_are_exported_and_counted_whole(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.col("id").alias("rank_position"), F.concat(F.lit("T"), "id").alias("title"), F.when(F.col("id") % 2000 == 5, "Suno").otherwise("Acme").alias("company"),
        F.lit("u").alias("url"), F.lit("s").alias("source"), F.lit(True).alias("is_remote"), F.lit("R").alias("location"), F.lit(0.4).alias("similarity"), F.lit("promoted").alias("decision"),
    )
    sink_ranked(rows.repartition(5), str(tmp_path / "all"))
    parts = sorted((tmp_path / "all").glob("part-*"))
    assert [json.loads(line)["rank_position"] for p in parts for line in p.read_text().splitlines()] == list(range(30_000))
    sink_ranked(rows, str(tmp_path / "top"), n=7)
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "top").glob("part-*")) == 7
    row = digest.digest_message(rows, spark.createDataFrame([(0, "suno")], "position int, name string")).collect()[0]
    assert row.total == 30_000 and "hits: Suno, Suno, Suno, Suno, Suno\n" in row.message


RANKED = "rank_position bigint, title string, company string, url string, source string, is_remote boolean, location string, similarity double, decision string"


def test_push(spark):
    rows = [
        (0, "A", "X", "u0", "s", True, "Remote", 0.5, "promoted"), (1, "A ", "x", "u1", "s", True, "Remote", 0.4, "promoted"),
        (2, "B", "Y", "u2", "s", False, "SF", 0.3, "shortlisted"), (3, "C", "Z", "u3", "s", False, "SF", 0.3, None),
        (4, "D", "Z", "u4", "s", None, "Remote", 0.3, None), (5, "E", "Z", "u5", "s", True, "R", 0.2, "promoted_whitelist_remote"),
    ]
    ranked = spark.createDataFrame(rows, RANKED)
    existing = spark.createDataFrame([(" e @ z ",)], "title string")
    assert sorted(r.rank_position for r in push.push_select(ranked, existing).collect()) == [0, 4]
    counts = {r.reason: r.n for r in agg_skip_reasons(ranked, existing, n=15).collect()}
    assert counts == {"created": 2, "skipped_existing": 2, "skipped_shortlisted": 1, "skipped_non_remote": 1}


def test_digest(spark):
    rows = [(i, f"T{i}", "Suno" if i else "Acme", f"https://u/{i}", None, i == 0, "R", 0.4 - i / 10, "promoted" if i else None) for i in range(5)]
    listed = spark.createDataFrame([(0, " suno ")], "position int, name string")
    row = digest.digest_message(spark.createDataFrame(rows, RANKED), listed).collect()[0]
    assert row.total == 5 and "5 roles" in row.message and len(row.message) <= D.MESSAGE_LIMIT
    assert "1. 🔥 **T0** @ Acme 🌐 (0.40)" in row.message and "3. 👀 **T2** @ Suno ⭐ (0.20)" in row.message
    assert "T3" not in row.message and "   📍 unknown · https://u/0" in row.message
    assert "Reference company hits: Suno, Suno, Suno, Suno" in row.message
    long = [(i, "T" * 900, "C", "u", "s", True, "R", 0.5, None) for i in range(3)]
    message = digest.digest_message(spark.createDataFrame(long, RANKED), listed).collect()[0].message
    assert len(message) == D.MESSAGE_LIMIT and message.endswith("...")
    empty = digest.digest_message(spark.createDataFrame([], RANKED), listed).collect()[0]
    assert empty.total == 0 and "No new roles" in empty.message
