"""Ranking: gates, similarity to the target text, bonus, threshold, order, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import json_build, title_bonus
from confluo.functions.predicates import decide, relevant
from confluo.functions.text import text_blob
from confluo.operators.dedup import dedup_prefer_source
from confluo.operators.joins import join_url_hash
from confluo.operators.ordering import rank_position, topk_ranked
from confluo.operators.tfidf import cosine_to_query
from confluo.session import materialize, spread


@dataclass(frozen=True)
class Profile:
    """What is looked for. All lists are parameters. ``*_chars`` cut descriptions
    and ``max_features`` the vocabulary only where they are given."""

    query: str = D.QUERY_TEXT
    titles: Sequence[str] = D.TARGET_TITLES
    include: Sequence[str] = D.INCLUDE_PATTERNS
    exclude: Sequence[str] = D.EXCLUDE_PATTERNS
    accept: Sequence[str] = D.GEO_ACCEPT
    reject: Sequence[str] = D.GEO_REJECT
    bonus: Sequence[str] = D.BONUS_PATTERNS
    substrings: Sequence[tuple[str, float]] = D.SUBSTRING_BONUSES
    title_patterns: Sequence[str] = D.TITLE_EXCLUSIONS
    geo_patterns: Sequence[str] = D.GEO_EXCLUSIONS
    names: Sequence[str] = D.REMOTE_FIRST_COMPANIES
    threshold: float = D.DECISION_THRESHOLD
    description_chars: int | None = None
    geo_chars: int | None = None
    max_features: int | None = None
    version: str = D.RANKER_VERSION


def _blob(profile: Profile) -> Column:
    c = F.col
    return text_blob(
        c("title"), c("company"), c("location"), c("description"), description_chars=profile.description_chars
    )


def relevance_filter(jobs: DataFrame, *, profile: Profile = Profile()) -> DataFrame:
    """Rows that pass every gate, one per (company, title) with the best source.

    Input ``title, company, location, description, source, is_remote, arrival``; adds
    ``position`` (first arrival of the key).
    """
    c = F.col
    keep = relevant(
        c("title"), c("company"), c("location"), c("description"), c("is_remote"), _blob(profile),
        accept=profile.accept, reject=profile.reject, exclude=profile.exclude,
        include=profile.include, titles=profile.titles, geo_chars=profile.geo_chars,
    )
    # Written once: the gates read whole descriptions, and de-duplication reads its input twice.
    # The row number keeps the optimizer from testing the gates before the rows are dealt out.
    gated = spread(jobs).select("*", keep.alias("__keep"), F.monotonically_increasing_id().alias("__row"))
    passed = materialize(gated.filter("__keep").drop("__keep"), "relevant")
    return dedup_prefer_source(passed.drop("__row"))


def rank_relevant(
    jobs: DataFrame,
    *,
    key: str = "id",
    profile: Profile = Profile(),
    top_k: int = D.TOP_K,
    min_score: float = D.MIN_SCORE,
) -> DataFrame:
    """The ranked rows: gates → cosine → title bonus → threshold on the unrounded score →
    round to 3 digits → top k.

    Candidates are written once to the shared folder: the vocabulary fit, the scoring pass
    and the final projection all read them.
    """
    candidates = materialize(
        relevance_filter(jobs, profile=profile).withColumn("__text", _blob(profile)),
        "candidates",
    )
    cosine = cosine_to_query(
        candidates, profile.query, key=key, text="__text", max_features=profile.max_features
    )
    scored = (
        candidates.drop("__text", "description")
        .join(cosine, key, "left")
        .withColumn(
            "__score",
            F.coalesce("cosine", F.lit(0.0))
            + title_bonus(F.col("title"), patterns=profile.bonus, substrings=profile.substrings),
        )
        .filter(F.col("__score") >= F.lit(min_score))
        .withColumn("similarity", F.round("__score", 3))
    )
    best = topk_ranked(scored, n=top_k, arrival="position")
    return best.select(
        key, "title", "company", "url", "source",
        F.coalesce("is_remote", F.lit(False)).alias("is_remote"),
        "location", "similarity", "position",
    )


def decide_ranked(ranked: DataFrame, *, profile: Profile = Profile()) -> DataFrame:
    c = F.col
    decision, reason = decide(
        c("similarity"), c("title"), c("company"), c("location"), c("is_remote"),
        threshold=profile.threshold, title_patterns=profile.title_patterns,
        geo_patterns=profile.geo_patterns, names=profile.names,
    )
    return ranked.withColumns({"decision": decision, "decision_reason": reason})


def _positioned(ranked: DataFrame, stored: DataFrame) -> DataFrame:
    """Ranked rows with position, then job id by URL hash; unmatched rows leave gaps."""
    if "rank_position" not in ranked.columns:
        from confluo.operators.ordering import rank_order

        ranked = rank_position(ranked, order=rank_order(arrival="position"))
    return join_url_hash(ranked.drop("id", "job_id"), stored)


def score_audit(ranked: DataFrame, stored: DataFrame, *, now: Column, version: str = D.RANKER_VERSION) -> DataFrame:
    """One ``scores`` row per ranked job; input carries ``decision`` and ``decision_reason``."""
    c = F.col
    component = json_build(
        {
            "base_score": c("similarity"),
            "matched_target_titles": F.array().cast("array<string>"),
            "breakdown_available": F.lit(False),
            "reason": c("decision_reason"),
        }
    )
    detail = json_build({"title": c("title"), "company": c("company"), "url": c("url")})
    return _positioned(ranked, stored).select(
        "job_id",
        F.lit(version).alias("ranker_version"),
        c("similarity").alias("score"),
        "rank_position",
        component.alias("component_scores"),
        "decision",
        detail.alias("scoring_detail"),
        now.alias("scored_at"),
    )


def scored_events(ranked: DataFrame, stored: DataFrame, *, now: Column) -> DataFrame:
    detail = json_build({"score": F.col("similarity"), "rank_position": F.col("rank_position")})
    return _positioned(ranked, stored).select(
        "job_id",
        F.lit("scored").alias("event_type"),
        now.alias("occurred_at"),
        F.lit("system").alias("actor"),
        detail.alias("detail"),
    )
