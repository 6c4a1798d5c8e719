"""Selection of ranked rows to push as cards, and the events of pushed cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.labels import card_key, json_build
from confluo.functions.predicates import remote_gate
from confluo.functions.text import strip
from confluo.operators.dedup import first_by
from confluo.operators.joins import join_url_hash


def classify_cards(ranked: DataFrame, existing: DataFrame, *, n: int | None = 15, order: str = "rank_position") -> DataFrame:
    """Adds ``card_key`` and ``reason`` to the first ``n`` ranked rows (all when None).

    A row without decision falls back to the remote gate. Within the batch the first row
    of a title that qualifies is created, later ones are skipped as existing.
    """
    rows = ranked if n is None else ranked.orderBy(order).limit(n)
    rows = rows.withColumn("card_key", card_key(F.col("title"), F.col("company")))
    known = existing.select(F.lower(strip(F.col("title"))).alias("card_key")).distinct()
    rows = rows.join(known.withColumn("__known", F.lit(True)), "card_key", "left")
    decision = F.col("decision")
    gate = (
        F.when(decision.isNull() & ~remote_gate(F.col("is_remote"), F.col("location")), "skipped_non_remote")
        .when(~decision.startswith("promoted"), F.concat(F.lit("skipped_"), decision))
    )
    rows = rows.withColumn("__gate", gate)
    fresh = F.col("__known").isNull() & F.col("__gate").isNull()
    winner = rows.filter(fresh).groupBy("card_key").agg(F.min(order).alias("__first"))
    rows = rows.join(winner, "card_key", "left")
    reason = (
        F.when(F.col("__known"), "skipped_existing")
        .when(F.col("__first") < F.col(order), "skipped_existing")
        .when(F.col("__gate").isNotNull(), F.col("__gate"))
        .otherwise("created")
    )
    return rows.withColumn("reason", reason).drop("__known", "__gate", "__first")


def push_select(ranked: DataFrame, existing: DataFrame, *, n: int | None = 15, order: str = "rank_position") -> DataFrame:
    """Rows to push: promoted (or remote where no decision), new title, first per title."""
    rows = ranked if n is None else ranked.orderBy(order).limit(n)
    decision = F.col("decision")
    passed = F.when(
        decision.isNull(), remote_gate(F.col("is_remote"), F.col("location"))
    ).otherwise(decision.startswith("promoted"))
    rows = rows.filter(passed).withColumn("card_key", card_key(F.col("title"), F.col("company")))
    known = existing.select(F.lower(strip(F.col("title"))).alias("card_key"))
    return first_by(rows.join(known, "card_key", "left_anti"), keys=["card_key"], order=[F.col(order)])


def push_events(created: DataFrame, stored: DataFrame, *, now: Column) -> DataFrame:
    """``pushed_to_linear`` events of created cards (``url, issue_id, issue_url``)."""
    detail = json_build({"linear_issue_id": F.col("issue_id"), "linear_issue_url": F.col("issue_url")})
    return join_url_hash(created.drop("id", "job_id"), stored).select(
        "job_id",
        F.lit("pushed_to_linear").alias("event_type"),
        now.alias("occurred_at"),
        F.lit("system").alias("actor"),
        detail.alias("detail"),
    )
