"""Counts and provenance summaries; all are partial aggregates before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def agg_outcomes(records: DataFrame, *, outcomes: Sequence[str] = D.OUTCOMES) -> DataFrame:
    """One row: a count per outcome class (zeros included), their total, and trust flips
    over all records, known outcome or not."""
    known = F.col("outcome").isin(list(outcomes))
    return records.agg(
        *[_count(F.col("outcome") == o).alias(o) for o in outcomes],
        _count(known).alias("total_records"),
        _count(F.coalesce("trust_flipped", F.lit(False))).alias("trust_flipped"),
    )


def agg_queue_depth(events: DataFrame, *, event_type: str = "possible_duplicate") -> DataFrame:
    return events.filter(F.col("event_type") == event_type).agg(F.count(F.lit(1)).alias("review_queue_depth"))


def agg_ingest_summary(outcomes: DataFrame, *, source: str = "source_name") -> DataFrame:
    """Per source: new (inserted, flagged or not), new source, duplicate."""
    outcome = F.col("outcome")
    return outcomes.groupBy(source).agg(
        _count(outcome.isin("new_job", "review_flagged")).alias("new"),
        _count(outcome == "new_source").alias("new_source"),
        _count(outcome == "duplicate").alias("duplicate"),
    )


def agg_provenance_pairs(observations: DataFrame) -> DataFrame:
    """Per (job, source): first and last seen, and trust; any trusted sighting is enough."""
    return observations.groupBy("job_id", "source_name").agg(
        F.min("seen").alias("first_seen"),
        F.max("seen").alias("last_seen"),
        F.bool_or(F.coalesce(F.col("source_trust") == D.TRUSTED, F.lit(False))).alias("trusted"),
    ).withColumn("source_trust", F.when(F.col("trusted"), D.TRUSTED).otherwise(D.UNTRUSTED)).drop("trusted")


def agg_provenance(observations: DataFrame) -> DataFrame:
    """Per job: number of sources, whether any is untrusted, first and last seen."""
    return (
        agg_provenance_pairs(observations)
        .groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("n_sources"),
            F.max(F.col("source_trust") == D.UNTRUSTED).alias("has_untrusted"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
    )


def agg_health(
    tables: Mapping[str, DataFrame | None], *, versions: DataFrame | None = None, names: Sequence[str] = D.HEALTH_TABLES
) -> DataFrame:
    """Row count per table (``missing`` where absent) and a status from the version count."""
    rows = None
    for name in names:
        table = tables.get(name)
        if table is None:
            continue
        part = table.agg(F.count(F.lit(1)).cast("string").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no table given")
    spark = rows.sparkSession
    absent = [(n, "missing") for n in names if tables.get(n) is None]
    if absent:
        rows = rows.unionByName(spark.createDataFrame(absent, "table_name string, row_count string"))
    applied = F.lit(0).cast("bigint")
    if versions is not None:
        count = versions.agg(F.count(F.lit(1)).cast("string").alias("row_count"))
        rows = rows.unionByName(count.select(F.lit(None).cast("string").alias("table_name"), "row_count"))
        applied = F.coalesce(F.max(F.when(F.col("table_name").isNull(), F.col("row_count").cast("bigint"))), applied)
    # at most one row per table name is gathered here
    gathered = rows.groupBy().agg(
        F.collect_list(F.when(F.col("table_name").isNotNull(), F.struct("table_name", "row_count"))).alias("t"),
        applied.alias("schema_version_count"),
    )
    status = F.when(F.col("schema_version_count") < 2, "warn").otherwise("ok").alias("status")
    return gathered.select(F.inline("t"), "schema_version_count", status)


def agg_skip_reasons(ranked: DataFrame, existing: DataFrame, *, n: int | None = None) -> DataFrame:
    """Why the first ``n`` ranked rows were or were not pushed: ``created``,
    ``skipped_existing``, ``skipped_non_remote`` or ``skipped_<decision>``."""
    from confluo.plans.push import classify_cards

    return classify_cards(ranked, existing, n=n).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def agg_reference_meta(companies: DataFrame) -> DataFrame:
    return companies.agg(
        F.count(F.lit(1)).alias("total"),
        _count(F.coalesce("ats_slug_verified", F.lit(False))).alias("verified_count"),
    )

