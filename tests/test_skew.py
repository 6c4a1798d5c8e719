"""A key with half of the rows is split over tasks in every lookup."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from confluo.operators import joins

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def low_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(spark, column):
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    return spark.range(0, 60_000, 1, 8).select("id", key.alias(column), F.sha2(F.col("id").cast("string"), 256).alias("body"))


def lookups(spark, column):
    return spark.range(500).select("id", F.concat(F.lit("k"), "id").alias(column)).union(spark.sql(f"SELECT 501L AS id, 'hot' AS {column}"))


CASES = {
    "enrich_reference": lambda s: joins.enrich_reference(rows(s, "company"), lookups(s, "name").withColumn("position", F.col("id")).withColumn("priority", F.col("id"))),
    "join_url_hash": lambda s: joins.join_url_hash(rows(s, "url").drop("id"), lookups(s, "url")),
    "join_block_candidates": lambda s: joins.join_block_candidates(
        rows(s, "company_normalized").drop("id"), lookups(s, "company_normalized").withColumn("canonical_key", F.lit("x"))
    ),
    "join_url_exact": lambda s: joins.join_url_exact(rows(s, "url"), lookups(s, "url")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_hot_key_is_split(spark, low_thresholds, name):
    out = CASES[name](spark)
    assert len(out.collect()) == 60_000
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
