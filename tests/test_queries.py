"""Every registered query against its SQL on the smallest shared tables, and plan shapes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from confluo.checks import ORACLES, QUERIES
from confluo.checks.views import job_events, observations
from confluo.operators import aggregates, dedup

SF = os.environ.get("CONFLUO_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_prunes_before_the_shuffle(spark):
    text = plan(dedup.latest_per_key(job_events(spark, SF)))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_provenance_has_no_second_shuffle_of_rows(spark):
    text = plan(aggregates.agg_provenance(observations(spark, SF)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>" in text


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(aggregates.agg_queue_depth(rows, event_type="error"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in text
    assert "ReadSchema: struct<event_type:string>" in text


def test_hot_key_survives_dedup(spark):
    rows = spark.range(20000).select(
        F.col("id").alias("arrival"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    )
    got = dedup.dedup_first(rows, keys=["k"])
    assert got.count() == rows.select("k").distinct().count()
    assert got.filter("k = 'hot'").collect()[0].arrival == 0
