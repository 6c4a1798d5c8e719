"""Filters with an order and a limit, and positions of whole ordered lists.

A limit is always ``TakeOrdered`` over partial top-k; positions come from range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions.labels import role_priority, source_priority
from confluo.session import materialize


def by_status_recent(
    df: DataFrame,
    *,
    status: str | None = None,
    n: int = 100,
    status_col: str = "status",
    time: str = "date_first_seen",
    tie: str = "id",
) -> DataFrame:
    rows = df if status is None else df.filter(F.col(status_col) == status)
    return rows.orderBy(F.col(time).desc(), F.col(tie).asc()).limit(n)


def new_since(
    df: DataFrame,
    *,
    now: Column,
    hours: int = 24,
    status: str = "new",
    status_col: str = "status",
    time: str = "date_first_seen",
) -> DataFrame:
    """Rows of one status first seen in the last hours. Sort the result if order matters."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    return df.filter((F.col(status_col) == status) & (F.col(time) >= cutoff))


def topk_recent(
    df: DataFrame,
    *,
    now: Column,
    n: int = 20,
    hours: int = 168,
    status: str = "new",
    status_col: str = "status",
    time: str = "date_first_seen",
    tie: str = "id",
) -> DataFrame:
    rows = new_since(df, now=now, hours=hours, status=status, status_col=status_col, time=time)
    return rows.orderBy(F.col(time).desc(), F.col(tie).asc()).limit(n)


def topk_ranked(
    df: DataFrame, *, n: int, score: str = "similarity", arrival: str = "arrival"
) -> DataFrame:
    """Best rows by (rounded score, role class, source class, arrival)."""
    return df.orderBy(*rank_order(score, arrival)).limit(n)


def rank_order(score: str = "similarity", arrival: str = "arrival") -> Sequence[Column]:
    return [
        F.col(score).desc(),
        role_priority(F.col("title")).asc(),
        source_priority(F.col("source")).asc(),
        F.col(arrival).asc(),
    ]


def rank_position(ranked: DataFrame, *, n: int | None = None, order: Sequence[Column] | None = None) -> DataFrame:
    """0-based position of every row in the final order; of the first ``n`` rows, if given.

    Rows are range-partitioned in that order and written with the number of their part. A part
    starts where the counts of the parts before it end, so each is numbered by itself; only one
    count per part is ever brought together. Rows that the order leaves equal stay in one part.
    """
    by = list(order or rank_order())
    rows = ranked if n is None else ranked.orderBy(*by).limit(n)
    parts = materialize(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranked-parts")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return (
        parts.join(starts, "__part")
        .withColumn("rank_position", (F.col("__start") + within - 1).cast("bigint"))
        .drop("__part", "__start")
    )
