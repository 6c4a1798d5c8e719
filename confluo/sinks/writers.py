"""Append and export of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.operators.merge import merge_append_new
from confluo.schemas import EVENT_SCHEMA, columns


def split_events(
    events: DataFrame, *, now: Column | None = None, vocabulary: Sequence[str] = D.EVENT_TYPES
) -> tuple[DataFrame, DataFrame]:
    """``(valid, invalid)`` by event type; actor defaults to ``system`` and time to now. A
    NULL detail stays NULL."""
    have = set(events.columns)
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now

    def column(c: str, default: Column) -> Column:
        return F.coalesce(F.col(c), default) if c in have else default

    rows = events.withColumns(
        {
            "actor": column("actor", F.lit("system")),
            "occurred_at": column("occurred_at", now),
            "detail": column("detail", F.lit(None).cast("string")),
        }
    )
    known = F.coalesce(F.col("event_type").isin(list(vocabulary)), F.lit(False))
    return rows.filter(known), rows.filter(~known)


def sink_events(
    events: DataFrame,
    path: str,
    *,
    now: Column | None = None,
    quarantine: str | None = None,
    vocabulary: Sequence[str] = D.EVENT_TYPES,
) -> None:
    """Append valid events. Unknown types go to ``quarantine``, or fail the write before
    anything is appended."""
    valid, invalid = split_events(events, now=now, vocabulary=vocabulary)
    if quarantine:
        invalid.write.mode("append").parquet(quarantine)
    else:
        bad = invalid.select("event_type").limit(1).collect()
        if bad:
            raise ValueError(f"Unknown event_type {bad[0][0]!r}. Allowed types: {sorted(vocabulary)}")
    valid.select(*columns(EVENT_SCHEMA)).write.mode("append").parquet(path)


def sink_telemetry_daily(records: DataFrame, path: str) -> None:
    """One JSON record per row, in a folder per UTC day of ``ts``."""
    day = F.substring("ts", 1, 10).alias("dt")
    records.select("*", day).write.mode("append").option("ignoreNullFields", False).partitionBy("dt").json(path)


def sink_ranked(ranked: DataFrame, path: str, *, n: int | None = None, order: str = "rank_position") -> None:
    """The ranked rows as JSON lines, in order from file to file and within each; of the first
    ``n`` rows, if given, as one file."""
    rows = ranked.orderBy(order) if n is None else ranked.orderBy(order).limit(n).coalesce(1)
    rows.write.mode("overwrite").json(path)


def sink_reference_merge(stored: DataFrame, incoming: DataFrame, path: str, *, name: str = "name", order: str = "arrival") -> None:
    """Write the reference list with new names appended to a new path; stored rows win. The
    counters are ``agg_reference_meta`` of what was written."""
    merge_append_new(stored, incoming, name=name, order=order).write.mode("overwrite").parquet(path)
