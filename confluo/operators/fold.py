"""Folding a change feed into the event log behind a poll watermark (one poll = one batch)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import json_build, label_map, regex_ladder
from confluo.operators.dedup import first_by
from confluo.operators.joins import join_json_key
from confluo.schemas import EVENT_SCHEMA, columns

COMMENTS = "array<struct<id:string,body:string,createdAt:string,author:string>>"


@dataclass(frozen=True)
class Poll:
    """``events`` to append (empty for a dry run), the new ``state`` and a one-row summary."""

    events: DataFrame
    state: DataFrame
    summary: DataFrame


def issue_rows(feed: DataFrame) -> DataFrame:
    """Landed issue snapshots → ``issue_id, state_name, comments, updated_at`` plus any other
    column. Input follows ``ISSUE_SCHEMA``."""
    keep = [c for c in feed.columns if c not in ("id", "state", "comments", "updatedAt", "identifier", "title", "url")]
    nodes = F.coalesce("comments.nodes", F.array().cast("array<struct<id:string,body:string,createdAt:string,user:struct<name:string>>>"))
    flat = F.transform(
        nodes,
        lambda n: F.struct(
            F.coalesce(n["id"], F.lit("")).alias("id"),
            F.coalesce(n["body"], F.lit("")).alias("body"),
            F.coalesce(n["createdAt"], F.lit("")).alias("createdAt"),
            F.coalesce(n["user"]["name"], F.lit("")).alias("author"),
        ),
    )
    return feed.select(
        *keep,
        F.col("id").alias("issue_id"),
        F.coalesce("state.name", F.lit("")).alias("state_name"),
        flat.alias("comments"),
        _utc(F.col("updatedAt")).alias("updated_at"),
    )


def _utc(text: Column) -> Column:
    return F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def feed_since(feed: DataFrame, poll_state: DataFrame, *, updated: str = "updated_at") -> DataFrame:
    """Rows updated at or after their feed's watermark (all where it has none). Adds
    ``watermark``."""
    marks = poll_state.select("feed_id", F.col("last_polled_at").alias("watermark"))
    joined = feed.join(marks, "feed_id", "left")
    return joined.filter(F.col("watermark").isNull() | (F.col(updated) >= F.col("watermark")))


def issue_state_events(
    issues: DataFrame,
    *,
    mapping: Mapping[str, str] = D.STATE_EVENTS,
    ladder: Sequence[tuple[str, str]] = D.COMMENT_LADDER,
    terminal: Sequence[str] = D.TERMINAL_TYPES,
) -> DataFrame:
    """One event per issue in a mapped state; the last listed comment refines it when it
    reads as terminal. Input ``job_id, issue_id, state_name, comments, ord``."""
    base = label_map(F.col("state_name"), mapping=mapping)
    last = F.try_element_at("comments", F.lit(-1))
    parsed = regex_ladder(last["body"], ladder=ladder)
    refined = F.when(parsed.isin(list(terminal)), parsed).otherwise(base)
    detail = json_build({"linear_issue_id": F.col("issue_id"), "linear_state": F.col("state_name")})
    return issues.filter(base.isNotNull()).select(
        "job_id", refined.alias("event_type"), detail.alias("detail"),
        "ord", F.lit(0).alias("kind"), F.lit(0).alias("pos"),
    )


def comment_events(
    issues: DataFrame,
    *,
    ladder: Sequence[tuple[str, str]] = D.COMMENT_LADDER,
    excerpt: int = D.EXCERPT_CHARS,
) -> DataFrame:
    """One event per comment that reads as one and is newer than the watermark; without a
    watermark or a date every comment counts, an unreadable date is skipped."""
    rows = issues.select("job_id", "ord", "watermark", F.posexplode("comments").alias("pos", "c"))
    created = F.col("c.createdAt")
    fresh = F.col("watermark").isNull() | (created == "") | (_utc(created) > F.col("watermark"))
    kind = regex_ladder(F.col("c.body"), ladder=ladder)
    rows = rows.filter(fresh).withColumn("event_type", kind).filter(F.col("event_type").isNotNull())
    detail = json_build(
        {
            "linear_comment_id": F.col("c.id"),
            "comment_excerpt": F.substring(F.col("c.body"), 1, excerpt),
            "matched_event_type": F.col("event_type"),
            "linear_author": F.col("c.author"),
        }
    )
    return rows.select("job_id", "event_type", detail.alias("detail"), "ord", F.lit(1).alias("kind"), "pos")


def emit_once(candidates: DataFrame, stored: DataFrame, *, order: Sequence[str] = ("ord", "kind", "pos")) -> DataFrame:
    """First candidate per (job, type) that the log does not hold yet."""
    pair = ["job_id", "event_type"]
    fresh = candidates.join(stored.select(*pair), pair, "left_anti")
    return first_by(fresh, keys=pair, order=[F.col(c) for c in order])


def watermark_advance(poll_state: DataFrame, polled: DataFrame, *, now: Column) -> DataFrame:
    """The state with ``now`` for every polled feed."""
    feeds = polled.select("feed_id").distinct()
    moved = feeds.withColumn("last_polled_at", now)
    return poll_state.join(feeds, "feed_id", "left_anti").select("feed_id", "last_polled_at").unionByName(moved)


def agg_poll_summary(issues: DataFrame, emitted: DataFrame, *, now: Column) -> DataFrame:
    """One row: issues seen, state and comment events emitted, watermark."""
    seen = issues.select(F.lit(1).alias("i"), F.lit(None).cast("int").alias("kind"))
    sent = emitted.select(F.lit(0).alias("i"), F.col("kind").cast("int").alias("kind"))
    return seen.unionByName(sent).agg(
        F.coalesce(F.sum("i"), F.lit(0)).cast("bigint").alias("issues_seen"),
        F.count_if(F.col("kind") == 0).alias("state_events_emitted"),
        F.count_if(F.col("kind") == 1).alias("comment_events_emitted"),
        F.max(now).alias("watermark_advanced_to"),
    )


def poll_fold(
    feed: DataFrame,
    events: DataFrame,
    poll_state: DataFrame,
    *,
    now: Column,
    polled: DataFrame | None = None,
    dry_run: bool = False,
    push_order: str | Column = "id",
    mapping: Mapping[str, str] = D.STATE_EVENTS,
    ladder: Sequence[tuple[str, str]] = D.COMMENT_LADDER,
) -> Poll:
    """One poll. ``feed(feed_id, issue_id, state_name, comments, updated_at, ord)``;
    ``events`` is the stored log; ``polled(feed_id)`` names the feeds polled (default: those
    in the feed), whose watermark moves even when nothing changed.

    A dry run emits nothing, leaves the state, and counts every event the log lacks, repeats
    within the poll included.
    """
    issues = feed_since(feed, poll_state)
    known = join_json_key(issues, events, issue_id="issue_id", order=push_order)
    found = issue_state_events(known, mapping=mapping, ladder=ladder).unionByName(
        comment_events(known, ladder=ladder)
    )
    pair = ["job_id", "event_type"]
    if dry_run:
        counted = found.join(events.select(*pair), pair, "left_anti")
        return Poll(counted.limit(0).select(*pair), poll_state, agg_poll_summary(issues, counted, now=now))
    emitted = emit_once(found, events)
    values = {
        "job_id": F.col("job_id"),
        "event_type": F.col("event_type"),
        "occurred_at": now,
        "actor": F.lit("linear_listener"),
        "detail": F.col("detail"),
    }
    return Poll(
        emitted.select(*[values[c].alias(c) for c in columns(EVENT_SCHEMA)], "kind"),
        watermark_advance(poll_state, feed if polled is None else polled, now=now),
        agg_poll_summary(issues, emitted, now=now),
    )
