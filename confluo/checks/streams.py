"""Change feed folding, as one batch and as a stream run to completion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.fuzzy import resolve_sql
from confluo.checks.registry import lit, mapped, query
from confluo.checks.scalars import canonical_key_sql, ladder_sql, norm_company_sql
from confluo.checks.views import (
    COMMENTS, ISSUES, JOB_EVENTS, POLL_STATE, POSTINGS, PUSHED, issues, job_events, poll_state, postings, pushed,
)
from confluo.operators import fold
from confluo.operators.joins import join_json_key
from confluo.schemas import ISSUE_SCHEMA
from confluo.session import scratch_path
from confluo.streaming import jobs

c = F.col
NOW_TEXT = "2024-01-05 00:00:00"
NOW = datetime(2024, 1, 5)


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


_BASE_SQL = f"{COMMENTS}, {ISSUES}, {PUSHED}, {POLL_STATE}"
_SINCE_SQL = (
    "since AS (SELECT i.*, p.last_polled_at AS watermark FROM issues i LEFT JOIN poll_state p ON p.feed_id = i.feed_id "
    "WHERE p.last_polled_at IS NULL OR i.updated_at >= p.last_polled_at), "
    "known AS (SELECT s.*, e.job_id FROM since s JOIN pushed e ON e.event_type = 'pushed_to_linear' AND json_extract_string(e.detail, '$.linear_issue_id') = s.issue_id)"
)
_TERMINAL = ", ".join(lit(t) for t in D.TERMINAL_TYPES)
_STATE_SQL = (
    f"lastc AS (SELECT conv_id, arg_max({ladder_sql('body')}, turn) FILTER (WHERE true) AS p, max(turn) AS t FROM comments GROUP BY conv_id), "
    f"lastb AS (SELECT c.conv_id, {ladder_sql('c.body')} AS p FROM comments c JOIN lastc l ON l.conv_id = c.conv_id AND l.t = c.turn), "
    f"state AS (SELECT k.job_id, k.ord, 0 AS kind, 0 AS pos, CASE WHEN l.p IN ({_TERMINAL}) THEN l.p ELSE {mapped('k.state_name', D.STATE_EVENTS)} END AS event_type "
    f"FROM known k JOIN lastb l ON l.conv_id = k.conv_id WHERE {mapped('k.state_name', D.STATE_EVENTS)} IS NOT NULL)"
)
_COMMENT_SQL = (
    f"said AS (SELECT k.job_id, k.ord, 1 AS kind, c.turn AS pos, {ladder_sql('c.body')} AS event_type, substr(c.body, 1, 240) AS excerpt FROM known k JOIN comments c ON c.conv_id = k.conv_id "
    "WHERE k.watermark IS NULL OR c.created = '' OR try_cast(replace(c.created, 'Z', '') AS TIMESTAMP) > k.watermark), "
    "spoken AS (SELECT * FROM said WHERE event_type IS NOT NULL)"
)
_ONCE_SQL = (
    "allev AS (SELECT job_id, event_type, ord, kind, pos FROM state UNION ALL SELECT job_id, event_type, ord, kind, pos FROM spoken), "
    "once AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.job_id, a.event_type ORDER BY ord, kind, pos) AS rn FROM allev a "
    "WHERE NOT EXISTS (SELECT 1 FROM pushed s WHERE s.job_id = a.job_id AND s.event_type = a.event_type)) WHERE rn = 1)"
)


def _feed(spark, sf):
    return fold.issue_rows(issues(spark, sf))


def _known(spark, sf):
    rows = fold.feed_since(_feed(spark, sf), poll_state(spark))
    return join_json_key(rows, pushed(spark, sf), issue_id="issue_id")


@query("feed_since", f"WITH {ISSUES}, {POLL_STATE} SELECT i.feed_id, i.issue_id, i.updated_at FROM issues i LEFT JOIN poll_state p ON p.feed_id = i.feed_id WHERE p.last_polled_at IS NULL OR i.updated_at >= p.last_polled_at")
def _feed_since(spark, sf):
    return fold.feed_since(_feed(spark, sf), poll_state(spark)).select("feed_id", "issue_id", "updated_at")


@query("issue_state_events", f"WITH {_BASE_SQL}, {_SINCE_SQL}, {_STATE_SQL} SELECT job_id, event_type, ord FROM state")
def _issue_state_events(spark, sf):
    return fold.issue_state_events(_known(spark, sf)).select("job_id", "event_type", "ord")


@query(
    "comment_events",
    f"WITH {_BASE_SQL}, {_SINCE_SQL}, {_COMMENT_SQL} SELECT job_id, event_type, pos, excerpt FROM spoken",
)
def _comment_events(spark, sf):
    rows = fold.comment_events(_known(spark, sf))
    return rows.select("job_id", "event_type", "pos", F.get_json_object("detail", "$.comment_excerpt").alias("excerpt"))


@query(
    "emit_once",
    f"WITH {_BASE_SQL}, {_SINCE_SQL}, {_STATE_SQL}, {_COMMENT_SQL}, {_ONCE_SQL} SELECT job_id, event_type, kind, pos FROM once",
)
def _emit_once(spark, sf):
    known = _known(spark, sf)
    found = fold.issue_state_events(known).unionByName(fold.comment_events(known))
    return fold.emit_once(found, pushed(spark, sf)).select("job_id", "event_type", "kind", "pos")


@query("stream_emit_once", f"WITH {JOB_EVENTS} SELECT DISTINCT job_id, event_type FROM job_events")
def _stream_emit_once(spark, sf):
    """All events as landed files, in micro-batches of two files; the horizon is longer than the log."""
    landed, out = scratch_path(spark, "event-feed"), scratch_path(spark, "event-out")
    rows = job_events(spark, sf).select("job_id", "event_type", c("occurred_at").cast("timestamp").alias("occurred_at"))
    rows.repartitionByRange(4, "occurred_at").write.parquet(landed)
    stream = spark.readStream.schema("job_id bigint, event_type string, occurred_at timestamp").option("maxFilesPerTrigger", 2).parquet(landed)
    once = jobs.stream_emit_once(stream, within="3650 days")
    run = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "event-checkpoint"))
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("job_id", "event_type")


@query(
    "watermark_advance",
    f"WITH {ISSUES}, {POLL_STATE} SELECT feed_id, CASE WHEN feed_id IN (SELECT feed_id FROM issues WHERE feed_id <> '1') THEN TIMESTAMP '{NOW_TEXT}' ELSE last_polled_at END AS last_polled_at FROM "
    "(SELECT feed_id, last_polled_at FROM poll_state UNION ALL SELECT '2', NULL)",
)
def _watermark_advance(spark, sf):
    polled = _feed(spark, sf).filter(c("feed_id") != "1")
    return fold.watermark_advance(poll_state(spark), polled, now=now())


@query(
    "agg_poll_summary",
    f"WITH {_BASE_SQL}, {_SINCE_SQL}, {_STATE_SQL}, {_COMMENT_SQL}, {_ONCE_SQL} SELECT (SELECT count(*) FROM since) AS issues_seen, "
    "(SELECT count(*) FROM once WHERE kind = 0) AS state_events_emitted, (SELECT count(*) FROM once WHERE kind = 1) AS comment_events_emitted, "
    f"TIMESTAMP '{NOW_TEXT}' AS watermark_advanced_to",
)
def _agg_poll_summary(spark, sf):
    return fold.poll_fold(_feed(spark, sf), pushed(spark, sf), poll_state(spark), now=now()).summary


@query(
    "poll_fold",
    f"WITH {_BASE_SQL}, {_SINCE_SQL}, {_STATE_SQL}, {_COMMENT_SQL}, {_ONCE_SQL} SELECT job_id, event_type, TIMESTAMP '{NOW_TEXT}' AS occurred_at, 'linear_listener' AS actor, kind FROM once",
)
def _poll_fold(spark, sf):
    """The fold as a stream of landed issue files, run until all of them are processed."""
    state, feed = scratch_path(spark, "poll-state"), scratch_path(spark, "poll-feed")
    issues(spark, sf).write.json(feed)
    log = pushed(spark, sf).select(
        "job_id", "event_type", now().alias("occurred_at"), F.lit("system").alias("actor"), "detail",
        c("id").cast("string").alias("id"),
    )
    log.write.parquet(f"{state}/events/batch_id=-1")
    poll_state(spark).write.parquet(f"{state}/poll_state/batch_id=-1")
    stream = spark.readStream.schema(f"feed_id string, ord bigint, {ISSUE_SCHEMA}").json(feed)
    run = jobs.stream_poll_fold(
        stream, state_path=state, checkpoint=scratch_path(spark, "poll-checkpoint"), clock=lambda _: NOW
    )
    run.awaitTermination()
    rows = jobs.read_before(spark, f"{state}/events", jobs.EVENT_LOG).filter(c("batch_id") >= 0)
    kind = F.when(F.get_json_object("detail", "$.linear_state").isNotNull(), 0).otherwise(1).alias("kind")
    return rows.select("job_id", "event_type", "occurred_at", "actor", kind)


@query(
    "stream_resolve",
    f"WITH RECURSIVE {POSTINGS}, fresh AS (SELECT arrival, source, {norm_company_sql('company')} AS block, {canonical_key_sql('title', 'company', 'location')} AS key FROM postings), "
    "old AS (SELECT 0::BIGINT AS id, '' AS block, '' AS key WHERE false), old_sources AS (SELECT 0::BIGINT AS job_id, '' AS source_name, '' AS source_trust WHERE false), "
    f"{resolve_sql(D.DUPLICATE_AT, D.REVIEW_AT)} SELECT outcome, source_name, count(*) AS n FROM resolved GROUP BY ALL",
)
def _stream_resolve(spark, sf):
    """All postings as landed files, resolved in micro-batches of two files."""
    state, landed = scratch_path(spark, "resolve-state"), scratch_path(spark, "resolve-feed")
    rows = postings(spark, sf).select(
        "arrival", "source", F.lit(None).cast("string").alias("source_id"), "url", "title", "company", "location"
    )
    # two landings, the earlier arrivals first: files are taken in the order they were written
    middle = rows.agg(F.percentile_approx("arrival", 0.5)).first()[0]
    for half in (c("arrival") <= middle, c("arrival") > middle):
        rows.filter(half).repartition(2).write.mode("append").json(landed)
    schema = "arrival bigint, source string, source_id string, url string, title string, company string, location string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(landed)
    run = jobs.stream_resolve(
        stream, state_path=state, checkpoint=scratch_path(spark, "resolve-checkpoint"), clock=lambda _: NOW
    )
    run.awaitTermination()
    return spark.read.parquet(f"{state}/telemetry").groupBy("outcome", "source_name").agg(F.count(F.lit(1)).alias("n"))


