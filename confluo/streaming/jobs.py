"""Structured Streaming wrappers: each micro-batch runs the batch operator of the same name.

Outputs are append-only folders ``…/batch_id=N``. A replayed batch overwrites its own folder
and reads only the folders before it, so a restart or a lost executor never doubles a row.

``keep`` bounds what a batch looks back at: what happened longer before the batch's clock than
that is not read again (the filter is pushed to the files, whose time ranges are in order). A
job that was last sighted before is then unknown, and is inserted anew when it reappears.
Without ``keep`` the whole past counts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from confluo import defaults as D
from confluo.operators.aggregates import agg_provenance_pairs
from confluo.operators.fold import issue_rows, poll_fold
from confluo.operators.resolve import apply_insert, resolve_outcomes, review_events, telemetry_records, with_keys
from confluo.schemas import EVENT_SCHEMA, POLL_STATE_SCHEMA, STORED_JOB_SCHEMA, columns
from confluo.session import materialize, scratch_scope

Clock = Callable[[int], datetime]
EVENT_LOG = f"{EVENT_SCHEMA}, id string"
SOURCE_LOG = (
    "job_id bigint, source_name string, seen timestamp_ntz, source_trust string, flipped boolean"
)


def utc_clock(_: int) -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _stamp(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def read_before(spark: SparkSession, path: str, schema: str, batch_id: int | None = None) -> DataFrame:
    """Rows of all batches before ``batch_id`` (all when None); empty when nothing is there."""
    try:
        rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    return rows if batch_id is None else rows.filter(F.col("batch_id") < batch_id)


def _recent(rows: DataFrame, moment: datetime, keep: timedelta | None, time: str) -> DataFrame:
    return rows if keep is None else rows.filter(F.col(time) >= _stamp(moment - keep))


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def current_state(spark: SparkSession, state_path: str, batch_id: int | None = None) -> DataFrame:
    """Latest watermark per feed."""
    rows = read_before(spark, f"{state_path}/poll_state", POLL_STATE_SCHEMA, batch_id)
    return rows.groupBy("feed_id").agg(F.max_by("last_polled_at", "batch_id").alias("last_polled_at"))


def stream_poll_fold(
    stream: DataFrame,
    *,
    state_path: str,
    checkpoint: str,
    clock: Clock = utc_clock,
    available_now: bool = True,
    keep: timedelta | None = None,
) -> StreamingQuery:
    """Fold a stream of issue snapshots (``ISSUE_SCHEMA`` plus ``feed_id, ord``) into
    ``state_path/events`` and ``state_path/poll_state``. Push events must already be in
    ``state_path/events``; of several for an issue the earliest counts, then the smallest id,
    ids that are numbers as numbers."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        moment = clock(batch_id)
        now = _stamp(moment)
        events = _recent(read_before(spark, f"{state_path}/events", EVENT_LOG, batch_id), moment, keep, "occurred_at")
        feed = materialize(issue_rows(batch), "poll")
        order = F.struct("occurred_at", F.expr("try_cast(id AS decimal(38, 0))"), "id")
        poll = poll_fold(feed, events, current_state(spark, state_path, batch_id), now=now, push_order=order)
        ident = F.concat_ws(":", F.lit(f"{batch_id:012d}"), "job_id", "event_type")
        _write(poll.events.select(*columns(EVENT_SCHEMA), ident.alias("id")), f"{state_path}/events", batch_id)
        _write(feed.select("feed_id").distinct().withColumn("last_polled_at", now), f"{state_path}/poll_state", batch_id)

    return _start(stream, fold, checkpoint, available_now)


def stream_emit_once(stream: DataFrame, *, time: str = "occurred_at", within: str | None = None) -> DataFrame:
    """One event per (job, type) of an event stream; what was emitted is kept in the state store
    by key. With ``within`` (an interval such as ``30 days``) a pair is forgotten once event time
    has moved on by that much, which bounds the state; ``time`` must then be a timestamp."""
    pair = ["job_id", "event_type"]
    return stream.dropDuplicates(pair) if within is None else stream.withWatermark(time, within).dropDuplicatesWithinWatermark(pair)


def current_sources(
    spark: SparkSession, state_path: str, batch_id: int | None = None, since: datetime | None = None
) -> DataFrame:
    """Provenance as of now: sightings per (job, source), of those from ``since`` on if given; a
    flip trusts all rows of a job."""
    log = read_before(spark, f"{state_path}/sources", SOURCE_LOG, batch_id)
    if since is not None:
        log = log.filter(F.col("seen") >= _stamp(since))
    pairs = agg_provenance_pairs(log)
    flips = log.filter("flipped").select("job_id").distinct().withColumn("__f", F.lit(True))
    return (
        pairs.join(flips, "job_id", "left")
        .withColumn("source_trust", F.when(F.col("__f"), D.TRUSTED).otherwise(F.col("source_trust")))
        .drop("__f")
    )


def jobs_to_meet(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored jobs whose company or URL one of the incoming rows has."""
    keyed = with_keys(incoming)
    companies = keyed.select("company_normalized").distinct()
    urls = keyed.select(F.explode(F.array("stored_url", "probe_url")).alias("url")).distinct()
    columns_ = ["id", "url", "company_normalized", "canonical_key"]
    narrow = jobs.select(*columns_)
    return narrow.join(companies, "company_normalized", "left_semi").unionByName(narrow.join(urls, "url", "left_semi")).select(*columns_).distinct()


def stream_resolve(
    stream: DataFrame,
    *,
    state_path: str,
    checkpoint: str,
    clock: Clock = utc_clock,
    available_now: bool = True,
    fuzzy: bool = True,
    keep: timedelta | None = None,
) -> StreamingQuery:
    """Continuous ingest: resolve each micro-batch against everything before it. Writes
    ``jobs``, ``sources``, ``events`` and ``telemetry`` under ``state_path``.

    Of the stored jobs a batch takes only those that one of its rows can meet: jobs of its
    companies, and jobs under its URLs.
    """

    def resolve(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        moment = clock(batch_id)
        now = _stamp(moment)
        since = None if keep is None else moment - keep
        batch = materialize(batch, "landed")
        jobs = read_before(spark, f"{state_path}/jobs", STORED_JOB_SCHEMA, batch_id)
        sources = current_sources(spark, state_path, batch_id, since)
        if since is not None:  # a job counts as long as one of its sources has sighted it
            jobs = jobs.join(sources.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")
        jobs = jobs_to_meet(jobs, batch)
        outcomes = materialize(resolve_outcomes(jobs, sources, batch, fuzzy=fuzzy), "outcomes")
        _write(apply_insert(batch, outcomes, now=now), f"{state_path}/jobs", batch_id)
        seen = outcomes.groupBy("job_id", "source_name").agg(F.max("trust_flipped").alias("flipped")).select(
            "job_id", "source_name", now.alias("seen"), F.lit(D.TRUSTED).alias("source_trust"), "flipped"
        )
        # a pair that is still untrusted stays so until its job is flipped
        doubtful = sources.filter(F.col("source_trust") == D.UNTRUSTED).select("job_id", "source_name", F.lit(True).alias("u"))
        seen = seen.join(doubtful, ["job_id", "source_name"], "left").withColumn(
            "source_trust", F.when(F.col("u"), D.UNTRUSTED).otherwise(F.col("source_trust"))
        )
        _write(seen.drop("u"), f"{state_path}/sources", batch_id)
        ident = F.concat_ws(":", F.lit(f"{batch_id:012d}"), "job_id", "event_type")
        _write(review_events(outcomes, now=now).withColumn("id", ident), f"{state_path}/events", batch_id)
        _write(telemetry_records(outcomes, now=now), f"{state_path}/telemetry", batch_id)

    return _start(stream, resolve, checkpoint, available_now)


def _start(
    stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool
) -> StreamingQuery:
    def once(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):  # a stream runs for months
            body(batch, batch_id)

    writer = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
