"""Event log, change feed fold, telemetry and streaming."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from confluo.operators import fold, joins
from confluo.operators.aggregates import agg_outcomes
from confluo.operators.dedup import latest_per_key, terminal_keys
from confluo.schemas import EVENT_SCHEMA, ISSUE_SCHEMA
from confluo.session import scratch_root
from confluo.sinks.writers import sink_events, sink_telemetry_daily
from confluo.sources.lists import parse_window, src_telemetry_window
from confluo.streaming import jobs

EVENTS = "id bigint, job_id bigint, event_type string, occurred_at timestamp, detail string"


def log(spark, *sequences):
    rows, n = [], 0
    for job, types in enumerate(sequences):
        for t in types:
            rows.append((n, job, t, datetime(2024, 1, 1) + timedelta(hours=n), None))
            n += 1
    return spark.createDataFrame(rows, EVENTS)


def test_terminal_keys(spark):
    df = log(
        spark, ["scored", "applied", "interview"], ["scored", "applied", "rejected"], ["applied", "offer"],
        ["applied", "withdrew"], ["rejected", "applied"], ["possible_duplicate"], ["pushed_to_linear"],
    )
    assert sorted(r.job_id for r in terminal_keys(df).collect()) == [1, 2, 3]
    assert {r.job_id: r.event_type for r in latest_per_key(df).collect()}[4] == "applied"


def test_sink_events(spark, tmp_path):
    path = str(tmp_path / "events")
    good = spark.createDataFrame([(1, "applied", None), (2, "offer", "{}")], "job_id bigint, event_type string, detail string")
    sink_events(good, path, now=F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = {r.job_id: r for r in spark.read.parquet(path).collect()}
    assert rows[1].detail is None and rows[1].actor == "system" and rows[2].detail == "{}"
    with pytest.raises(ValueError, match="Unknown event_type"):
        sink_events(good.withColumn("event_type", F.lit("nope")), path)
    assert spark.read.parquet(path).count() == 2


def issue(ident, state, *comments, updated="2024-01-03T00:00:00Z", order=0):
    nodes = [
        {"id": f"{ident}-{i}", "body": body, "createdAt": at, "user": {"name": "ann"}}
        for i, (body, at) in enumerate(comments)
    ]
    return {
        "feed_id": "p", "ord": order, "id": ident, "state": {"name": state}, "comments": {"nodes": nodes}, "updatedAt": updated,
    }


def feed(spark, *issues):
    lines = spark.createDataFrame([(json.dumps(i),) for i in issues], "value string")
    parsed = F.from_json("value", f"feed_id string, ord bigint, {ISSUE_SCHEMA}")
    return lines.select(parsed.alias("v")).select("v.*")


def pushes(spark, *idents):
    rows = [(n, n + 100, "pushed_to_linear", json.dumps({"linear_issue_id": x})) for n, x in enumerate(idents)]
    return spark.createDataFrame(rows, "id bigint, job_id bigint, event_type string, detail string")


def marks(spark, at=None):
    rows = [("p", datetime.fromisoformat(at))] if at else []
    df = spark.createDataFrame(rows, "feed_id string, last_polled_at timestamp")
    return df.withColumn("last_polled_at", F.col("last_polled_at").cast("timestamp_ntz"))


def poll(spark, issues, stored, state, **kw):
    now = F.lit("2024-01-05").cast("timestamp_ntz")
    return fold.poll_fold(fold.issue_rows(feed(spark, *issues)), stored, state, now=now, **kw)


def kinds(result):
    return sorted((r.job_id, r.event_type) for r in result.events.collect())


def test_poll_initial_and_repoll(spark):
    issues = [
        issue("A", "In Progress", ("recruiter call", "2024-01-02T00:00:00Z")),
        issue("B", "Done", ("rejected by them", "2024-01-02T00:00:00Z"), order=1),
        issue("C", "Backlog", order=2),
        issue("unknown", "Done", order=3),
    ]
    stored = pushes(spark, "A", "B", "C")
    first = poll(spark, issues, stored, marks(spark))
    assert kinds(first) == [(100, "applied"), (100, "phone_screen"), (101, "rejected")]
    summary = first.summary.collect()[0]
    assert (summary.issues_seen, summary.state_events_emitted, summary.comment_events_emitted) == (4, 2, 1)
    grown = stored.unionByName(first.events.select(F.lit(9).cast("bigint").alias("id"), "job_id", "event_type", "detail"))
    assert kinds(poll(spark, issues, grown, first.state)) == []
    assert [str(r.last_polled_at) for r in first.state.collect()] == ["2024-01-05 00:00:00"]


def test_watermark_gates_comments_not_states(spark):
    issues = [
        issue(
            "A", "In Review", ("applied", "2024-01-01T00:00:00Z"), ("withdrew", "bad date"), ("onsite", ""),
            ("they offered", "2024-01-03T00:00:00+00:00"), updated="2024-01-03T00:00:00Z",
        ),
        issue("B", "Done", updated="2024-01-01T00:00:00Z", order=1),
    ]
    result = poll(spark, issues, pushes(spark, "A", "B"), marks(spark, "2024-01-02"))
    # the last comment reads as terminal, so it refines the state; the repeat is emitted once
    assert kinds(result) == [(100, "interview"), (100, "offer")]


def test_dry_run(spark):
    issues = [issue("A", "Done", ("got an offer", "2024-01-02T00:00:00Z"))]
    result = poll(spark, issues, pushes(spark, "A"), marks(spark), dry_run=True)
    summary = result.summary.collect()[0]
    assert result.events.count() == 0 and result.state.count() == 0
    assert (summary.state_events_emitted, summary.comment_events_emitted) == (1, 1)


def test_parse_window():
    assert parse_window("7") == parse_window("7d") == timedelta(days=7)
    assert parse_window("1h") == timedelta(hours=1) and parse_window("30m") == timedelta(minutes=30)
    assert parse_window("0d") == timedelta(0)
    for bad in ("x", "1w", "", "d"):
        with pytest.raises(ValueError):
            parse_window(bad)


def test_telemetry_flat_files(spark, tmp_path):
    good = {"ts": "2024-01-02T10:00:00Z", "outcome": "new_job", "job_id": 1, "trust_flipped": True}
    (tmp_path / "dedup-2024-01-02.jsonl").write_text(
        json.dumps(good) + "\n{broken\n" + json.dumps({"outcome": "new_job"}) + "\n" + json.dumps({**good, "ts": "soon"}) + "\n"
    )
    (tmp_path / "dedup-2023-12-01.jsonl").write_text(json.dumps(good) + "\n")
    rows = src_telemetry_window(spark, str(tmp_path), now=datetime(2024, 1, 3), last="1d", layout="flat")
    summary = agg_outcomes(rows).collect()[0]
    assert (summary.new_job, summary.duplicate, summary.total_records, summary.trust_flipped) == (1, 0, 1, 1)
    assert src_telemetry_window(spark, str(tmp_path / "none"), now=datetime(2024, 1, 3)).count() == 0


def test_telemetry_daily_round_trip(spark, tmp_path):
    rows = [("2024-01-02T10:00:00Z", "duplicate"), ("2024-01-01T10:00:00Z", "new_job")]
    sink_telemetry_daily(spark.createDataFrame(rows, "ts string, outcome string"), str(tmp_path / "t"))
    back = src_telemetry_window(spark, str(tmp_path / "t"), now=datetime(2024, 1, 3), last="1d")
    assert [r.outcome for r in back.collect()] == ["duplicate"]


def test_stream_poll_fold_is_idempotent(spark, tmp_path):
    state, land = str(tmp_path / "state"), tmp_path / "land"
    land.mkdir()
    (land / "1.json").write_text(json.dumps(issue("A", "In Progress")) + "\n")
    push = pushes(spark, "A").select(
        "job_id", "event_type", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("occurred_at"),
        F.lit("system").alias("actor"), "detail", F.col("id").cast("string").alias("id"),
    )
    push.write.parquet(f"{state}/events/batch_id=-1")
    stream = spark.readStream.schema(f"feed_id string, ord bigint, {ISSUE_SCHEMA}").json(str(land))

    def run():
        jobs.stream_poll_fold(
            stream, state_path=state, checkpoint=str(tmp_path / "cp"), clock=lambda b: datetime(2024, 2, 1 + b)
        ).awaitTermination()
        rows = jobs.read_before(spark, f"{state}/events", f"{EVENT_SCHEMA}, id string")
        return sorted(r.event_type for r in rows.collect())

    assert run() == ["applied", "pushed_to_linear"]
    again = issue("A", "In Progress", ("final round", "2024-03-01T00:00:00Z"), updated="2024-03-01T00:00:00Z")
    (land / "2.json").write_text(json.dumps(again) + "\n")
    assert run() == ["applied", "interview", "pushed_to_linear"]
    assert str(jobs.current_state(spark, state).collect()[0].last_polled_at) == "2024-02-02 00:00:00"


def test_stream_emit_once_forgets_and_restarts(spark, tmp_path):
    """State holds the pairs of the horizon only; a restart goes on without repeats."""
    land, out = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    stream = spark.readStream.schema("job_id bigint, event_type string, occurred_at timestamp").json(str(land))
    sizes = []
    for day in range(20):
        lines = [json.dumps({"job_id": j, "event_type": "applied", "occurred_at": f"2024-01-{day + 1:02}T00:00:00Z"}) for j in range(day * 10, day * 10 + 15)]
        (land / f"{day:02}.json").write_text("\n".join(lines) + "\n")
        run = jobs.stream_emit_once(stream, within="2 days").writeStream.format("parquet").option("path", out)
        run = run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress))
    # five jobs of each day come again on the next, within the horizon
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == list(range(205))
    assert max(sizes) <= 5 * 15 and sizes[-1] <= sizes[8] + 15


def test_poll_fold_looks_back_as_far_as_it_keeps(spark, tmp_path):
    def run(keep, name):
        state, land = str(tmp_path / name / "state"), tmp_path / name / "land"
        land.mkdir(parents=True)
        (land / "1.json").write_text(json.dumps(issue("A", "In Progress")) + "\n")
        push = pushes(spark, "A").withColumns(
            {"occurred_at": F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"), "actor": F.lit("system"), "id": F.col("id").cast("string")}
        )
        push.select("job_id", "event_type", "occurred_at", "actor", "detail", "id").write.parquet(f"{state}/events/batch_id=-1")
        stream = spark.readStream.schema(f"feed_id string, ord bigint, {ISSUE_SCHEMA}").json(str(land))
        jobs.stream_poll_fold(
            stream, state_path=state, checkpoint=str(tmp_path / name / "cp"), clock=lambda b: datetime(2024, 2, 1), keep=keep
        ).awaitTermination()
        return sorted(r.event_type for r in jobs.read_before(spark, f"{state}/events", jobs.EVENT_LOG).collect())

    assert run(timedelta(days=60), "long") == run(None, "all") == ["applied", "pushed_to_linear"]
    assert run(timedelta(days=7), "short") == ["pushed_to_linear"]


def test_first_push_counts_numbers_as_numbers(spark):
    rows = [(1, "pushed_to_linear", '{"linear_issue_id":"A"}', "10"), (2, "pushed_to_linear", '{"linear_issue_id":"A"}', "9")]
    events = spark.createDataFrame(rows, "job_id long, event_type string, detail string, id string")
    issues_ = spark.createDataFrame([("A",)], "issue_id string")
    order = F.struct(F.expr("try_cast(id AS decimal(38, 0))"), "id")
    assert joins.join_json_key(issues_, events, issue_id="issue_id", order=order).first().job_id == 2


def test_a_batch_meets_only_jobs_of_its_companies_and_urls(spark):
    stored = [(1, "https://x/1", "acme", "a|acme|r"), (2, "https://x/2", "beta", "a|beta|r"), (3, "https://x/3", "gamma", None)]
    table = spark.createDataFrame(stored, "id long, url string, company_normalized string, canonical_key string")
    fresh = [(0, "s", None, "https://X/3/", "t", "Acme", "r"), (1, "s", "", "", "t", None, None)]
    rows = spark.createDataFrame(fresh, "arrival bigint, source string, source_id string, url string, title string, company string, location string")
    assert sorted(r.id for r in jobs.jobs_to_meet(table, rows).collect()) == [1, 3]


def test_stream_resolve_keeps_what_is_sighted(spark, tmp_path):
    """With a limit a batch knows the jobs sighted within its window, and no others."""
    schema = "arrival bigint, source string, source_id string, url string, title string, company string, location string"
    state, land = str(tmp_path / "state"), tmp_path / "land"
    land.mkdir()
    before = set(os.listdir(scratch_root(spark)))
    for n in range(6):
        title = "Product Manager" if n in (0, 2, 5) else f"Role number {n}"
        (land / f"{n}.json").write_text(json.dumps({"arrival": n, "source": f"s{n}", "url": f"https://x/{n}", "title": title, "company": "S", "location": "R"}) + "\n")
        jobs.stream_resolve(
            spark.readStream.schema(schema).json(str(land)), state_path=state, checkpoint=str(tmp_path / "cp"),
            clock=lambda b: datetime(2024, 1, 1) + timedelta(days=b), keep=timedelta(days=2), fuzzy=False,
        ).awaitTermination()
    assert set(os.listdir(scratch_root(spark))) == before  # nothing stays behind in scratch
    rows = spark.read.parquet(f"{state}/telemetry").select("source_name", "outcome").collect()
    got = {r.source_name: r.outcome for r in rows}
    # sighted on day 2, gone by day 5
    assert got == {"s0": "new_job", "s1": "new_job", "s2": "new_source", "s3": "new_job", "s4": "new_job", "s5": "new_job"}


def test_stream_resolve_equals_batches(spark, tmp_path):
    state, land = str(tmp_path / "state"), tmp_path / "land"
    land.mkdir()
    schema = "arrival bigint, source string, source_id string, url string, title string, company string, location string"

    def row(n, source, title):
        return json.dumps({"arrival": n, "source": source, "url": f"https://x/{n}", "title": title, "company": "S", "location": "R"})

    (land / "1.json").write_text("\n".join([row(0, "a", "Product Manager"), row(1, "a", "Product Manager")]) + "\n")
    stream = spark.readStream.schema(schema).json(str(land))

    def run():
        jobs.stream_resolve(
            stream, state_path=state, checkpoint=str(tmp_path / "cp"), clock=lambda b: datetime(2024, 2, 1 + b)
        ).awaitTermination()
        return sorted(r.outcome for r in spark.read.parquet(f"{state}/telemetry").collect())

    assert run() == ["duplicate", "new_job"]
    (land / "2.json").write_text("\n".join([row(2, "b", "Senior Product Manager"), row(3, "b", "Nurse")]) + "\n")
    assert run() == ["duplicate", "new_job", "new_job", "new_source"]
    assert jobs.current_sources(spark, state).count() == 3
