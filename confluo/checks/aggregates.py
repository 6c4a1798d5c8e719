"""Aggregations, de-duplication, order and limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.registry import query, strip, table
from confluo.checks.scalars import norm_company_sql, norm_title_sql, source_priority_sql
from confluo.checks.views import (
    DOCS, JOB_EVENTS, OBSERVATIONS, POSTINGS, docs, job_events, observations, postings,
)
from confluo.operators import aggregates as A
from confluo.operators import dedup
from confluo.operators.ordering import rank_order, rank_position, topk_ranked, topk_recent

c = F.col
NAMED = "coalesce(company, 'None')"

TELEMETRY_SQL = (
    "telemetry AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, CASE event_type WHEN 'click' THEN 'new_job' WHEN 'view' THEN 'duplicate' "
    "WHEN 'purchase' THEN 'review_flagged' ELSE event_type END AS outcome, user_id AS job_id, 's' || CAST(event_id % 5 AS VARCHAR) AS source_name, "
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 7 = 0 END AS trust_flipped, date_trunc('second', ts) AS moment FROM events)"
)


def telemetry(spark, sf):
    kind = F.when(c("event_type") == "click", "new_job").when(c("event_type") == "view", "duplicate")
    n = c("event_id")
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        kind.when(c("event_type") == "purchase", "review_flagged").otherwise(c("event_type")).alias("outcome"),
        c("user_id").alias("job_id"),
        F.lit(None).cast("bigint").alias("matched_job_id"),
        F.concat(F.lit("s"), (n % 5).cast("string")).alias("source_name"),
        F.lit("k").alias("canonical_key"),
        F.lit(None).cast("double").alias("fuzzy_score"),
        F.when(n % 4 != 0, n % 7 == 0).alias("trust_flipped"),
    )


_OUTCOMES_SQL = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in D.OUTCOMES)


@query(
    "agg_outcomes",
    f"WITH {TELEMETRY_SQL} SELECT {_OUTCOMES_SQL}, count(*) FILTER (WHERE outcome IN ('new_job', 'new_source', 'duplicate', 'review_flagged')) AS total_records, "
    "count(*) FILTER (WHERE trust_flipped) AS trust_flipped FROM telemetry",
)
def _agg_outcomes(spark, sf):
    return A.agg_outcomes(telemetry(spark, sf))


@query("agg_queue_depth", "SELECT count(*) AS review_queue_depth FROM events WHERE event_type = 'error'")
def _agg_queue_depth(spark, sf):
    return A.agg_queue_depth(table(spark, sf, "events"), event_type="error")


@query(
    "agg_ingest_summary",
    f"WITH {TELEMETRY_SQL} SELECT source_name, count(*) FILTER (WHERE outcome IN ('new_job', 'review_flagged')) AS \"new\", "
    "count(*) FILTER (WHERE outcome = 'new_source') AS new_source, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate FROM telemetry GROUP BY 1",
)
def _agg_ingest_summary(spark, sf):
    return A.agg_ingest_summary(telemetry(spark, sf))


@query(
    "agg_provenance",
    f"WITH {OBSERVATIONS}, p AS (SELECT job_id, source_name, min(seen) AS f, max(seen) AS l, bool_or(source_trust = 'trusted') AS t FROM observations GROUP BY 1, 2) "
    "SELECT job_id, count(*) AS n_sources, bool_or(NOT t) AS has_untrusted, min(f) AS first_seen, max(l) AS last_seen FROM p GROUP BY 1",
)
def _agg_provenance(spark, sf):
    return A.agg_provenance(observations(spark, sf))


@query(
    "agg_health",
    "SELECT 'jobs' AS table_name, CAST((SELECT count(*) FROM part) AS VARCHAR) AS row_count, 5 AS schema_version_count, 'ok' AS status "
    "UNION ALL SELECT 'events', CAST((SELECT count(*) FROM events) AS VARCHAR), 5, 'ok' UNION ALL SELECT 'companies', CAST((SELECT count(*) FROM customer) AS VARCHAR), 5, 'ok' "
    "UNION ALL SELECT 'job_sources', CAST((SELECT count(*) FROM lineitem) AS VARCHAR), 5, 'ok' UNION ALL SELECT 'scores', 'missing', 5, 'ok' "
    "UNION ALL SELECT 'company_attractions', 'missing', 5, 'ok'",
)
def _agg_health(spark, sf):
    tables = {
        "jobs": table(spark, sf, "part"), "events": table(spark, sf, "events"),
        "companies": table(spark, sf, "customer"), "job_sources": table(spark, sf, "lineitem"),
    }
    return A.agg_health(tables, versions=table(spark, sf, "region"))


@query(
    "agg_reference_meta",
    "SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS verified_count FROM customer",
)
def _agg_reference_meta(spark, sf):
    rows = table(spark, sf, "customer").select(F.when(c("c_acctbal") > 0, True).alias("ats_slug_verified"))
    return A.agg_reference_meta(rows)


_LATEST = "SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY occurred_at DESC, id DESC) AS rn FROM job_events"


@query("latest_per_key", f"WITH {JOB_EVENTS} SELECT id, job_id, occurred_at, event_type, detail FROM ({_LATEST}) WHERE rn = 1")
def _latest_per_key(spark, sf):
    return dedup.latest_per_key(job_events(spark, sf))


@query(
    "terminal_keys",
    f"WITH {JOB_EVENTS} SELECT job_id FROM ({_LATEST}) WHERE rn = 1 AND event_type IN ('offer', 'rejected', 'withdrew')",
)
def _terminal_keys(spark, sf):
    return dedup.terminal_keys(job_events(spark, sf))


_KEY_SQL = f"lower({strip(NAMED)}), regexp_replace(lower({strip('title')}), '\\s+', ' ', 'g')"


@query(
    "dedup_prefer_source",
    f"WITH {DOCS}, k AS (SELECT id, CASE WHEN id % 3 = 0 THEN location ELSE company END AS company, title, source, arrival FROM docs) "
    f"SELECT id, position FROM (SELECT id, min(arrival) OVER (PARTITION BY {_KEY_SQL}) AS position, "
    f"row_number() OVER (PARTITION BY {_KEY_SQL} ORDER BY {source_priority_sql()}, arrival) AS rn FROM k) WHERE rn = 1",
)
def _dedup_prefer_source(spark, sf):
    rows = docs(spark, sf).select(
        "id", F.when(c("id") % 3 == 0, c("location")).otherwise(c("company")).alias("company"),
        "title", "source", "arrival",
    )
    return dedup.dedup_prefer_source(rows).select("id", "position")


@query(
    "dedup_first",
    f"WITH {POSTINGS} SELECT 'company_title' AS rule, min(id) AS id FROM postings GROUP BY {norm_company_sql('company')}, {norm_title_sql('title')} "
    "UNION ALL SELECT 'prefix', min(id) FROM postings GROUP BY lower(company), lower(title) "
    "UNION ALL SELECT 'name', min(id) FROM postings GROUP BY lower(title) UNION ALL SELECT 'url', min(id) FROM postings GROUP BY url",
)
def _dedup_first(spark, sf):
    rows = postings(spark, sf)
    rules = {
        "company_title": dedup.key_company_title(),
        "prefix": dedup.key_company_title_prefix(),
        "name": dedup.key_lower_name("title"),
        "url": ["url"],
    }
    out = None
    for rule, keys in rules.items():
        part = dedup.dedup_first(rows, keys=keys).select(F.lit(rule).alias("rule"), "id")
        out = part if out is None else out.unionByName(part)
    return out


_RANK_SQL = "s AS (SELECT p_partkey AS id, p_name AS title, CASE p_size % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'jobspy' ELSE 'feed' END AS source, round(p_size / 100.0, 3) AS similarity FROM part)"
_RANK_ORDER = f"ORDER BY similarity DESC, {source_priority_sql()}, id"


def _scored(spark, sf):
    return postings(spark, sf).select(
        "id", "arrival", c("name").alias("title"), "source", F.round(c("size") / 100.0, 3).alias("similarity")
    )


@query("topk_ranked", f"WITH {_RANK_SQL} SELECT id, CAST(similarity AS DOUBLE) AS similarity FROM s {_RANK_ORDER} LIMIT 50")
def _topk_ranked(spark, sf):
    return topk_ranked(_scored(spark, sf), n=50).select("id", "similarity")


@query(
    "rank_position",
    f"WITH {_RANK_SQL} SELECT id, row_number() OVER ({_RANK_ORDER}) - 1 AS rank_position FROM s",
)
def _rank_position(spark, sf):
    return rank_position(_scored(spark, sf), order=rank_order()).select("id", "rank_position")


@query(
    "topk_recent",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 168 HOUR "
    "ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
)
def _topk_recent(spark, sf):
    rows = topk_recent(
        table(spark, sf, "orders"), now=F.lit("2001-08-01 00:00:00").cast("timestamp_ntz"), status="O",
        status_col="o_orderstatus", time="o_orderdate", tie="o_orderkey",
    )
    return rows.select("o_orderkey", "o_orderdate")

