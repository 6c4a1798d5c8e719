"""Entity resolution of part- and line-derived postings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.fuzzy import resolve_sql
from confluo.checks.joins import NOW_TEXT, now
from confluo.checks.registry import query, table
from confluo.checks.scalars import canonical_key_sql, norm_company_sql
from confluo.checks.views import OBSERVATIONS, POSTINGS, observations, postings
from confluo.functions import text as T
from confluo.operators import resolve as R

c = F.col
STORED = "id bigint, url string, company_normalized string, canonical_key string"
SOURCES = "job_id bigint, source_name string, source_trust string"


def _none(spark, schema):
    return spark.createDataFrame([], schema)


def _incoming(spark, sf):
    """Every posting of the part table, in arrival order; each fifth has no URL."""
    return postings(spark, sf).select(
        "arrival", "source", F.when(c("id") % 2 == 0, c("id").cast("string")).alias("source_id"),
        F.when(c("id") % 5 != 0, c("url")).alias("url"), "title", "company", "location",
    )


def _stored(spark, sf):
    """A third of the postings as already stored jobs, half of them of untrusted origin."""
    rows = postings(spark, sf).filter(c("id") % 3 == 0)
    key = T.canonical_key(c("title"), c("company"), c("location"))
    jobs = rows.select(
        "id", F.concat("url", F.lit("/old")).alias("url"), T.norm_company(c("company")).alias("company_normalized"),
        key.alias("canonical_key"),
    )
    sources = rows.select(
        c("id").alias("job_id"),
        F.when(c("id") % 2 == 0, "legacy").otherwise(c("source")).alias("source_name"),
        F.when(c("id") % 2 == 0, "untrusted").otherwise("trusted").alias("source_trust"),
    )
    # stored keys are unique: keep the first job of each
    first = jobs.groupBy("company_normalized", "canonical_key").agg(F.min("id").alias("id")).select("id")
    return jobs.join(first, "id"), sources.join(first.select(c("id").alias("job_id")), "job_id")


_BATCH_SQL = (
    f"{POSTINGS}, keyed AS (SELECT *, {canonical_key_sql('title', 'company', 'location')} AS key, {norm_company_sql('company')} AS block FROM postings), "
    "fresh AS (SELECT arrival, source, block, key FROM keyed), old AS (SELECT block, key, min(id) AS id FROM keyed WHERE id % 3 = 0 GROUP BY ALL), "
    "old_sources AS (SELECT k.id AS job_id, CASE WHEN k.id % 2 = 0 THEN 'legacy' ELSE k.source END AS source_name, "
    "CASE WHEN k.id % 2 = 0 THEN 'untrusted' ELSE 'trusted' END AS source_trust FROM keyed k JOIN old ON old.id = k.id), "
    f"{resolve_sql(D.DUPLICATE_AT, D.REVIEW_AT)}"
)


@query(
    "resolve_batch",
    f"WITH RECURSIVE {_BATCH_SQL} SELECT arrival, outcome, job_first, round(fuzzy_score, 6) AS fuzzy_score, trust_flipped, source_name, canonical_key, matched_canonical_key FROM resolved",
)
def _resolve_batch(spark, sf):
    found = R.resolve_outcomes(*_stored(spark, sf), _incoming(spark, sf))
    first = F.min("arrival").over(Window.partitionBy("job_id"))  # names the job: ids are hashes
    return found.select(
        "arrival", "outcome", first.alias("job_first"), F.round("fuzzy_score", 6).alias("fuzzy_score"), "trust_flipped", "source_name", "canonical_key",
        "matched_canonical_key",
    )


@query(
    "review_events",
    f"WITH RECURSIVE {_BATCH_SQL} SELECT 'possible_duplicate' AS event_type, TIMESTAMP '{NOW_TEXT}' AS occurred_at, 'system' AS actor, round(fuzzy_score, 6) AS fuzzy_score, "
    "canonical_key AS key_new, matched_canonical_key AS key_matched FROM resolved WHERE outcome = 'review_flagged'",
)
def _review_events(spark, sf):
    outcomes = R.resolve_outcomes(*_stored(spark, sf), _incoming(spark, sf))
    detail = lambda name: F.get_json_object("detail", f"$.{name}")
    return R.review_events(outcomes, now=now()).select(
        "event_type", "occurred_at", "actor", F.round(detail("fuzzy_score").cast("double"), 6).alias("fuzzy_score"),
        detail("canonical_key_new").alias("key_new"), detail("canonical_key_matched").alias("key_matched"),
    )


# one posting per order line: the part is the job, its URL the part's, the supplier the source
_LINES_SQL = (
    "lines AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + (l_partkey % 100000) * 10000 + l_suppkey % 10000 AS arrival, 's' || CAST(l_suppkey % 5 AS VARCHAR) AS source, "
    "'https://parts.example/' || CAST(p_partkey AS VARCHAR) AS url, p_name AS title, p_brand AS company, p_type AS location FROM lineitem JOIN part ON p_partkey = l_partkey)"
)


def _lines(spark, sf):
    part = table(spark, sf, "part")
    order = (c("l_orderkey") * 10 + c("l_linenumber")) * 1000000000
    return table(spark, sf, "lineitem").join(part, c("l_partkey") == c("p_partkey")).select(
        (order + (c("l_partkey") % 100000) * 10000 + c("l_suppkey") % 10000).alias("arrival"),
        F.concat(F.lit("s"), (c("l_suppkey") % 5).cast("string")).alias("source"),
        F.lit(None).cast("string").alias("source_id"),
        F.concat(F.lit("https://parts.example/"), c("p_partkey").cast("string")).alias("url"),
        c("p_name").alias("title"), c("p_brand").alias("company"), c("p_type").alias("location"),
    )


_EXACT_SQL = (
    f"{_LINES_SQL}, k AS (SELECT *, {canonical_key_sql('title', 'company', 'location')} AS key, {norm_company_sql('company')} AS co FROM lines), "
    "b AS (SELECT *, min(arrival) OVER (PARTITION BY key) AS born FROM k), "
    "j AS (SELECT b.*, n.url AS job_url, row_number() OVER (PARTITION BY b.key, b.source ORDER BY b.arrival) AS nth FROM b JOIN k n ON n.arrival = b.born)"
)


def _exact(spark, sf):
    return R.resolve_outcomes(_none(spark, STORED), _none(spark, SOURCES), _lines(spark, sf), fuzzy=False)


@query(
    "resolve_exact_only",
    f"WITH {_EXACT_SQL} SELECT arrival, CASE WHEN arrival = born THEN 'new_job' WHEN nth = 1 THEN 'new_source' ELSE 'duplicate' END AS outcome, "
    "CASE WHEN arrival <> born AND url <> job_url THEN CAST(100.0 AS DOUBLE) END AS fuzzy_score, false AS trust_flipped, source AS source_name, key AS canonical_key FROM j",
)
def _resolve_exact_only(spark, sf):
    return _exact(spark, sf).select("arrival", "outcome", "fuzzy_score", "trust_flipped", "source_name", "canonical_key")


@query(
    "apply_insert",
    f"WITH {_EXACT_SQL} SELECT url, md5(lower(url)) AS url_hash, title, company, source, co AS company_normalized, key AS canonical_key, 'USD' AS salary_currency, 'new' AS status, '{{}}' AS metadata, "
    f"TIMESTAMP '{NOW_TEXT}' AS date_first_seen FROM j WHERE arrival = born",
)
def _apply_insert(spark, sf):
    rows = R.apply_insert(_lines(spark, sf), _exact(spark, sf), now=now())
    return rows.select(
        "url", "url_hash", "title", "company", "source", "company_normalized", "canonical_key", "salary_currency",
        "status", "metadata", "date_first_seen",
    )


_SLICES_SQL = (
    f"{OBSERVATIONS}, old AS (SELECT job_id, source_name, min(seen) AS first_seen, max(seen) AS last_seen, CASE WHEN bool_or(source_trust = 'trusted') THEN 'trusted' ELSE 'untrusted' END AS source_trust "
    "FROM observations WHERE seen < TIMESTAMP '1997-01-01' GROUP BY 1, 2), new AS (SELECT DISTINCT job_id, source_name FROM observations WHERE seen >= TIMESTAMP '1997-01-01'), "
    "gain AS (SELECT DISTINCT job_id FROM new WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.job_id = new.job_id AND o.source_name = new.source_name)), "
    "flip AS (SELECT DISTINCT job_id FROM old WHERE source_trust = 'untrusted' AND job_id IN (SELECT job_id FROM gain))"
)


def _slices(spark, sf):
    from confluo.operators.aggregates import agg_provenance_pairs

    rows = observations(spark, sf)
    old = agg_provenance_pairs(rows.filter(c("seen") < F.lit("1997-01-01").cast("timestamp_ntz")))
    new = rows.filter(c("seen") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("job_id", "source_name").distinct()
    return old, new


@query(
    "apply_provenance",
    f"WITH {_SLICES_SQL} SELECT coalesce(o.job_id, n.job_id) AS job_id, coalesce(o.source_name, n.source_name) AS source_name, "
    f"CASE WHEN o.job_id IS NULL THEN TIMESTAMP '{NOW_TEXT}' ELSE o.first_seen END AS first_seen, CASE WHEN n.job_id IS NOT NULL THEN TIMESTAMP '{NOW_TEXT}' ELSE o.last_seen END AS last_seen, "
    "CASE WHEN coalesce(o.job_id, n.job_id) IN (SELECT job_id FROM flip) THEN 'trusted' ELSE coalesce(o.source_trust, 'trusted') END AS source_trust "
    "FROM old o FULL OUTER JOIN new n ON o.job_id = n.job_id AND o.source_name = n.source_name",
)
def _apply_provenance(spark, sf):
    old, new = _slices(spark, sf)
    stored = old.withColumns({"source_url": F.lit(None).cast("string"), "raw_payload": F.lit(None).cast("string")})
    known = old.select("job_id", "source_name", F.lit(True).alias("k"))
    doubt = old.filter("source_trust = 'untrusted'").select("job_id").distinct().withColumn("d", F.lit(True))
    outcomes = new.join(known, ["job_id", "source_name"], "left").join(doubt, "job_id", "left").select(
        "job_id", "source_name",
        F.when(c("k"), "duplicate").otherwise("new_source").alias("outcome"),
        (c("k").isNull() & c("d").isNotNull()).alias("trust_flipped"),
        F.lit(0).cast("bigint").alias("arrival"),
    )
    rows = R.apply_provenance(stored, outcomes, now=now())
    return rows.select("job_id", "source_name", "first_seen", "last_seen", "source_trust")


@query(
    "trust_flip",
    f"WITH {_SLICES_SQL} SELECT job_id, source_name, CASE WHEN job_id IN (SELECT job_id FROM flip) THEN 'trusted' ELSE source_trust END AS source_trust, "
    "job_id IN (SELECT job_id FROM flip) AS trust_flipped FROM old",
)
def _trust_flip(spark, sf):
    return R.trust_flip(*_slices(spark, sf)).select("job_id", "source_name", "source_trust", "trust_flipped")


