"""Lookups and merges between two slices of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.fuzzy import best_match_sql
from confluo.checks.registry import query, table
from confluo.checks.scalars import REFERENCE_SQL, canonical_key_sql, norm_company_sql, norm_url_sql, reference
from confluo.checks.views import (
    DOCS, ISSUES, JOB_EVENTS, OBSERVATIONS, POSTINGS, PUSHED, docs, issues, job_events, observations, postings, pushed,
)
from confluo.functions import text as T
from confluo.operators import dedup, joins, merge
from confluo.operators.similar import fuzzy_best_match as best_match

c = F.col
NOW_TEXT = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


# stored pages: even ids; every fourth as the normal form, the rest as written
_STORED_URL = f"SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN {norm_url_sql('url')} ELSE url END AS url FROM pages WHERE page_id % 2 = 0"
_INCOMING_URL = "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN upper(url) ELSE url END AS url FROM pages"


def _stored_urls(spark, sf):
    n = c("page_id")
    url = F.when(n % 4 == 0, T.norm_url(c("url"))).otherwise(c("url"))
    return table(spark, sf, "pages").filter(n % 2 == 0).select(n.alias("id"), url.alias("url"))


def _incoming_urls(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.when(c("page_id") % 5 == 0, F.upper("url")).otherwise(c("url")).alias("url")
    )


@query(
    "join_url_exact",
    f"WITH s AS ({_STORED_URL}), i AS ({_INCOMING_URL}) SELECT i.page_id, coalesce(a.id, b.id) AS matched_id FROM i "
    f"LEFT JOIN s a ON a.url = {norm_url_sql('i.url')} LEFT JOIN s b ON b.url = i.url",
)
def _join_url_exact(spark, sf):
    return joins.join_url_exact(_incoming_urls(spark, sf), _stored_urls(spark, sf)).select("page_id", "matched_id")


@query(
    "join_url_hash",
    f"WITH s AS ({_STORED_URL}), i AS ({_INCOMING_URL}) SELECT i.page_id, min(s.id) AS job_id FROM i "
    f"JOIN s ON md5({norm_url_sql('s.url')}) = md5({norm_url_sql('i.url')}) GROUP BY i.page_id",
)
def _join_url_hash(spark, sf):
    return joins.join_url_hash(_incoming_urls(spark, sf), _stored_urls(spark, sf)).select("page_id", "job_id")


_KEYED_SQL = f"k AS (SELECT id, {canonical_key_sql('title', 'company', 'location')} AS canonical_key, {norm_company_sql('company')} AS company_normalized, size FROM postings)"


def _keyed(spark, sf):
    return postings(spark, sf).select(
        "id", "arrival", "size",
        T.canonical_key(c("title"), c("company"), c("location")).alias("canonical_key"),
        T.norm_company(c("company")).alias("company_normalized"),
    )


@query(
    "join_block_candidates",
    f"WITH {POSTINGS}, {_KEYED_SQL} SELECT i.id, count(*) AS n_candidates, min(s.id) AS first_candidate_id, max(s.id) AS last_candidate_id "
    "FROM k i JOIN k s ON i.company_normalized = s.company_normalized WHERE i.id % 2 = 1 AND s.id % 2 = 0 AND s.size % 5 <> 0 GROUP BY i.id",
)
def _join_block_candidates(spark, sf):
    rows = _keyed(spark, sf)
    stored = rows.filter(c("id") % 2 == 0).withColumn("canonical_key", F.when(c("size") % 5 != 0, c("canonical_key")))
    found = joins.join_block_candidates(rows.filter(c("id") % 2 == 1), stored)
    return found.select("id", "n_candidates", "first_candidate_id", "last_candidate_id")


_FUZZY_SQL = (
    f"{POSTINGS}, {_KEYED_SQL}, names AS (SELECT company_normalized AS block, canonical_key AS b, min(id) AS id FROM k WHERE id % 2 = 0 GROUP BY ALL), "
    "pairs AS (SELECT DISTINCT n.block, i.canonical_key AS a, n.id, n.b FROM k i JOIN names n ON n.block = i.company_normalized WHERE i.id % 2 = 1)"
)


@query(
    "fuzzy_best_match",
    f"WITH {_FUZZY_SQL}, {best_match_sql('pairs')} SELECT k.id AS arrival, best.id AS match_id, best.b AS match_key, round(best.score, 6) AS score, "
    f"coalesce(best.score < {D.REVIEW_AT}, false) AS below_floor FROM k LEFT JOIN best ON best.block = k.company_normalized AND best.a = k.canonical_key WHERE k.id % 2 = 1",
)
def _fuzzy_best_match(spark, sf):
    rows = _keyed(spark, sf)
    found = best_match(rows.filter(c("id") % 2 == 1), rows.filter(c("id") % 2 == 0))
    return found.withColumn("score", F.round("score", 6))


_CLOSED_SQL = (
    "closed AS (SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY occurred_at DESC, id DESC) AS rn FROM job_events) "
    "WHERE rn = 1 AND event_type IN ('offer', 'rejected', 'withdrew'))"
)


@query(
    "anti_terminal",
    f"WITH {JOB_EVENTS}, {_CLOSED_SQL} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT job_id FROM closed)",
)
def _anti_terminal(spark, sf):
    jobs = table(spark, sf, "customer").select(c("c_custkey").alias("id"))
    return joins.anti_terminal(jobs, dedup.terminal_keys(job_events(spark, sf)))


@query(
    "anti_existing_title",
    "WITH cards AS (SELECT p_partkey AS id, lower(p_name || ' @ ' || p_brand) AS k FROM part WHERE p_partkey % 3 <> 0), "
    "old AS (SELECT lower(p_name || ' @ ' || p_brand) AS k FROM part WHERE p_partkey % 3 = 0) "
    "SELECT min(id) AS id, k AS card_key FROM cards WHERE k NOT IN (SELECT k FROM old) GROUP BY k",
)
def _anti_existing_title(spark, sf):
    part = table(spark, sf, "part")
    n = c("p_partkey")
    old = part.filter(n % 3 == 0).select(F.upper(F.concat("p_name", F.lit(" @ "), "p_brand")).alias("title"))
    cards = part.filter(n % 3 != 0).select(
        n.alias("id"), n.alias("arrival"), c("p_name").alias("title"), c("p_brand").alias("company")
    )
    return joins.anti_existing_title(cards, old).select("id", "card_key")


@query("anti_processed", "SELECT page_id, url FROM pages WHERE page_id % 3 <> 1")
def _anti_processed(spark, sf):
    pages = table(spark, sf, "pages")
    done = pages.filter(c("page_id") % 3 == 1).select(c("url").alias("post_url"))
    left = joins.anti_processed(pages.select("page_id", c("url").alias("post_url")), done)
    return left.select("page_id", c("post_url").alias("url"))


@query(
    "join_json_key",
    f"WITH {ISSUES}, {PUSHED} SELECT i.issue_id, arg_min(p.job_id, p.id) AS job_id FROM issues i "
    "JOIN pushed p ON p.event_type = 'pushed_to_linear' AND json_extract_string(p.detail, '$.linear_issue_id') = i.issue_id GROUP BY i.issue_id",
)
def _join_json_key(spark, sf):
    rows = issues(spark, sf).select(c("id").alias("issue_id"))
    return joins.join_json_key(rows, pushed(spark, sf), issue_id="issue_id").select("issue_id", "job_id")


@query(
    "enrich_reference",
    f"WITH {DOCS}, {REFERENCE_SQL} SELECT d.id, r.priority, r.name IS NOT NULL AS is_reference FROM docs d LEFT JOIN reference r ON lower(trim(d.company)) = r.name",
)
def _enrich_reference(spark, sf):
    rows = joins.enrich_reference(docs(spark, sf).select("id", "company"), reference(spark, sf))
    return rows.select("id", "priority", "is_reference")


_BOARDS_SQL = (
    "boards AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'ashby' WHEN 1 THEN 'lever' WHEN 2 THEN 'greenhouse' ELSE 'other' END AS platform, "
    "CASE s_suppkey % 3 WHEN 0 THEN 'customer' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN 1 THEN 'customer-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') "
    "ELSE 'site' || CAST(s_nationkey AS VARCHAR) END AS slug, max(s_suppkey % 7) AS n FROM supplier GROUP BY 1, 2)"
)


@query(
    "probe_first_hit",
    f"WITH {_BOARDS_SQL}, s AS (SELECT c_custkey, c_name, unnest([replace(lower(c_name), '#', ''), replace(lower(c_name), '#', '-'), 'site' || CAST(c_nationkey AS VARCHAR)]) AS slug, "
    "unnest([1, 2, 3]) AS pos FROM customer), h AS (SELECT s.*, b.platform, b.n, row_number() OVER (PARTITION BY c_custkey ORDER BY "
    "CASE b.platform WHEN 'greenhouse' THEN 1 WHEN 'lever' THEN 2 ELSE 3 END, s.pos) AS rn FROM s JOIN boards b ON s.slug = b.slug WHERE b.n > 0 AND b.platform <> 'other') "
    "SELECT c_custkey, platform AS ats_platform, slug AS ats_slug, CAST(n AS BIGINT) AS job_count FROM h WHERE rn = 1",
)
def _probe_first_hit(spark, sf):
    n = c("s_suppkey")
    pad = F.lpad(n.cast("string"), 9, "0")
    platform = F.when(n % 4 == 0, "ashby").when(n % 4 == 1, "lever").when(n % 4 == 2, "greenhouse").otherwise("other")
    slug = F.when(n % 3 == 0, F.concat(F.lit("customer"), pad)).when(n % 3 == 1, F.concat(F.lit("customer-"), pad))
    slug = slug.otherwise(F.concat(F.lit("site"), c("s_nationkey").cast("string")))
    boards = table(spark, sf, "supplier").groupBy(platform.alias("platform"), slug.alias("slug")).agg(
        F.max(n % 7).alias("n_jobs")
    )
    companies = table(spark, sf, "customer").select(
        "c_custkey",
        c("c_name").alias("name"),
        F.concat(F.lit("https://www.site"), c("c_nationkey").cast("string"), F.lit(".com")).alias("website"),
    )
    return joins.probe_first_hit(companies, boards).select("c_custkey", "ats_platform", "ats_slug", "job_count")


_OLD = "TIMESTAMP '2024-01-01 00:00:00'"


def _job_rows(orders):
    old = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return orders.select(
        F.concat(F.lit("o/"), c("o_orderkey").cast("string")).alias("url"),
        c("o_orderpriority").alias("title"),
        F.lit("USD").alias("salary_currency"),
        c("o_totalprice").alias("salary_min"),
        c("o_orderstatus").alias("status"),
        F.lit("{}").alias("metadata"),
        old.alias("date_first_seen"), old.alias("date_last_seen"), old.alias("created_at"), old.alias("updated_at"),
    )


@query(
    "merge_upsert_row",
    "WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN upper(o_orderpriority) || '!' END AS title, "
    "CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 END AS price FROM orders WHERE o_orderkey % 2 = 0) "
    "SELECT 'o/' || CAST(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS url, coalesce(b.title, a.o_orderpriority) AS title, "
    "round(coalesce(b.price, a.o_totalprice), 2) AS salary_min, coalesce(a.o_orderstatus, 'new') AS status, "
    f"CASE WHEN a.o_orderkey IS NULL THEN TIMESTAMP '{NOW_TEXT}' ELSE {_OLD} END AS date_first_seen, "
    f"CASE WHEN b.o_orderkey IS NULL THEN {_OLD} ELSE TIMESTAMP '{NOW_TEXT}' END AS date_last_seen, a.o_orderkey IS NULL AS is_new "
    "FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey",
)
def _merge_upsert_row(spark, sf):
    orders, n = table(spark, sf, "orders"), c("o_orderkey")
    incoming = orders.filter(n % 2 == 0).select(
        F.concat(F.lit("o/"), n.cast("string")).alias("url"),
        F.when(n % 5 != 0, F.concat(F.upper("o_orderpriority"), F.lit("!"))).alias("title"),
        F.when(n % 7 == 0, c("o_totalprice") + 1).alias("salary_min"),
    )
    merged = merge.merge_upsert_row(_job_rows(orders.filter(n % 3 != 0)), incoming, now=now())
    return merged.select(
        "url", "title", F.round("salary_min", 2).alias("salary_min"), "status", "date_first_seen", "date_last_seen", "is_new"
    )


@query(
    "merge_upsert_dim",
    "WITH a AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT * FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT lower(coalesce(a.c_name, b.c_name)) AS canonical_name, coalesce(a.c_name, '  ' || upper(b.c_name)) AS name, "
    "CASE WHEN b.c_custkey IS NOT NULL AND b.c_custkey % 5 <> 0 THEN 'new ' || b.c_mktsegment ELSE a.c_mktsegment END AS industry, "
    "CASE WHEN a.c_custkey IS NULL THEN 'HQ2' ELSE 'HQ' END AS hq_location, CASE WHEN a.c_custkey IS NULL THEN false END AS is_dream, a.c_custkey IS NULL AS is_new "
    "FROM a FULL OUTER JOIN b ON a.c_custkey = b.c_custkey",
)
def _merge_upsert_dim(spark, sf):
    customers, n = table(spark, sf, "customer"), c("c_custkey")
    stored = customers.filter(n % 3 != 0).select(
        F.lower("c_name").alias("canonical_name"), c("c_name").alias("name"), c("c_mktsegment").alias("industry"),
        F.lit("HQ").alias("hq_location"), F.lit(None).cast("boolean").alias("is_dream"),
        now().alias("created_at"), now().alias("updated_at"),
    )
    incoming = customers.filter(n % 2 == 0).select(
        F.concat(F.lit("  "), F.upper("c_name")).alias("name"),
        F.when(n % 5 != 0, F.concat(F.lit("new "), c("c_mktsegment"))).alias("industry"),
        F.lit("HQ2").alias("hq_location"),
    )
    return merge.merge_upsert_dim(stored, incoming, now=now()).select(
        "canonical_name", "name", "industry", "hq_location", "is_dream", "is_new"
    )


@query(
    "mark_seen",
    f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '{NOW_TEXT}' ELSE {_OLD} END AS date_last_seen, "
    f"CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '{NOW_TEXT}' ELSE {_OLD} END AS updated_at FROM pages",
)
def _mark_seen(spark, sf):
    pages = table(spark, sf, "pages")
    old = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stored = pages.select("page_id", "url", old.alias("date_last_seen"), old.alias("updated_at"))
    urls = pages.filter(c("page_id") % 3 == 0).select("url")
    return merge.mark_seen(stored, urls, now=now()).drop("url")


_LIST_A_SQL = (
    "la AS (SELECT c_custkey AS pos, 'Nation  ' || CAST(c_nationkey * 40 + c_custkey % 40 AS VARCHAR) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'http://a/' || CAST(c_custkey AS VARCHAR) END AS website, "
    "c_mktsegment AS industry, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'note ' || CAST(c_custkey AS VARCHAR) END AS notes, c_custkey % 10 = 0 AS dream, "
    "CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' ELSE 'ashby' END AS platform, c_acctbal AS bal FROM customer)"
)
_LIST_B_SQL = (
    "lb AS (SELECT s_suppkey AS pos, 'NATION ' || CAST(s_nationkey * 50 + s_suppkey % 50 AS VARCHAR) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'http://b/' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS url, "
    "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'b note ' || CAST(s_suppkey AS VARCHAR) END AS notes, 'tier_' || CAST(s_suppkey % 3 AS VARCHAR) AS priority, "
    "'attr_' || CAST(s_suppkey % 4 AS VARCHAR) AS attr FROM supplier)"
)


def _lists(spark, sf):
    n, m = c("c_custkey"), c("s_suppkey")
    a = table(spark, sf, "customer").select(
        n.alias("position"),
        F.concat(F.lit("Nation  "), (c("c_nationkey") * 40 + n % 40).cast("string")).alias("name"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("http://a/"), n.cast("string"))).alias("website"),
        c("c_mktsegment").alias("industry"),
        F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("note "), n.cast("string"))).alias("notes"),
        (n % 10 == 0).alias("is_dream_company"),
        F.when(n % 3 == 0, "lever").when(n % 3 == 1, "greenhouse").otherwise("ashby").alias("ats_platform"),
        F.concat(F.lit("slug"), n.cast("string")).alias("ats_slug"),
        (n % 2 == 0).alias("ats_slug_verified"),
        (n % 50).alias("job_count"),
    )
    b = table(spark, sf, "supplier").select(
        m.alias("position"),
        F.concat(F.lit("NATION "), (c("s_nationkey") * 50 + m % 50).cast("string")).alias("name"),
        F.when(m % 2 == 0, F.concat(F.lit("http://b/"), m.cast("string"))).otherwise("").alias("url"),
        F.when(m % 3 != 0, F.concat(F.lit("b note "), m.cast("string"))).alias("notes"),
        F.concat(F.lit("tier_"), (m % 3).cast("string")).alias("priority"),
        F.array(F.concat(F.lit("attr_"), (m % 4).cast("string")), F.lit("shared")).alias("attraction_types"),
        *[F.lit(None).cast("string").alias(x) for x in (
            "why_i_love_this", "status", "discovery_path", "active_role", "active_role_url", "added")],
    )
    return a, b


_NK = "regexp_replace(lower(trim(name)), '\\s+', ' ', 'g')"
_MERGED_SQL = (
    f"{_LIST_A_SQL}, {_LIST_B_SQL}, ga AS (SELECT {_NK} AS k, arg_min(name, pos) AS name, arg_min(coalesce(website, '<null>'), pos) AS website, arg_min(industry, pos) AS industry, "
    f"arg_min(notes, pos) AS notes, bool_or(dream) AS dream FROM la GROUP BY 1), "
    f"pa AS (SELECT k, string_agg(platform, ',' ORDER BY pos) AS platforms FROM (SELECT {_NK} AS k, platform, min(pos) AS pos FROM la GROUP BY 1, 2) GROUP BY k), "
    f"gb AS (SELECT {_NK} AS k, arg_min(name, pos) AS name, min(CASE WHEN url <> '' THEN pos END) AS upos, arg_min(url, pos) AS url1, arg_min(url, pos) FILTER (WHERE url <> '') AS url, "
    "arg_min(notes, pos) FILTER (WHERE notes <> '') AS notes, arg_max(priority, pos) AS priority, arg_max(attr, pos) AS attr, count(*) AS n FROM lb GROUP BY 1), "
    "m AS (SELECT coalesce(ga.k, gb.k) AS canonical_name, coalesce(ga.name, gb.name) AS name, "
    "CASE WHEN ga.k IS NULL THEN coalesce(gb.url, gb.url1) WHEN ga.website NOT IN ('', '<null>') THEN ga.website ELSE coalesce(gb.url, nullif(ga.website, '<null>')) END AS website, ga.industry, pa.platforms, "
    "coalesce(ga.dream, false) OR gb.k IS NOT NULL AS is_dream, CASE WHEN ga.k IS NULL THEN gb.notes ELSE coalesce(nullif(ga.notes, ''), gb.notes, ga.notes) END AS notes, "
    "CASE WHEN ga.k IS NOT NULL AND gb.k IS NOT NULL THEN 'both' WHEN ga.k IS NOT NULL THEN 'yc_seed' WHEN gb.n > 1 THEN 'both' ELSE 'dream_list' END AS source, gb.priority, gb.attr "
    "FROM ga LEFT JOIN pa ON pa.k = ga.k FULL OUTER JOIN gb ON ga.k = gb.k)"
)


@query("merge_two_lists", f"WITH {_MERGED_SQL} SELECT canonical_name, name, website, industry, platforms, is_dream, notes, source, priority, attr FROM m")
def _merge_two_lists(spark, sf):
    merged = merge.merge_two_lists(*_lists(spark, sf))
    return merged.select(
        "canonical_name", "name", "website", "industry",
        F.array_join(F.transform("ats_info", lambda s: s["platform"]), ",").alias("platforms"),
        "is_dream", "notes", "source", "priority",
        F.get("attraction_types", F.lit(0)).alias("attr"),
    )


@query(
    "insert_missing_dim",
    f"WITH {_MERGED_SQL}, fresh AS (SELECT * FROM m WHERE right(canonical_name, 1) NOT IN ('0', '5')) "
    "SELECT canonical_name, attr AS attribute, CAST(1.0 AS DOUBLE) AS weight FROM fresh WHERE attr IS NOT NULL "
    "UNION SELECT canonical_name, 'shared', CAST(1.0 AS DOUBLE) FROM fresh WHERE attr IS NOT NULL",
)
def _insert_missing_dim(spark, sf):
    merged = merge.merge_two_lists(*_lists(spark, sf))
    stored = merged.filter(F.right("canonical_name", F.lit(1)).isin("0", "5")).select("canonical_name")
    fresh = merge.insert_missing_dim(stored, merged)
    return merge.attraction_bridge(fresh).select("canonical_name", "attribute", "weight")


@query(
    "agg_platform_array",
    f"WITH {_LIST_A_SQL}, f AS (SELECT {_NK} AS k, platform, min(pos) AS pos FROM la GROUP BY 1, 2) "
    "SELECT k AS canonical_name, string_agg(platform || ':slug' || CAST(pos AS VARCHAR) || ':' || CAST(pos % 50 AS VARCHAR), ',' ORDER BY pos) AS info FROM f GROUP BY k",
)
def _agg_platform_array(spark, sf):
    a, _ = _lists(spark, sf)
    rows = merge.agg_platform_array(a.withColumn("canonical_name", T.norm_name_simple(c("name"))))
    text = F.transform("ats_info", lambda s: F.concat_ws(":", s["platform"], s["slug"], s["job_count"].cast("string")))
    return rows.select("canonical_name", F.array_join(text, ",").alias("info"))


@query(
    "backfill_legacy_source",
    f"WITH {OBSERVATIONS} SELECT p_partkey AS job_id, 'legacy' AS source_name, TIMESTAMP '{NOW_TEXT}' AS first_seen, 'untrusted' AS source_trust FROM part "
    "WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.job_id = p_partkey AND o.source_name = '0')",
)
def _backfill_legacy_source(spark, sf):
    jobs = table(spark, sf, "part").select(
        c("p_partkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("created_at")
    )
    have = observations(spark, sf).withColumn("source_name", F.when(c("source_name") == "0", "legacy").otherwise(c("source_name")))
    rows = merge.backfill_legacy_source(jobs, have, now=now())
    return rows.select("job_id", "source_name", "first_seen", "source_trust")


@query(
    "merge_append_new",
    "SELECT c_name AS name, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL "
    "SELECT arg_min(n, k), min(k) FROM (SELECT left(c_name, 9) || CAST(c_custkey // 10 AS VARCHAR) || ' ' AS n, c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0) GROUP BY lower(trim(n))",
)
def _merge_append_new(spark, sf):
    return merge.merge_append_new(*append_slices(spark, sf)).select("name", "id")


def append_slices(spark, sf):
    customers, n = table(spark, sf, "customer"), c("c_custkey")
    stored = customers.filter(n % 2 == 0).select(c("c_name").alias("name"), n.alias("id"))
    shared = F.when(n % 9 == 0, F.when(n % 2 == 0, F.upper("c_name")).otherwise(F.lit("  ")))
    name = F.coalesce(shared, F.concat(F.left("c_name", F.lit(9)), F.floor(n / 10).cast("string"), F.lit(" ")))
    return stored, customers.select(name.alias("name"), n.alias("id"), n.alias("arrival"))

