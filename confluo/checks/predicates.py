"""Gates, filters and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.registry import any_in, any_match, case, lit, matches, query, strip, table
from confluo.checks.scalars import canonical_key_sql, norm_company_sql, source_priority_sql, text_blob_sql
from confluo.checks.views import DOCS, POSTINGS, docs, postings
from confluo.functions import predicates as P
from confluo.operators.merge import needs_backfill as backfill
from confluo.operators.ordering import by_status_recent, new_since
from confluo.plans.rank import Profile, relevance_filter

c = F.col
NONE = 'None'
# whole descriptions: no gate looks at a prefix
WHOLE = Profile(description_chars=None, geo_chars=None)


def first_pattern_sql(x: str, patterns) -> str:
    return case([(matches(x, p), lit(p)) for p in patterns])


@query("first_pattern_title", f"WITH {DOCS} SELECT id, {first_pattern_sql('title', D.TITLE_EXCLUSIONS)} AS pattern FROM docs")
def _first_pattern_title(spark, sf):
    return docs(spark, sf).select("id", P.first_pattern_title(c("title")).alias("pattern"))


@query(
    "first_pattern_title_location",
    "WITH " + DOCS + " SELECT id, " + first_pattern_sql("(title || ' ' || coalesce(location, ''))", D.GEO_EXCLUSIONS) + " AS pattern FROM docs",
)
def _first_pattern_title_location(spark, sf):
    return docs(spark, sf).select("id", P.first_pattern_title_location(c("title"), c("location")).alias("pattern"))


@query("whitelist_exact", f"WITH {DOCS} SELECT id, lower(company) IN ('vercel', 'src7', 'src11') AS listed FROM docs")
def _whitelist_exact(spark, sf):
    return docs(spark, sf).select("id", P.whitelist_exact(c("company"), names=("VERCEL", "src7", "Src11")).alias("listed"))


def remote_gate_sql() -> str:
    place = "lower(coalesce(location, ''))"
    return (
        f"CASE WHEN coalesce(is_remote, false) THEN true WHEN {any_in(place, D.NON_REMOTE_MARKERS)} THEN false "
        f"ELSE {any_in(place, ('remote', 'anywhere'))} END"
    )


_NAMES_SQL = "lower(company) IN (" + ", ".join(lit(n.lower()) for n in D.REMOTE_FIRST_COMPANIES) + ")"


@query("remote_gate", f"WITH {DOCS} SELECT id, {remote_gate_sql()} AS passed FROM docs")
def _remote_gate(spark, sf):
    return docs(spark, sf).select("id", P.remote_gate(c("is_remote"), c("location")).alias("passed"))


@query("remote_gate_or_whitelist", f"WITH {DOCS} SELECT id, ({_NAMES_SQL}) OR ({remote_gate_sql()}) AS passed FROM docs")
def _remote_gate_or_whitelist(spark, sf):
    return docs(spark, sf).select(
        "id", P.remote_gate_or_whitelist(c("company"), c("is_remote"), c("location")).alias("passed")
    )


def low_sql(x: str) -> str:
    return f"lower({strip(f'coalesce({x}, {lit(NONE)})')})"


def geo_sql() -> str:
    text = f"({low_sql('title')} || ' ' || {low_sql('location')} || ' ' || lower(coalesce(description, 'None')))"
    return (
        f"CASE WHEN {any_in(text, D.GEO_REJECT)} THEN false WHEN {any_in(text, D.GEO_ACCEPT)} THEN true "
        "ELSE coalesce(is_remote, false) END"
    )


@query("geo_gate", f"WITH {DOCS} SELECT id, {geo_sql()} AS passed FROM docs")
def _geo_gate(spark, sf):
    return docs(spark, sf).select(
        "id",
        P.geo_gate(c("title"), c("location"), c("description"), c("is_remote"), description_chars=None).alias("passed"),
    )


_TITLES = ("red widget", "small", "ring", "blue gear and more", "tiny")


def curated_sql(x: str, titles) -> str:
    low = low_sql(x)
    return "(" + " OR ".join(f"contains({low}, {lit(t.lower())}) OR contains({lit(t.lower())}, {low})" for t in titles) + ")"


@query("curated_title_hit", f"SELECT p_partkey AS id, {curated_sql('p_name', _TITLES)} AS hit FROM part")
def _curated_title_hit(spark, sf):
    return table(spark, sf, "part").select(
        c("p_partkey").alias("id"), P.curated_title_hit(c("p_name"), titles=_TITLES).alias("hit")
    )


def relevant_sql() -> str:
    """The candidates of the ranking, one per (company, title), over whole texts."""
    body = f"({low_sql('title')} || ' ' || {text_blob_sql()})"
    named = f"{low_sql('company')} NOT IN (" + ", ".join(lit(s) for s in D.SENTINEL_COMPANIES) + ")"
    passed = (
        f"gated AS (SELECT * FROM docs WHERE {named} AND ({geo_sql()}) AND NOT {any_match(body, D.EXCLUDE_PATTERNS)} "
        f"AND ({curated_sql('title', D.TARGET_TITLES)} OR {any_match(body, D.INCLUDE_PATTERNS)}))"
    )
    key = f"{low_sql('company')}, regexp_replace({low_sql('title')}, '\\s+', ' ', 'g')"
    return (
        f"{DOCS}, {passed}, candidates AS (SELECT * FROM (SELECT *, min(arrival) OVER (PARTITION BY {key}) AS position, "
        f"row_number() OVER (PARTITION BY {key} ORDER BY {source_priority_sql()}, arrival) AS rn FROM gated) WHERE rn = 1)"
    )


@query("relevance_filter", f"WITH {relevant_sql()} SELECT id, title, company, source, position FROM candidates")
def _relevance_filter(spark, sf):
    return relevance_filter(docs(spark, sf), profile=WHOLE).select("id", "title", "company", "source", "position")


@query(
    "by_status_recent",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
)
def _by_status_recent(spark, sf):
    rows = by_status_recent(
        table(spark, sf, "orders"), status="O", status_col="o_orderstatus", time="o_orderdate", tie="o_orderkey"
    )
    return rows.select("o_orderkey", "o_orderdate")


_NOW = "2001-08-01 00:00:00"


@query(
    "new_since",
    f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '{_NOW}' - INTERVAL 2400 HOUR",
)
def _new_since(spark, sf):
    rows = new_since(
        table(spark, sf, "orders"), now=F.lit(_NOW).cast("timestamp_ntz"), hours=2400, status="O",
        status_col="o_orderstatus", time="o_orderdate",
    )
    return rows.select("o_orderkey", "o_orderdate")


@query(
    "needs_backfill",
    f"WITH {POSTINGS} SELECT id, CASE WHEN size % 3 = 0 OR size % 4 = 0 THEN {norm_company_sql('company')} ELSE 'kept' END AS company_normalized, "
    f"CASE WHEN size % 3 = 0 OR size % 4 = 0 THEN {canonical_key_sql('title', 'company', 'location')} ELSE 'k' END AS canonical_key FROM postings",
)
def _needs_backfill(spark, sf):
    rows = postings(spark, sf).withColumns(
        {
            "company_normalized": F.when(c("size") % 3 != 0, "kept"),
            "canonical_key": F.when(c("size") % 4 != 0, "k"),
        }
    )
    return backfill(rows).select("id", "company_normalized", "canonical_key")
