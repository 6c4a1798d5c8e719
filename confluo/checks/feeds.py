"""Sources and sinks. Landed payloads are derived from the shared tables by Spark."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.aggregates import TELEMETRY_SQL, telemetry
from confluo.checks.joins import append_slices
from confluo.checks.ranking import DECIDED_SQL, positioned
from confluo.checks.registry import bounded, lit, matches, query, strip, table
from confluo.checks.scalars import html_post_sql, html_strip_sql, norm_company_sql, norm_title_sql
from confluo.checks.views import JOB_EVENTS, job_events
from confluo.operators.aggregates import agg_reference_meta
from confluo.schemas import EVENT_SCHEMA, TELEMETRY_SCHEMA
from confluo.session import scratch_path
from confluo.sinks import writers
from confluo.sources import boards, feeds, html_pages, lists, threads

c = F.col


def text(column):
    return column.cast("string")


# --- reference list ---------------------------------------------------------------


@query(
    "src_reference_list",
    "SELECT s_name AS name, 'https://s' || CAST(s_suppkey AS VARCHAR) || '.example' AS website, 'lever' AS ats_platform, CAST(s_suppkey % 20 AS BIGINT) AS job_count "
    "FROM supplier WHERE s_suppkey % 3 <> 0",
)
def _src_reference_list(spark, sf):
    n = c("s_suppkey")
    entry = F.struct(
        c("s_name").alias("name"),
        F.concat(F.lit("https://s"), text(n), F.lit(".example")).alias("website"),
        F.lit("lever").alias("ats_platform"),
        F.when(n % 3 != 0, True).otherwise(F.when(n % 2 == 0, False)).alias("ats_slug_verified"),
        (n % 20).alias("job_count"),
    )
    # one list document per 50 entries, one document per file
    grouped = table(spark, sf, "supplier").groupBy(F.floor(n / 50).alias("g")).agg(F.collect_list(entry).alias("companies"))
    doc = F.to_json(F.struct(F.struct(F.lit("list").alias("description")).alias("_meta"), "companies")).alias("value")
    path = scratch_path(spark, "reference-list")
    grouped.select(doc).write.option("maxRecordsPerFile", 1).text(path)
    rows = lists.src_reference_list(spark, path, verified_only=True)
    return rows.select("name", "website", "ats_platform", "job_count")


# --- boards -----------------------------------------------------------------------

_PLACE = "CASE p_size % 4 WHEN 0 THEN 'Remote - ' || p_type WHEN 1 THEN p_type WHEN 2 THEN '' END"
_SLUG = "lower(replace(p_brand, '#', ''))"


def _part(spark, sf):
    return table(spark, sf, "part").withColumns(
        {"place": F.expr(_PLACE), "slug": F.expr(_SLUG), "n": c("p_partkey"), "z": c("p_size")}
    )


def _dumps(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _greenhouse_payload():
    meta = F.array(
        F.struct(F.lit("Team").alias("name"), F.lit("x").alias("value")),
        F.struct(F.lit("Apply URL").alias("name"), F.concat(F.lit("https://apply/"), text(c("n"))).alias("value")),
    )
    return F.concat(
        F.lit('{"jobs":['),
        _dumps(
            id=c("n"),
            title=c("p_name"),
            absolute_url=F.when(c("z") % 5 < 3, F.concat(F.lit("https://abs/"), text(c("n")))),
            location=F.struct(c("place").alias("name")),
            content=F.when(c("z") % 3 != 0, F.concat(F.lit("  "), c("p_type"), F.lit("\n"))).otherwise(""),
            company_name=F.when(c("z") % 2 == 0, c("p_brand")),
            departments=F.when(c("z") % 6 != 0, F.array(F.struct(c("p_type").alias("name")))),
            metadata=F.when(c("z") % 5 == 0, meta),
            internal_job_id=c("n") + 7,
            updated_at=F.lit("2024-01-01"),
        ),
        F.lit("]}"),
    )


_GREENHOUSE_SQL = (
    "SELECT 'greenhouse' AS source, CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_size % 5 = 0 THEN 'https://apply/' || CAST(p_partkey AS VARCHAR) "
    "WHEN p_size % 5 < 3 THEN 'https://abs/' || CAST(p_partkey AS VARCHAR) ELSE 'https://boards.greenhouse.io/' || slug || '/jobs/' || CAST(p_partkey AS VARCHAR) END AS url, "
    "p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE slug END AS company, nullif(place, '') AS location, CASE WHEN p_size % 3 <> 0 THEN p_type ELSE p_name END AS description, "
    "CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_remote, NULL AS job_type, CASE WHEN p_size % 6 <> 0 THEN p_type END AS department, CAST(NULL AS DOUBLE) AS salary_min, "
    "'{\"greenhouse_internal_id\":' || CAST(p_partkey + 7 AS VARCHAR) || ',\"greenhouse_updated_at\":\"2024-01-01\"}' AS metadata FROM p"
)
_P_SQL = f"p AS (SELECT *, {_PLACE} AS place, {_SLUG} AS slug FROM part)"
_BOARD_COLS = (
    "source", "source_id", "url", "title", "company", "location", "description", "is_remote", "job_type",
    "department", "salary_min", "metadata",
)


@query("src_board_greenhouse", f"WITH {_P_SQL} {_GREENHOUSE_SQL}")
def _src_board_greenhouse(spark, sf):
    return boards.src_board_greenhouse(_part(spark, sf).select("slug", _greenhouse_payload().alias("payload"))).select(*_BOARD_COLS)


def _lever_payload():
    z = c("z")
    categories = F.struct(
        F.when(z % 3 == 0, c("place")).alias("location"),
        c("p_type").alias("team"),
        F.when(z % 2 == 0, "Part time").otherwise(F.when(z % 5 == 0, "")).alias("commitment"),
        F.when(z % 4 == 0, c("p_brand")).alias("company"),
    )
    described = F.array(F.struct(c("p_name").alias("content")), F.struct(c("p_type").alias("content")))
    return F.concat(
        F.lit("["),
        _dumps(
            id=F.concat(F.lit("L"), text(c("n"))),
            text=c("p_name"),
            hostedUrl=F.when(z % 3 == 0, F.concat(F.lit("https://h/"), text(c("n")))),
            applyUrl=F.when(z % 3 == 1, F.concat(F.lit("https://a/"), text(c("n")))),
            categories=categories,
            description=F.when(z % 2 == 1, described),
            descriptionPlain=F.concat(F.lit(" plain "), c("p_name")),
            createdAt=c("n") * 1000,
        ),
        F.lit("]"),
    )


_LEVER_PLACE = "CASE WHEN p_size % 3 = 0 AND coalesce(place, '') <> '' THEN place ELSE p_type END"
_LEVER_SQL = (
    "SELECT 'lever' AS source, 'L' || CAST(p_partkey AS VARCHAR) AS source_id, CASE p_size % 3 WHEN 0 THEN 'https://h/' WHEN 1 THEN 'https://a/' ELSE 'https://jobs.lever.co/' || slug || '/L' END || CAST(p_partkey AS VARCHAR) AS url, "
    f"p_name AS title, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE slug END AS company, {_LEVER_PLACE} AS location, "
    "CASE WHEN p_size % 2 = 1 THEN p_name || chr(10) || p_type ELSE 'plain ' || p_name END AS description, "
    f"regexp_matches({_LEVER_PLACE}, '(?i)\\bremote\\b') AS is_remote, CASE WHEN p_size % 2 = 0 THEN 'part_time' END AS job_type, p_type AS department, CAST(NULL AS DOUBLE) AS salary_min, "
    "'{\"lever_id\":\"L' || CAST(p_partkey AS VARCHAR) || '\",\"lever_created_at\":' || CAST(p_partkey * 1000 AS VARCHAR) || '}' AS metadata FROM p"
)


@query("src_board_lever", f"WITH {_P_SQL} {_LEVER_SQL}")
def _src_board_lever(spark, sf):
    return boards.src_board_lever(_part(spark, sf).select("slug", _lever_payload().alias("payload"))).select(*_BOARD_COLS)


def _ashby_payload():
    z = c("z")
    return F.concat(
        F.lit('{"jobs":['),
        _dumps(
            id=F.concat(F.lit("A"), text(c("n"))),
            title=F.when(z % 7 != 0, c("p_name")),
            companyName=F.when(z % 2 == 0, c("p_brand")),
            location=F.when(z % 4 != 3, c("place")),
            locationType=F.when(z % 3 == 0, F.lit("Remote")),
            isRemote=F.when(z % 5 == 0, F.lit(False)),
            url=F.when(z % 3 == 1, ""),
            externalUrl=F.when(z % 3 != 2, F.concat(F.lit("https://e/"), text(c("n")))),
            compensation=F.when(z % 2 == 1, F.struct(c("p_retailprice").alias("min"), (c("p_retailprice") * 2).alias("max"))),
            employmentType=F.when(z % 2 == 0, "FullTime").otherwise("Intern"),
            department=F.concat(F.lit(" "), c("p_type")),
            description=F.when(z % 2 == 0, F.lit("  ")),
            descriptionPlain=c("p_name"),
        ),
        F.lit("]}"),
    )


_ASHBY_PLACE = "nullif(concat_ws(', ', CASE WHEN p_size % 4 <> 3 THEN nullif(place, '') END, CASE WHEN p_size % 3 = 0 THEN 'Remote' END), '')"
_ASHBY_SQL = (
    "SELECT 'ashby' AS source, 'A' || CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_size % 3 <> 2 THEN 'https://e/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS url, "
    f"CASE WHEN p_size % 7 <> 0 THEN p_name ELSE 'Unknown' END AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE slug END AS company, {_ASHBY_PLACE} AS location, p_name AS description, "
    f"CASE WHEN p_size % 5 = 0 THEN false ELSE regexp_matches({_ASHBY_PLACE}, '(?i)\\bremote\\b') END AS is_remote, CASE WHEN p_size % 2 = 0 THEN 'full_time' ELSE 'contract' END AS job_type, "
    "p_type AS department, CASE WHEN p_size % 2 = 1 THEN p_retailprice END AS salary_min, "
    "'{\"ashby_id\":\"A' || CAST(p_partkey AS VARCHAR) || '\",\"ashby_is_remote\":' || CASE WHEN p_size % 5 = 0 THEN 'false' ELSE 'null' END || '}' AS metadata FROM p"
)


@query("src_board_ashby", f"WITH {_P_SQL} {_ASHBY_SQL}")
def _src_board_ashby(spark, sf):
    return boards.src_board_ashby(_part(spark, sf).select("slug", _ashby_payload().alias("payload"))).select(*_BOARD_COLS)


@query(
    "src_board_router",
    f"WITH {_P_SQL}, g AS ({_GREENHOUSE_SQL} WHERE p_partkey % 4 = 0), l AS ({_LEVER_SQL} WHERE p_partkey % 4 = 1), a AS ({_ASHBY_SQL} WHERE p_partkey % 4 = 2) "
    "SELECT * FROM g UNION ALL SELECT * FROM l UNION ALL SELECT * FROM a",
)
def _src_board_router(spark, sf):
    n = c("n") % 4
    platform = F.when(n == 0, "Greenhouse").when(n == 1, "lever").when(n == 2, "ASHBY").otherwise("other")
    payload = F.when(n == 0, _greenhouse_payload()).when(n == 1, _lever_payload()).otherwise(_ashby_payload())
    rows = _part(spark, sf).select(
        platform.alias("platform"),
        F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("name"),
        F.when(c("z") % 2 == 0, c("slug")).otherwise("").alias("slug"),
        payload.alias("payload"),
    )
    return boards.src_board_router(rows).select(*_BOARD_COLS)


@query(
    "src_board_rows",
    "SELECT CASE c_nationkey % 3 WHEN 0 THEN 'indeed' WHEN 1 THEN 'google' ELSE 'none' END AS source, CAST(c_custkey AS VARCHAR) AS source_id, "
    "CASE c_custkey % 3 WHEN 0 THEN 'https://j/' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'https://u/' || CAST(c_custkey AS VARCHAR) ELSE '' END AS url, c_name AS title, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'None' ELSE c_mktsegment END AS company, '' AS location, c_acctbal AS salary_min, 'USD' AS salary_currency, coalesce(c_custkey % 4 = 0, false) AS is_remote, '' AS department, "
    "'{\"company_logo\":\"\",\"company_url\":\"' || c_mktsegment || '\",\"company_url_direct\":\"\",\"company_rating\":\"\",\"company_revenue\":\"\",\"emails\":\"\"}' AS metadata FROM customer",
)
def _src_board_rows(spark, sf):
    n, k = c("c_custkey"), c("c_nationkey") % 3
    rows = table(spark, sf, "customer").select(
        F.when(k == 0, "Indeed").when(k == 1, "google").alias("site"),
        text(n).alias("job_id"),
        F.when(n % 3 == 0, F.concat(F.lit("https://j/"), text(n))).otherwise(F.when(n % 3 == 1, "")).alias("job_url"),
        F.when(n % 3 == 1, F.concat(F.lit("https://u/"), text(n))).alias("url"),
        c("c_name").alias("title"),
        F.when(n % 5 != 0, c("c_mktsegment")).alias("company"),
        c("c_acctbal").alias("min_amount"),
        F.when(n % 2 == 0, n % 4 == 0).alias("is_remote"),
        F.lit("2024-01-01").alias("date_posted"),
        c("c_mktsegment").alias("company_url"),
    )
    return boards.src_board_rows(rows).select(
        "source", "source_id", "url", "title", "company", "location", "salary_min", "salary_currency", "is_remote", "department", "metadata"
    )


# --- RSS --------------------------------------------------------------------------


def _xml(column):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(char), F.lit(name))
    return column


def _images(n):
    tags = F.transform(
        F.sequence(F.lit(0), (n % 13).cast("int")),
        lambda k: F.concat(F.lit('<img alt="" src="https://img.example/'), text(n), F.lit("-"), text(k), F.lit('.png">')),
    )
    return F.array_join(tags, "")


@query(
    "src_rss_posts",
    "SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE url || '#x' END AS post_url, 'Post ' || CAST(page_id AS VARCHAR) AS title, 'Mon, 01 Jan 2024' AS published, "
    "CAST(page_id % 13 + 1 AS INTEGER) AS n_images, md5(regexp_replace(html, '\\s+', '', 'g')) AS body_md5 FROM pages WHERE page_id % 11 <> 0",
)
def _src_rss_posts(spark, sf):
    n = c("page_id")
    link = F.when(n % 11 == 0, "").otherwise(F.when(n % 2 == 0, c("url")).otherwise(F.concat("url", F.lit("#x"))))
    body = F.concat("html", _images(n))
    tag = F.when(n % 3 == 0, "description").otherwise("content:encoded")
    item = F.concat(
        F.lit("<item><link> "), _xml(link), F.lit("</link><title>Post "), text(n),
        F.lit("</title><pubDate>Mon, 01 Jan 2024</pubDate><"), tag, F.lit(">"), _xml(body), F.lit("</"), tag, F.lit("></item>"),
    )
    path = scratch_path(spark, "rss")
    # one feed document per 50 posts, one document per file
    feed = F.concat(
        F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'),
        F.array_join(F.collect_list(item), "\n"),
        F.lit("</channel></rss>"),
    )
    documents = table(spark, sf, "pages").groupBy(F.floor(n / 50).alias("g")).agg(feed.alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    posts = feeds.src_rss_posts(feeds.read_rss(spark, path))
    plain = F.regexp_replace(F.regexp_replace("html_body", '<img alt="" src="https://img.example/[^>]*>', ""), r"\s+", "")
    return posts.select(
        "post_url", "title", "published", F.size("image_urls").alias("n_images"), F.md5(plain).alias("body_md5")
    )


_BODY_SQL = (
    "'<p>Acme ' || CAST(page_id % 9 AS VARCHAR) || ' — GTM Engineer — ' || url || '.</p><li>[Beta Co — Remote Growth Lead](https://md.example/' || CAST(page_id AS VARCHAR) || ')</li>"
    "Gamma, Inc. | Data Eng – https://jobs.lever.co/gamma/' || CAST(page_id % 5 AS VARCHAR) || ')<br/>https://boards.greenhouse.io/only/' || CAST(page_id AS VARCHAR) || '<br>"
    "again https://jobs.lever.co/gamma/' || CAST(page_id % 5 AS VARCHAR) || '<p>' || html"
)
_ENTRY_SQL = (
    f"b AS (SELECT page_id, url AS post_url, {html_post_sql(_BODY_SQL)} AS t FROM pages), "
    "l AS (SELECT page_id, post_url, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM b), "
    f"s AS (SELECT page_id, post_url, pos, {strip('line')} AS line FROM l), "
    f"e AS (SELECT *, regexp_matches(line, {lit(D.DASH_LINE)}) AS p1, regexp_matches(line, {lit(D.MARKDOWN_LINE)}) AS p2, regexp_matches(line, {lit(D.BOARD_URL_LINE)}) AS p3 FROM s WHERE line <> ''), "
    f"f AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_extract(line, {lit('(?i)^(.*?)' + D.BOARD_URL_LINE.removeprefix('(?i)'))}, 1), '[—\\-–|]'), lambda x: {strip('x')}), lambda x: x <> '') AS parts FROM e WHERE p1 OR p2 OR p3), "
    f"g AS (SELECT page_id, post_url, pos, line, CASE WHEN p1 THEN {strip(f'regexp_extract(line, {lit(D.DASH_LINE)}, 1)')} WHEN p2 THEN {strip(f'regexp_extract(line, {lit(D.MARKDOWN_LINE)}, 1)')} ELSE coalesce(parts[1], '') END AS company, "
    f"CASE WHEN p1 THEN {strip(f'regexp_extract(line, {lit(D.DASH_LINE)}, 2)')} WHEN p2 THEN {strip(f'regexp_extract(line, {lit(D.MARKDOWN_LINE)}, 2)')} ELSE parts[2] END AS title, "
    f"CASE WHEN p1 THEN regexp_replace(regexp_extract(line, {lit(D.DASH_LINE)}, 3), '[.,;)]+$', '') WHEN p2 THEN regexp_extract(line, {lit(D.MARKDOWN_LINE)}, 3) ELSE regexp_replace(regexp_extract(line, {lit(D.BOARD_URL_LINE)}, 1), '[.,;)]+$', '') END AS url FROM f), "
    "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM g) WHERE rn = 1 AND company <> '')"
)


def normalized_sql(rows: str, description: str, via: str) -> str:
    title = f"coalesce(nullif({strip('coalesce(title, ' + lit('') + ')')}, ''), '(untitled)')"
    company = strip("company")
    ident = f"left(sha256(post_url), 12) || ':' || {norm_company_sql(company)} || ':' || {norm_title_sql(title)}"
    return (
        f"SELECT {ident} AS source_id, coalesce(nullif({strip('coalesce(url, ' + lit('') + ')')}, ''), post_url) AS url, {title} AS title, {company} AS company, location, "
        f"CASE WHEN contains(lower(coalesce(location, '')), 'remote') OR contains(lower({title}), 'remote') THEN true END AS is_remote, {description} AS description, {lit(via)} AS via FROM {rows}"
    )


_NORMAL_COLS = ("source_id", "url", "title", "company", "location", "is_remote", "description")


def _via():
    return F.get_json_object("metadata", "$.via").alias("via")


@query(
    "src_rss_text_postings",
    f"WITH {_ENTRY_SQL}, n AS (SELECT *, CAST(NULL AS VARCHAR) AS location FROM u) {normalized_sql('n', 'line', 'text')}",
)
def _src_rss_text_postings(spark, sf):
    body = F.expr(_BODY_SQL.replace("VARCHAR", "STRING"))
    posts = table(spark, sf, "pages").select(c("url").alias("post_url"), body.alias("html_body"))
    return feeds.src_rss_text_postings(posts).select(*_NORMAL_COLS, _via())


@query(
    "src_rss_image_postings",
    "WITH i AS (SELECT page_id, url AS post_url, unnest(range(0, page_id % 13 + 1)) AS k FROM pages), "
    "x AS (SELECT *, left(sha256('https://img.example/' || CAST(page_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) || '.png'), 16) AS h FROM i WHERE k % 3 = 0), "
    "n AS (SELECT post_url, 'Img ' || CAST(page_id AS VARCHAR) AS company, CASE WHEN k = 0 THEN 'Remote PM' END AS title, '' AS url, 'Oslo' AS location, h FROM x) "
    + normalized_sql("n", "NULL", "image"),
)
def _src_rss_image_postings(spark, sf):
    n, k = c("page_id"), c("k")
    pages = table(spark, sf, "pages")
    urls = F.regexp_extract_all(_images(n), F.lit('src="([^"]+)"'), F.lit(1))
    posts = pages.select(c("url").alias("post_url"), n, urls.alias("image_urls"))
    shots = posts.select(n, F.posexplode("image_urls").alias("k", "image_url"))
    entry = F.struct(
        F.concat(F.lit("Img "), text(n)).alias("company"),
        F.when(k == 0, "Remote PM").alias("title"),
        F.lit("").alias("url"),
        F.lit("Oslo").alias("location"),
    )
    kind = F.when(k % 3 == 0, F.to_json(F.array(entry))).when(k % 3 == 1, F.to_json(entry)).otherwise("[garbage")
    landed = shots.select(F.left(F.sha2("image_url", 256), F.lit(16)).alias("image_hash"), kind.alias("extraction"))
    return feeds.src_rss_image_postings(posts, landed).select(*_NORMAL_COLS, _via())


@query(
    "src_posting_normalize",
    "WITH n AS (SELECT 'https://p/' || CAST(doc_id % 50 AS VARCHAR) AS post_url, CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE source || ', Inc.' END AS company, "
    "CASE WHEN doc_id % 5 <> 0 THEN text END AS title, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'https://d/' || CAST(doc_id AS VARCHAR) END AS url, "
    "CASE WHEN doc_id % 4 = 0 THEN 'Remote ' || lang ELSE lang END AS location FROM documents), "
    f"k AS (SELECT * FROM n WHERE {strip('company')} <> '') " + normalized_sql("k", "location", "text"),
)
def _src_posting_normalize(spark, sf):
    n = c("doc_id")
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("https://p/"), text(n % 50)).alias("post_url"),
        F.when(n % 13 == 0, "  ").otherwise(F.concat("source", F.lit(", Inc."))).alias("company"),
        F.when(n % 5 != 0, c("text")).alias("title"),
        F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("https://d/"), text(n))).alias("url"),
        F.when(n % 4 == 0, F.concat(F.lit("Remote "), "lang")).otherwise(c("lang")).alias("location"),
        F.lit("text").alias("via"),
    )
    return feeds.src_posting_normalize(rows.withColumn("raw_text", c("location"))).select(*_NORMAL_COLS, _via())


# --- pages ------------------------------------------------------------------------

_LINK = r'href="(/([^"]+))"'
_PAGE_COLS = ("page_id", "pos", "source_id", "url", "title", "company", "location", "is_remote", "job_type")


def _with_block(pages):
    n = c("page_id")
    place = F.struct(
        F.struct(F.lit("Oslo").alias("addressLocality"), F.lit("NO").alias("addressCountry")).alias("address")
    )

    def posting(k):
        return F.struct(
            F.when(n % 5 == 0, "Event").otherwise("JobPosting").alias("@type"),
            F.concat(F.lit("https://w/jobs/"), text(n * 10 + k), F.lit("-x")).alias("url"),
            F.when(n % 4 != 0, F.concat(F.lit("Role "), text(n))).alias("title"),
            F.struct(F.concat(F.lit("Org "), text(n % 7)).alias("name")).alias("hiringOrganization"),
            F.array(place).alias("jobLocation"),
            F.when(n % 3 == 0, F.lit("telecommute")).alias("jobLocationType"),
            F.lit("FULL_TIME").alias("employmentType"),
        )

    body = F.when(n % 2 == 0, F.to_json(F.array(posting(0), posting(1)))).otherwise(F.to_json(posting(0)))
    body = F.when(n % 7 == 0, "{broken").otherwise(body)
    return pages.withColumn(
        "html",
        F.when(n % 3 == 2, c("html")).otherwise(
            F.concat("html", F.lit('<SCRIPT async type="application/ld+json"> '), body, F.lit(" </script>"))
        ),
    )


def jsonld_sql(extra: str = "") -> str:
    return (
        "SELECT page_id, CAST(k AS BIGINT) AS pos, CAST(page_id * 10 + k AS VARCHAR) AS source_id, 'https://w/jobs/' || CAST(page_id * 10 + k AS VARCHAR) || '-x' AS url, "
        "CASE WHEN page_id % 4 <> 0 THEN 'Role ' || CAST(page_id AS VARCHAR) ELSE 'Unknown' END AS title, 'Org ' || CAST(page_id % 7 AS VARCHAR) AS company, 'Oslo, NO' AS location, "
        "CASE WHEN page_id % 3 = 0 THEN true END AS is_remote, 'full_time' AS job_type FROM (SELECT page_id, unnest(range(0, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END)) AS k FROM pages "
        f"WHERE page_id % 3 <> 2 AND page_id % 5 <> 0 AND page_id % 7 <> 0 {extra})"
    )


@query("src_html_jsonld", jsonld_sql())
def _src_html_jsonld(spark, sf):
    return html_pages.src_html_jsonld(_with_block(table(spark, sf, "pages"))).select(*_PAGE_COLS)


def cards_sql(source: str) -> str:
    after = "substr(w, instr(w, 'href=\"' || path || '\"') + length(path) + 7)"
    inner = f"regexp_extract({after}, '(?s)^[^>]*>(.*?)</a>', 1)"
    clean = strip("regexp_replace(regexp_replace(w, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")
    title = strip(f"regexp_replace(regexp_replace({inner}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')")
    title = f"nullif({title}, '')"
    remote = " OR ".join(matches(f"coalesce({x}, '')", r"\bremote\b") for x in ("lo", "title"))
    return (
        f"h AS (SELECT page_id, html, regexp_extract_all(html, {lit(_LINK)}) AS links, regexp_extract_all(html, {lit(_LINK)}, 1) AS paths, string_split_regex(html, {lit(_LINK.replace('(', '(?:'))}) AS gaps FROM {source}), "
        "i AS (SELECT page_id, html, links, paths, gaps, unnest(range(1, len(links) + 1)) AS k FROM h), "
        "spot AS (SELECT page_id, html, k, links[k] AS link, paths[k] AS path, coalesce(list_sum(list_transform(gaps[1:k], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(links[1:k - 1], lambda g: length(g))), 0) AS start FROM i), "
        "win AS (SELECT page_id, k - 1 AS pos, path, substr(html, CAST(greatest(start - 50, 0) AS BIGINT) + 1, CAST(start + length(link) + 600 - greatest(start - 50, 0) AS BIGINT)) AS w FROM spot), "
        f"wrd AS (SELECT page_id, pos, path, {title} AS title, list_filter(string_split({clean}, ' '), lambda x: x <> '') AS words FROM win), "
        "crd AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, path, title, CASE WHEN len(words) > 2 AND length(words[2]) < 60 THEN words[2] END AS co, CASE WHEN len(words) > 2 AND length(words[3]) < 60 THEN words[3] END AS lo FROM wrd), "
        "cards AS (SELECT page_id, pos, regexp_extract('https://wellfound.com' || path, '/(\\d+)', 1) AS source_id, 'https://wellfound.com' || path AS url, coalesce(title, 'Unknown') AS title, coalesce(co, 'Unknown') AS company, lo AS location, "
        f"CASE WHEN {remote} THEN true END AS is_remote, CAST(NULL AS VARCHAR) AS job_type FROM crd)"
    )


@query("src_html_link_cards", f"WITH {cards_sql('pages')} SELECT * FROM cards")
def _src_html_link_cards(spark, sf):
    rows = html_pages.src_html_link_cards(table(spark, sf, "pages"), pattern=_LINK, id_pattern=r"/(\d+)")
    return rows.select(*_PAGE_COLS)


@query(
    "src_html_first_nonempty",
    f"WITH ld AS ({jsonld_sql()}), plain AS (SELECT * FROM pages WHERE page_id NOT IN (SELECT page_id FROM ld)), {cards_sql('plain')}, "
    "a AS (SELECT * FROM ld UNION ALL SELECT * FROM cards) SELECT page_id, pos, source_id, url, title, is_remote, job_type FROM "
    "(SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM a) WHERE rn = 1",
)
def _src_html_first_nonempty(spark, sf):
    rows = html_pages.src_html_first_nonempty(_with_block(table(spark, sf, "pages")), pattern=_LINK, id_pattern=r"/(\d+)")
    return rows.select("page_id", "pos", "source_id", "url", "title", "is_remote", "job_type")


# --- threads ----------------------------------------------------------------------

_NOW = datetime(2024, 1, 31)
_STORY_SQL = (
    "stories AS (SELECT event_id AS id, ts AS created_at, CASE event_id % 5 WHEN 0 THEN 'Ask: Who is Hiring? (2024)' WHEN 1 THEN 'ask: WHO IS HIRING? 2023' "
    "WHEN 2 THEN 'who wants to be hired 2024' ELSE 'other' END AS title FROM events)"
)


@query(
    "src_thread_select",
    f"WITH {_STORY_SQL}, m AS (SELECT * FROM (VALUES ('2024-01', '2024', TIMESTAMP '2024-01-01'), ('2023-12', '2023', TIMESTAMP '2023-12-01'), ('2023-11', '2023', TIMESTAMP '2023-11-01')) v(month, y, s)) "
    "SELECT month, id FROM (SELECT month, id, row_number() OVER (PARTITION BY month ORDER BY created_at DESC, id) AS rn FROM stories JOIN m ON contains(lower(title), 'who is hiring') AND contains(title, y) AND created_at > s) WHERE rn = 1",
)
def _src_thread_select(spark, sf):
    n = c("event_id") % 5
    title = F.when(n == 0, "Ask: Who is Hiring? (2024)").when(n == 1, "ask: WHO IS HIRING? 2023")
    stories = table(spark, sf, "events").select(
        c("event_id").alias("id"),
        title.when(n == 2, "who wants to be hired 2024").otherwise("other").alias("title"),
        c("ts").alias("created_at"),
    )
    return threads.src_thread_select(stories, now=_NOW, months_back=2).select("month", "id")


_ASKED = ("Sales  Engineer", "Founding GTM lead", "developer advocate", "nothing here", "Enterprise AE")
_COMMENT_SQL = (
    "CASE WHEN doc_id % 7 = 0 THEN '' ELSE source || ' | ' || lang || CASE WHEN doc_id % 4 = 0 THEN ' Berlin' ELSE ' SF' END || ' | x<p>' END || 'We&#x27;re hiring: a ' || "
    + "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_ASKED)) + " END"
    + " || CASE WHEN doc_id % 3 = 0 THEN ' (WFH)' ELSE '' END || '<p><a href=\"https://c.example/' || CAST(doc_id AS VARCHAR) || '\">go</a><p>' || text"
)


def _spelled(pattern: str) -> str:
    core = pattern.removeprefix(r"(?i)\b").removesuffix(r"\b")
    return rf"\b{core}\b"


_ROLE_SQL = "(?i)" + bounded(_spelled(D.THREAD_ROLE_PATTERN))
_CLEANED_SQL = (
    f"raw AS (SELECT doc_id AS arrival, {_COMMENT_SQL} AS raw FROM documents), cln AS (SELECT arrival, raw, {html_strip_sql('raw')} AS t FROM raw), "
    f"pts AS (SELECT *, list_transform(string_split({strip('string_split(t, chr(10))[1]')}, '|'), lambda x: {strip('x')}) AS parts, "
    f"regexp_extract(t, {lit(_ROLE_SQL)}, 1) AS role FROM cln), "
    "fnd AS (SELECT *, parts[1] AS company, list_filter(string_split(t, chr(10)), lambda x: contains(lower(x), lower(role)))[1] AS holder FROM pts WHERE len(parts) >= 2 AND parts[1] <> '' AND role <> ''), "
    f"flg AS (SELECT *, {matches('t', _spelled(D.REMOTE_PHRASES))} AS is_remote, {matches('t', _spelled(D.THREAD_REJECT_PATTERN))} AS rej, {matches('t', _spelled(D.THREAD_ACCEPT_PATTERN))} AS acc, "
    f"{strip('holder')} AS snip FROM fnd), "
    "cmt AS (SELECT arrival, company, CASE WHEN length(snip) > length(role) THEN snip ELSE role END AS title, parts[2] AS location, is_remote, "
    "regexp_extract(raw, '<a\\s+href=\"([^\"]+)\"', 1) AS url, md5(t) AS raw_md5 FROM flg WHERE NOT rej OR acc OR is_remote)"
)


@query(
    "src_comment_postings",
    f"WITH {_CLEANED_SQL} SELECT arrival, company, title, location, is_remote, url, raw_md5 FROM "
    "(SELECT *, row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY arrival) AS rn FROM cmt) WHERE rn = 1",
)
def _src_comment_postings(spark, sf):
    comments = table(spark, sf, "documents").select(
        c("doc_id").alias("arrival"), F.expr(_COMMENT_SQL.replace("VARCHAR", "STRING")).alias("comment_text")
    )
    rows = threads.src_comment_postings(comments)
    return rows.select("arrival", "company", "title", "location", "is_remote", "url", F.md5("raw_text").alias("raw_md5"))


# --- batches and telemetry --------------------------------------------------------

_BATCH_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'W25' WHEN 1 THEN 'S23' WHEN 2 THEN 'W23' ELSE 'X99' END"


@query(
    "src_paged_batches",
    f"WITH r AS (SELECT {_BATCH_SQL} AS batch, c_custkey // 40 AS page, c_custkey AS pos, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE 'Co ' || CAST(c_custkey % 300 AS VARCHAR) END AS name, c_custkey FROM customer), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY CASE batch WHEN 'W23' THEN 1 WHEN 'S23' THEN 2 ELSE 5 END, page, pos) AS rn FROM r WHERE batch <> 'X99' AND trim(name) <> '') "
    "SELECT name, 'slug' || CAST(c_custkey AS VARCHAR) AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'https://x' ELSE '' END AS website, batch, '' AS one_liner, 'a' AS industry FROM k WHERE rn = 1",
)
def _src_paged_batches(spark, sf):
    n = c("c_custkey")
    entry = F.struct(
        n.alias("sort"),
        F.when(n % 10 == 0, " ").otherwise(F.concat(F.lit("Co "), text(n % 300))).alias("name"),
        F.concat(F.lit("slug"), text(n)).alias("slug"),
        F.when(n % 2 == 0, "https://x").alias("website"),
        F.lit("").alias("batch"),
        F.lit(None).cast("string").alias("oneLiner"),
        F.array(F.lit("a")).alias("industries"),
        F.lit("Active").alias("status"),
    )
    # a page holds at most 40 companies
    pages = table(spark, sf, "customer").groupBy(F.expr(_BATCH_SQL).alias("batch"), F.floor(n / 40).alias("page")).agg(
        F.array_sort(F.collect_list(entry)).alias("companies")
    )
    rows = lists.src_paged_batches(pages)
    return rows.select("name", "slug", "website", "batch", "one_liner", F.get("industries", F.lit(0)).alias("industry"))


@query(
    "src_telemetry_window",
    f"WITH {TELEMETRY_SQL} SELECT ts, outcome, job_id, source_name FROM telemetry WHERE moment >= TIMESTAMP '2024-01-24 10:00:00'",
)
def _src_telemetry_window(spark, sf):
    path = scratch_path(spark, "telemetry")
    records = telemetry(spark, sf)
    writers.sink_telemetry_daily(records, path)
    # malformed lines land in the same folders
    bad = records.select(F.concat(F.lit("{broken "), "source_name").alias("value"), F.substring("ts", 1, 10).alias("dt"))
    bad.write.mode("append").partitionBy("dt").text(path)
    rows = lists.src_telemetry_window(spark, path, now=datetime(2024, 1, 31, 10), last="7d")
    return rows.select("ts", "outcome", "job_id", "source_name")


# --- sinks ------------------------------------------------------------------------


@query(
    "sink_events",
    f"WITH {JOB_EVENTS} SELECT job_id, event_type, occurred_at, 'system' AS actor, CASE WHEN id % 2 = 0 THEN detail END AS detail FROM job_events WHERE id % 9 <> 0",
)
def _sink_events(spark, sf):
    path, aside = scratch_path(spark, "events"), scratch_path(spark, "quarantine")
    rows = job_events(spark, sf).withColumns(
        {
            "event_type": F.when(c("id") % 9 == 0, "unheard_of").otherwise(c("event_type")),
            "detail": F.when(c("id") % 2 == 0, c("detail")),
        }
    )
    writers.sink_events(rows, path, quarantine=aside)
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


@query(
    "sink_telemetry_daily",
    f"WITH {TELEMETRY_SQL} SELECT substr(ts, 1, 10) AS day, outcome, count(*) AS n, count(trust_flipped) AS known FROM telemetry GROUP BY 1, 2",
)
def _sink_telemetry_daily(spark, sf):
    path = scratch_path(spark, "telemetry")
    writers.sink_telemetry_daily(telemetry(spark, sf), path)
    rows = spark.read.schema(f"{TELEMETRY_SCHEMA}, dt string").json(path)
    return rows.groupBy(c("dt").alias("day"), "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.count("trust_flipped").alias("known")
    )


@query("sink_ranked", f"WITH {DECIDED_SQL} SELECT id, rank_position, similarity, decision FROM decided")
def _sink_ranked(spark, sf):
    path = scratch_path(spark, "ranked")
    writers.sink_ranked(positioned(spark, sf), path)
    return spark.read.schema("id bigint, rank_position bigint, similarity double, decision string").json(path)


@query(
    "sink_reference_merge",
    "WITH m AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL "
    "SELECT min(k) FROM (SELECT left(c_name, 9) || CAST(c_custkey // 10 AS VARCHAR) AS n, c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0) GROUP BY lower(n)) "
    "SELECT count(*) AS total, count(*) FILTER (WHERE id % 4 = 0) AS verified_count FROM m",
)
def _sink_reference_merge(spark, sf):
    path = scratch_path(spark, "reference")
    writers.sink_reference_merge(*append_slices(spark, sf), path)
    rows = spark.read.parquet(path)
    return agg_reference_meta(rows.withColumn("ats_slug_verified", c("id") % 4 == 0))

