"""Posting-shaped views of the shared tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.checks.registry import table

TITLE_SQL = (
    "CASE p_size % 6 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'VP, ' WHEN 2 THEN 'ML/AI ' WHEN 3 THEN 'Ingénieur ' "
    "ELSE '' END || p_name || CASE p_size % 4 WHEN 0 THEN ' (Eng)' WHEN 1 THEN ' - SWE' ELSE '' END"
)
COMPANY_SQL = (
    "p_brand || CASE p_size % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN '  Company LLC' ELSE '' END"
)
PLACE_SQL = (
    "CASE p_size % 7 WHEN 0 THEN 'SF' WHEN 1 THEN 'New York, NY' WHEN 2 THEN 'Remote' WHEN 3 THEN 'São Paulo' "
    "WHEN 4 THEN NULL WHEN 5 THEN 'Hybrid - London' ELSE p_type END"
)
SOURCE_SQL = "CASE p_size % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'jobspy' ELSE 'feed' END"
POSTINGS_SQL = (
    f"SELECT p_partkey AS id, {TITLE_SQL} AS title, {COMPANY_SQL} AS company, {PLACE_SQL} AS location, "
    f"p_partkey AS arrival, {SOURCE_SQL} AS source, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, "
    "p_name AS name, p_brand AS brand, p_type AS kind, "
    "'https://jobs.example/' || CAST(p_partkey AS VARCHAR) AS url FROM part"
)
POSTINGS = f"postings AS ({POSTINGS_SQL})"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    text = POSTINGS_SQL.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}")
    return spark.sql(text, part=part)


JOB_EVENTS_SQL = (
    "SELECT event_id AS id, user_id AS job_id, ts AS occurred_at, "
    "CASE event_type WHEN 'purchase' THEN 'offer' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'applied' "
    "WHEN 'click' THEN 'interview' ELSE 'scored' END AS event_type, props AS detail FROM events"
)
JOB_EVENTS = f"job_events AS ({JOB_EVENTS_SQL})"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "purchase", "offer").when(F.col("event_type") == "error", "rejected")
    kinds = kinds.when(F.col("event_type") == "signup", "applied").when(F.col("event_type") == "click", "interview")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("job_id"),
        F.col("ts").alias("occurred_at"),
        kinds.otherwise("scored").alias("event_type"),
        F.col("props").alias("detail"),
    )


ROLES = (
    "Senior GTM Engineer", "Founding GTM Engineer", "Sales Engineer", "Growth Engineer (Remote)",
    "Forward Deployed Engineer", "Registered Nurse", "Product Analyst", "Head of Growth, LatAm",
    "Warehouse Lead", "Full-Stack Engineer", "RevOps Engineer", "Plain Role",
)
PLACES = {"en": "Remote, US", "de": "Hybrid office", "fr": "Anywhere", "es": None}
_ROLE_SQL = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END"
_PLACE_SQL = "CASE lang WHEN 'en' THEN 'Remote, US' WHEN 'de' THEN 'Hybrid office' WHEN 'fr' THEN 'Anywhere' END"
_FEED_SQL = "CASE doc_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'jobspy_web' WHEN 2 THEN 'lever' WHEN 3 THEN 'newsletter' ELSE 'ashby' END"
DOCS_SQL = (
    f"SELECT doc_id AS id, {_ROLE_SQL} || ' - ' || string_split(text, chr(10))[1] AS title, "
    "CASE WHEN doc_id % 19 = 0 THEN ' None ' WHEN doc_id % 11 = 0 THEN 'Vercel' ELSE source END AS company, "
    f"{_PLACE_SQL} AS location, text AS description, {_FEED_SQL} AS source, "
    "CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_remote, doc_id AS arrival, "
    "'https://docs.example/' || CAST(doc_id AS VARCHAR) AS url FROM documents"
)
DOCS = f"docs AS ({DOCS_SQL})"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (n % len(ROLES) + 1).cast("int"))
    place = F.when(F.col("lang") == "en", "Remote, US").when(F.col("lang") == "de", "Hybrid office")
    feeds = ("greenhouse", "jobspy_web", "lever", "newsletter", "ashby")
    return d.select(
        n.alias("id"),
        F.concat(role, F.lit(" - "), F.get(F.split("text", "\n"), F.lit(0))).alias("title"),
        F.when(n % 19 == 0, " None ").when(n % 11 == 0, "Vercel").otherwise(F.col("source")).alias("company"),
        place.when(F.col("lang") == "fr", "Anywhere").alias("location"),
        F.col("text").alias("description"),
        F.element_at(F.array(*[F.lit(f) for f in feeds]), (n % 5 + 1).cast("int")).alias("source"),
        F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("is_remote"),
        n.alias("arrival"),
        F.concat(F.lit("https://docs.example/"), n.cast("string")).alias("url"),
    )


OBSERVATIONS_SQL = (
    "SELECT l_partkey AS job_id, CAST(l_suppkey % 5 AS VARCHAR) AS source_name, l_shipdate AS seen, "
    "CASE WHEN l_returnflag = 'R' THEN 'untrusted' ELSE 'trusted' END AS source_trust FROM lineitem"
)
OBSERVATIONS = f"observations AS ({OBSERVATIONS_SQL})"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("job_id"),
        (F.col("l_suppkey") % 5).cast("string").alias("source_name"),
        F.col("l_shipdate").alias("seen"),
        F.when(F.col("l_returnflag") == "R", "untrusted").otherwise("trusted").alias("source_trust"),
    )


STATES = ("In Progress", "In Review", "Done", "Canceled", "Duplicate", "Backlog")
REMARKS = (
    "applied and later got an offer", "recruiter call booked", "onsite next week", "We got an OFFER",
    "they passed on us", "withdrew today", "reapplied the patch", "",
)
_STATE_SQL = "CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"
_REMARK_SQL = "CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(REMARKS)) + " END"
COMMENTS_SQL = (
    "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, "
    f"{_REMARK_SQL} || ' ' || text AS body, role AS author, "
    "CASE turn % 5 WHEN 3 THEN '' WHEN 4 THEN 'no date' "
    "ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(turn * 24 + conv_id % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS created "
    "FROM conversations"
)
ISSUES_SQL = (
    f"SELECT conv_id, CAST(conv_id AS VARCHAR) AS issue_id, {_STATE_SQL} AS state_name, conv_id AS ord, "
    "CAST(conv_id % 3 AS VARCHAR) AS feed_id, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(max(turn) * 24 + conv_id % 24 AS INTEGER)) AS updated_at "
    "FROM conversations GROUP BY conv_id"
)
COMMENTS = f"comments AS ({COMMENTS_SQL})"
ISSUES = f"issues AS ({ISSUES_SQL})"


def _remark(n) -> F.Column:
    return F.element_at(F.array(*[F.lit(r) for r in REMARKS]), (n % len(REMARKS) + 1).cast("int"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    made = base + F.make_dt_interval(hours=(turn * 24 + conv % 24).cast("int"))
    created = F.when(turn % 5 == 3, "").when(turn % 5 == 4, "no date")
    return c.select(
        conv, turn,
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("id"),
        F.concat(_remark(conv + turn), F.lit(" "), F.col("text")).alias("body"),
        F.col("role").alias("author"),
        created.otherwise(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feed_id, ord`` plus the landed issue shape; comments in turn order.

    A conversation is one record of the feed, so its comments travel as one array.
    """
    conv = F.col("conv_id")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    node = F.struct(
        "id", "body", F.col("created").alias("createdAt"), F.struct(F.col("author").alias("name")).alias("user")
    )
    grouped = comments(spark, sf_dir).groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))).alias("ns")
    )
    updated = base + F.make_dt_interval(hours=(F.col("last") * 24 + conv % 24).cast("int"))
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (conv % len(STATES) + 1).cast("int"))
    return grouped.select(
        (conv % 3).cast("string").alias("feed_id"),
        conv.alias("ord"),
        conv.cast("string").alias("id"),
        F.concat(F.lit("J-"), conv.cast("string")).alias("identifier"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.struct(state.alias("name")).alias("state"),
        F.struct(F.transform("ns", lambda s: s["n"]).alias("nodes")).alias("comments"),
        F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"),
    )


PUSHED_SQL = (
    "SELECT conv_id AS id, conv_id * 10 AS job_id, 'pushed_to_linear' AS event_type, "
    "'{\"linear_issue_id\":\"' || CAST(conv_id AS VARCHAR) || '\"}' AS detail "
    "FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 <> 3) "
    "UNION ALL SELECT 1000000000 + conv_id, conv_id * 10, 'applied', NULL "
    "FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 8 = 1)"
)
PUSHED = f"pushed AS ({PUSHED_SQL})"
POLL_STATE_SQL = (
    "SELECT * FROM (VALUES ('0', TIMESTAMP '2024-01-02 12:00:00'), ('1', TIMESTAMP '2024-01-04 00:00:00')) t(feed_id, last_polled_at)"
)
POLL_STATE = f"poll_state AS ({POLL_STATE_SQL})"


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored event log: a push event for most issues, and an earlier ``applied`` for some."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    conv = F.col("conv_id")
    push = ids.filter(conv % 4 != 3).select(
        conv.alias("id"), (conv * 10).alias("job_id"), F.lit("pushed_to_linear").alias("event_type"),
        F.to_json(F.struct(conv.cast("string").alias("linear_issue_id"))).alias("detail"),
    )
    old = ids.filter(conv % 8 == 1).select(
        (conv + 1000000000).alias("id"), (conv * 10).alias("job_id"), F.lit("applied").alias("event_type"),
        F.lit(None).cast("string").alias("detail"),
    )
    return push.unionByName(old)


def poll_state(spark: SparkSession) -> DataFrame:
    rows = [("0", "2024-01-02 12:00:00"), ("1", "2024-01-04 00:00:00")]
    df = spark.createDataFrame(rows, "feed_id string, last_polled_at string")
    return df.withColumn("last_polled_at", F.col("last_polled_at").cast("timestamp_ntz"))
