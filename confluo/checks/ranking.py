"""Text ranking, decisions, audit, push and digest. Texts are whole: no prefix is ranked."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.predicates import WHOLE, first_pattern_sql, relevant_sql, remote_gate_sql
from confluo.checks.registry import lit, query, table
from confluo.checks.scalars import (
    REFERENCE_SQL, bonus_sql, reference, role_priority_sql, source_priority_sql, text_blob_sql, tier_sql,
)
from confluo.checks.views import docs
from confluo.operators import tfidf
from confluo.operators.aggregates import agg_skip_reasons
from confluo.operators.ordering import rank_order, rank_position
from confluo.plans import digest, push, rank
from confluo.session import materialize

c = F.col
NOW_TEXT = "2024-06-01 00:00:00"
TOP, FLOOR = 200, 0.05


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def vectors_sql(corpus: str, query_text: str, features: int | None = None) -> str:
    """CTEs ``vec(id, term, w)`` (unnormalised) and ``unit(id, n)`` over ``corpus(id, text)``;
    the query has id −1."""
    limit = f"ORDER BY total DESC, term LIMIT {features}" if features else ""
    return (
        f"alldocs AS (SELECT id, text FROM {corpus} UNION ALL SELECT -1, {lit(query_text)}), "
        f"toks AS (SELECT id, regexp_extract_all(lower(text), {lit(D.TOKEN_PATTERN)}) AS t FROM alldocs), "
        "grams AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks), "
        "tf AS (SELECT id, term, count(*) AS n FROM grams GROUP BY 1, 2), "
        "df AS (SELECT term, sum(n) AS total, count(*) AS d FROM tf GROUP BY 1), "
        f"vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM alldocs)) / (1.0 + d)) + 1.0 AS idf FROM df {limit}), "
        "vec AS (SELECT tf.id, tf.term, tf.n * v.idf AS w FROM tf JOIN vocab v ON tf.term = v.term), "
        "unit AS (SELECT id, sqrt(sum(w * w)) AS n FROM vec GROUP BY 1)"
    )


_COS = (
    "cos AS (SELECT a.id, sum(a.w * q.w) / (any_value(u.n) * any_value(uq.n)) AS cosine FROM vec a JOIN vec q ON q.id = -1 AND q.term = a.term "
    "JOIN unit u ON u.id = a.id JOIN unit uq ON uq.id = -1 WHERE a.id >= 0 GROUP BY a.id)"
)


@query(
    "tfidf_weights",
    f"WITH d AS (SELECT doc_id AS id, text FROM documents), {vectors_sql('d', 'that with this from')} "
    "SELECT vec.id, term, round(w / n, 6) AS weight FROM vec JOIN unit ON vec.id = unit.id WHERE vec.id >= 0",
)
def _tfidf_weights(spark, sf):
    rows = table(spark, sf, "documents").select(c("doc_id").alias("id"), "text")
    out = tfidf.tfidf_weights(rows, "that with this from")
    return out.select("id", "term", F.round("weight", 6).alias("weight"))


_BENCH_QUERY = "thereat heron that and onesen erblest it hein ti inenan the of with dans pour sich"


@query(
    "cosine_to_query",
    f"WITH d AS (SELECT doc_id AS id, text FROM documents), {vectors_sql('d', _BENCH_QUERY)}, {_COS} "
    "SELECT unit.id, round(coalesce(cosine, 0), 6) AS cosine FROM unit LEFT JOIN cos ON cos.id = unit.id WHERE unit.id >= 0",
)
def _cosine_to_query(spark, sf):
    rows = table(spark, sf, "documents").select(c("doc_id").alias("id"), "text")
    return tfidf.cosine_to_query(rows, _BENCH_QUERY).select("id", F.round("cosine", 6).alias("cosine"))


RANKED_SQL = (
    f"{relevant_sql()}, texts AS (SELECT id, {text_blob_sql()} AS text FROM candidates), {vectors_sql('texts', D.QUERY_TEXT)}, {_COS}, "
    f"scored AS (SELECT k.*, coalesce(cosine, 0) + {bonus_sql()} AS score FROM candidates k LEFT JOIN cos ON cos.id = k.id), "
    f"ranked AS (SELECT *, round(score, 3) AS similarity, row_number() OVER (ORDER BY round(score, 3) DESC, {role_priority_sql()}, {source_priority_sql()}, position) - 1 AS rank_position "
    f"FROM scored WHERE score >= {FLOOR} QUALIFY rank_position < {TOP})"
)


def ranked(spark, sf):
    """The flagship: the ranked list over whole documents."""
    return rank.rank_relevant(docs(spark, sf), profile=WHOLE, top_k=TOP, min_score=FLOOR)


def positioned(spark, sf):
    """The k ranked rows with position and decision, written once for all that consume them."""
    rows = rank.decide_ranked(rank_position(ranked(spark, sf), order=rank_order(arrival="position")), profile=WHOLE)
    return materialize(rows, "ranked")


@query(
    "rank_relevant",
    f"WITH {RANKED_SQL} SELECT id, title, company, source, coalesce(is_remote, false) AS is_remote, location, similarity, position FROM ranked",
)
def _rank_relevant(spark, sf):
    return ranked(spark, sf).select("id", "title", "company", "source", "is_remote", "location", "similarity", "position")


_NAMES_SQL = "lower(company) IN (" + ", ".join(lit(n.lower()) for n in D.REMOTE_FIRST_COMPANIES) + ")"
_TITLE_HIT = first_pattern_sql("title", D.TITLE_EXCLUSIONS)
_GEO_HIT = first_pattern_sql("(title || ' ' || coalesce(location, ''))", D.GEO_EXCLUSIONS)
DECIDED_SQL = (
    f"{RANKED_SQL}, decided AS (SELECT *, CASE WHEN {_TITLE_HIT} IS NOT NULL THEN 'rejected_title' WHEN {_GEO_HIT} IS NOT NULL THEN 'rejected_geo' "
    f"WHEN similarity < {D.DECISION_THRESHOLD} THEN 'rejected' WHEN {remote_gate_sql()} THEN 'promoted' WHEN {_NAMES_SQL} THEN 'promoted_whitelist_remote' ELSE 'shortlisted' END AS decision, "
    f"coalesce({_TITLE_HIT}, {_GEO_HIT}) AS reason FROM ranked)"
)


@query("decide", f"WITH {DECIDED_SQL} SELECT id, similarity, decision, reason AS decision_reason FROM decided")
def _decide(spark, sf):
    return positioned(spark, sf).select("id", "similarity", "decision", "decision_reason")


def _stored(spark, sf):
    """Two of three documents are stored as jobs, under ids of their own."""
    return docs(spark, sf).filter(c("id") % 3 != 2).select((c("id") + 5000000).alias("id"), F.upper("url").alias("url"))


_REASON = "CASE WHEN reason IS NULL THEN '' ELSE reason END"


@query(
    "score_audit",
    f"WITH {DECIDED_SQL} SELECT id + 5000000 AS job_id, similarity AS score, rank_position, decision, {_REASON} AS reason, 0 AS n_titles, "
    f"{lit(D.RANKER_VERSION)} AS ranker_version, url AS detail_url FROM decided WHERE id % 3 <> 2",
)
def _score_audit(spark, sf):
    audit = rank.score_audit(positioned(spark, sf), _stored(spark, sf), now=now())
    return audit.select(
        "job_id", "score", "rank_position", "decision",
        F.coalesce(F.get_json_object("component_scores", "$.reason"), F.lit("")).alias("reason"),
        F.json_array_length(F.get_json_object("component_scores", "$.matched_target_titles")).alias("n_titles"),
        "ranker_version",
        F.get_json_object("scoring_detail", "$.url").alias("detail_url"),
    )


@query(
    "scored_events",
    f"WITH {DECIDED_SQL} SELECT id + 5000000 AS job_id, 'scored' AS event_type, TIMESTAMP '{NOW_TEXT}' AS occurred_at, 'system' AS actor, rank_position FROM decided WHERE id % 3 <> 2",
)
def _scored_events(spark, sf):
    events = rank.scored_events(positioned(spark, sf), _stored(spark, sf), now=now())
    position = F.get_json_object("detail", "$.rank_position").cast("bigint").alias("rank_position")
    return events.select("job_id", "event_type", "occurred_at", "actor", position)


_EXISTING_SQL = "known AS (SELECT DISTINCT lower(trim(title || ' @ ' || trim(company))) AS k FROM docs WHERE id % 7 = 0)"
_CARDS_SQL = (
    f"{DECIDED_SQL}, {_EXISTING_SQL}, cards AS (SELECT id, rank_position, lower(trim(title || ' @ ' || trim(company))) AS k, is_remote, location, "
    "CASE WHEN id % 5 <> 0 THEN decision END AS decision FROM decided), "
    f"graded AS (SELECT *, k IN (SELECT k FROM known) AS old, CASE WHEN decision IS NULL THEN ({remote_gate_sql()}) ELSE decision LIKE 'promoted%' END AS ok FROM cards)"
)


def _cards(spark, sf):
    rows = positioned(spark, sf).withColumn("decision", F.when(c("id") % 5 != 0, c("decision")))
    known = docs(spark, sf).filter(c("id") % 7 == 0).select(
        F.concat_ws(" @ ", "title", F.trim("company")).alias("title")
    )
    return rows, known


@query(
    "push_select",
    f"WITH {_CARDS_SQL} SELECT arg_min(id, rank_position) AS id, k AS card_key FROM graded WHERE ok AND NOT old GROUP BY k",
)
def _push_select(spark, sf):
    rows, known = _cards(spark, sf)
    return push.push_select(rows, known, n=None).select("id", "card_key")


@query(
    "push_events",
    f"WITH {_CARDS_SQL}, won AS (SELECT arg_min(id, rank_position) AS id FROM graded WHERE ok AND NOT old GROUP BY k) "
    "SELECT id + 5000000 AS job_id, 'pushed_to_linear' AS event_type, 'card-' || CAST(id AS VARCHAR) AS issue FROM won WHERE id % 3 <> 2",
)
def _push_events(spark, sf):
    rows, known = _cards(spark, sf)
    made = push.push_select(rows, known, n=None).withColumns(
        {
            "issue_id": F.concat(F.lit("card-"), c("id").cast("string")),
            "issue_url": F.concat(F.lit("https://cards.example/"), c("id").cast("string")),
        }
    )
    events = push.push_events(made, _stored(spark, sf), now=now())
    return events.select("job_id", "event_type", F.get_json_object("detail", "$.linear_issue_id").alias("issue"))


@query(
    "agg_skip_reasons",
    f"WITH {_CARDS_SQL}, w AS (SELECT k, min(rank_position) AS f FROM graded WHERE ok AND NOT old GROUP BY k) "
    "SELECT CASE WHEN old THEN 'skipped_existing' WHEN f < rank_position THEN 'skipped_existing' WHEN NOT ok AND decision IS NULL THEN 'skipped_non_remote' "
    "WHEN NOT ok THEN 'skipped_' || decision ELSE 'created' END AS reason, count(*) AS n FROM graded LEFT JOIN w ON w.k = graded.k GROUP BY 1",
)
def _agg_skip_reasons(spark, sf):
    return agg_skip_reasons(*_cards(spark, sf))


_DIGEST_SQL = (
    f"{DECIDED_SQL}, {REFERENCE_SQL}, dig AS (SELECT rank_position + 1 AS rank, trim(company) AS company, lower(trim(company)) IN (SELECT name FROM reference) AS is_reference, "
    f"CAST(rank_position + 1 AS VARCHAR) || '. ' || {tier_sql('similarity')} || ' **' || trim(title) || '** @ ' || trim(company) || CASE WHEN lower(trim(company)) IN (SELECT name FROM reference) THEN ' ⭐' ELSE '' END "
    "|| CASE WHEN is_remote THEN ' 🌐' ELSE '' END || ' (' || CAST(round(CAST(similarity AS DECIMAL(12, 3)), 2) AS VARCHAR) || ')' AS header, '   📍 ' || source || ' · ' || url AS source_line, "
    "'   score ' || CAST(round(CAST(similarity AS DECIMAL(12, 3)), 2) AS VARCHAR) || ' · decision: ' || decision AS meta_line FROM decided)"
)


@query(
    "digest_rows",
    f"WITH {_DIGEST_SQL} SELECT rank, company, is_reference, md5(regexp_replace(header, '\\(\\d.*$', '')) AS header_md5, source_line, "
    "regexp_replace(meta_line, 'score [0-9.]+', 'score') AS meta FROM dig",
)
def _digest_rows(spark, sf):
    rows = digest.digest_rows(positioned(spark, sf), reference(spark, sf))
    return rows.select(
        "rank", "company", "is_reference",
        F.md5(F.regexp_replace("header", r"\(\d.*$", "")).alias("header_md5"),
        "source_line",
        F.regexp_replace("meta_line", r"score [0-9.]+", "score").alias("meta"),
    )


_PICKS = "(SELECT string_agg(header || chr(10) || source_line || chr(10) || meta_line || chr(10) || chr(10), '' ORDER BY rank) FROM dig WHERE rank <= 3)"
_HITS = "(SELECT string_agg(company, ', ' ORDER BY rank) FROM (SELECT company, rank FROM dig WHERE is_reference ORDER BY rank LIMIT 5))"
_FULL = (
    f"'📡 **Ranked Digest** — ' || CAST((SELECT count(*) FROM dig) AS VARCHAR) || ' roles in queue' || chr(10) || chr(10) || '**Top picks:**' || chr(10) || {_PICKS} "
    f"|| coalesce('⭐ Reference company hits: ' || {_HITS} || chr(10) || chr(10), '') || '_Next digest follows tomorrow. Reply `apply` on any card to move it forward._'"
)


@query(
    "digest_message",
    f"WITH {_DIGEST_SQL}, f AS (SELECT {_FULL} AS m), g AS (SELECT m, array_to_string(string_split(m, chr(10))[1:12], chr(10)) AS s FROM f) "
    "SELECT (SELECT count(*) FROM dig) AS total, CASE WHEN length(m) <= 2000 THEN m WHEN length(s) <= 2000 THEN s ELSE left(s, 1997) || '...' END AS message FROM g",
)
def _digest_message(spark, sf):
    return digest.digest_message(positioned(spark, sf), reference(spark, sf))
