"""Declared table schemas as DDL text, which every Spark reader takes. Times are zone-less UTC; JSON columns are text at rest."""

from __future__ import annotations


def columns(ddl: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [part.split()[0] for part in ddl.split(", ")]


JOB_SCHEMA = (
    "source string, source_id string, url string, title string, company string, "
    "location string, description string, salary_min double, salary_max double, "
    "salary_currency string, date_posted timestamp_ntz, is_remote boolean, job_type string, "
    "seniority string, department string, company_industry string, company_size string, "
    "metadata string, status string, notes string"
)
STORED_JOB_SCHEMA = (
    f"id bigint, {JOB_SCHEMA}, url_hash string, company_normalized string, "
    "canonical_key string, linear_issue_id string, date_first_seen timestamp_ntz, "
    "date_last_seen timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
SOURCE_SCHEMA = (
    "job_id bigint, source_name string, source_url string, raw_payload string, "
    "first_seen timestamp_ntz, last_seen timestamp_ntz, source_trust string"
)
EVENT_SCHEMA = (
    "job_id bigint, event_type string, occurred_at timestamp_ntz, actor string, detail string"
)
SCORE_SCHEMA = (
    "job_id bigint, ranker_version string, score double, rank_position bigint, "
    "component_scores string, decision string, scoring_detail string, scored_at timestamp_ntz"
)
COMPANY_SCHEMA = (
    "canonical_name string, name string, website string, industry string, hq_location string, "
    "company_size string, funding_stage string, ats_platforms_json string, is_dream boolean, "
    "why_i_love string, priority string, status string, discovery_path string, "
    "active_role string, active_role_url string, notes string, source string, added_at string, "
    "last_funding_date timestamp_ntz, last_funding_amount double, last_funding_stage string, "
    "linkedin_url string, twitter_handle string, founded_year bigint, attraction_types string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
ATTRACTION_SCHEMA = "canonical_name string, attribute string, weight double, source string"
POLL_STATE_SCHEMA = "feed_id string, last_polled_at timestamp_ntz"
SKILL_GAP_SCHEMA = (
    "job_id bigint, skill string, priority string, status string, notes string, "
    "created_at timestamp_ntz"
)
ARCHIVE_JOB_SCHEMA = (
    f"id bigint, {JOB_SCHEMA}, url_hash string, linear_issue_id string, "
    "date_first_seen timestamp_ntz, date_last_seen timestamp_ntz, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, archived_at timestamp_ntz"
)
ARCHIVE_EVENT_SCHEMA = f"id bigint, {EVENT_SCHEMA}, archived_at timestamp_ntz"
TELEMETRY_SCHEMA = (
    "ts string, outcome string, job_id bigint, matched_job_id bigint, source_name string, "
    "canonical_key string, fuzzy_score double, trust_flipped boolean"
)
ISSUE_SCHEMA = (
    "id string, identifier string, title string, url string, state struct<name:string>, "
    "comments struct<nodes:array<struct<id:string,body:string,createdAt:string,"
    "user:struct<name:string>>>>, updatedAt string"
)
