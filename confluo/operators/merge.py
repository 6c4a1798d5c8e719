"""Keyed merges: the new table is one join of the stored table and the batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.text import canonical_key, norm_company, norm_name_simple, strip
from confluo.operators.dedup import first_by

JOB_UPDATES = (
    "title", "company", "location", "description", "salary_min", "salary_max",
    "salary_currency", "date_posted", "is_remote", "job_type", "seniority", "department",
    "company_industry", "company_size", "source_id", "status", "notes", "metadata",
)
COMPANY_UPDATES = (
    "website", "industry", "company_size", "funding_stage", "is_dream", "why_i_love",
    "priority", "status", "notes", "source", "ats_platforms_json",
)


def merge_upsert(
    stored: DataFrame,
    incoming: DataFrame,
    *,
    keys: Sequence[str],
    updates: Sequence[str],
    insert_only: Sequence[str] = (),
    now: Column,
    touched: Sequence[str] = ("updated_at",),
    created: Sequence[str] = ("created_at",),
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """Full-outer merge. Matched rows take the incoming value of the ``updates`` columns
    where it is not NULL and bump ``touched``; unmatched incoming rows are inserted with
    ``defaults``. ``is_new`` tells inserted rows; untouched rows keep everything.

    The incoming side must hold one row per key.
    """
    keys = list(keys)
    defaults = defaults or {}
    data = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*data).alias("__old"))
    new_cols = [c for c in incoming.columns if c not in keys]
    new = incoming.select(*keys, F.struct(F.lit(1).alias("__one"), *new_cols).alias("__new"))
    joined = old.join(new, keys, "full_outer")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(c: str) -> Column:
        before = F.col("__old")[c]
        fresh = F.col("__new")[c] if c in new_cols else F.lit(None)
        if c in touched:
            return F.when(has_new, now).otherwise(before)
        if c in created:
            return F.when(has_old, before).otherwise(now)
        inserted = F.coalesce(fresh, defaults[c]) if c in defaults else fresh
        updated = F.coalesce(fresh, before) if c in updates and c not in insert_only else before
        return F.when(has_old, updated).otherwise(inserted)

    return joined.select(
        *keys,
        *[value(c).cast(stored.schema[c].dataType).alias(c) for c in data],
        (~has_old).alias("is_new"),
    )


def merge_upsert_row(stored: DataFrame, incoming: DataFrame, *, now: Column) -> DataFrame:
    """Job rows by URL."""
    return merge_upsert(
        stored,
        incoming,
        keys=["url"],
        updates=JOB_UPDATES,
        now=now,
        touched=("date_last_seen", "updated_at"),
        created=("date_first_seen", "created_at"),
        defaults={"salary_currency": F.lit("USD"), "status": F.lit("new"), "metadata": F.lit("{}")},
    )


def merge_upsert_dim(stored: DataFrame, incoming: DataFrame, *, now: Column, name: str = "name") -> DataFrame:
    """Company rows by simple name; only the listed columns are ever updated."""
    keyed = incoming.withColumn("canonical_name", norm_name_simple(F.col(name)))
    return merge_upsert(
        stored,
        keyed,
        keys=["canonical_name"],
        updates=COMPANY_UPDATES,
        now=now,
        defaults={"is_dream": F.lit(False)},
    )


def mark_seen(stored: DataFrame, urls: DataFrame, *, now: Column) -> DataFrame:
    seen = urls.select("url").distinct().withColumn("__seen", F.lit(True))
    bump = {c: F.when(F.col("__seen"), now).otherwise(F.col(c)) for c in ("date_last_seen", "updated_at")}
    return stored.join(seen, "url", "left").withColumns(bump).drop("__seen").select(*stored.columns)


def needs_backfill(jobs: DataFrame) -> DataFrame:
    """Recompute both derived keys where either is NULL; other rows pass unchanged."""
    missing = F.col("company_normalized").isNull() | F.col("canonical_key").isNull()
    key = canonical_key(F.col("title"), F.col("company"), F.col("location"))
    name = norm_company(F.coalesce(F.col("company"), F.lit("")))
    return jobs.withColumns(
        {
            "company_normalized": F.when(missing, name).otherwise(F.col("company_normalized")),
            "canonical_key": F.when(missing, key).otherwise(F.col("canonical_key")),
        }
    )


def insert_missing_dim(stored: DataFrame, incoming: DataFrame, *, key: str = "canonical_name") -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(key), key, "left_anti").select(*incoming.columns)


def attraction_bridge(
    companies: DataFrame, stored: DataFrame | None = None, *, key: str = "canonical_name", source: str = "dream_list"
) -> DataFrame:
    """One row per (company, attribute) that is not stored yet."""
    pairs = (
        companies.select(key, F.explode("attraction_types").alias("attribute"))
        .distinct()
        .withColumns({"weight": F.lit(1.0), "source": F.lit(source)})
    )
    if stored is None:
        return pairs
    return pairs.join(stored.select(key, "attribute"), [key, "attribute"], "left_anti")


def backfill_legacy_source(
    jobs: DataFrame, sources: DataFrame, *, now: Column, source: str = D.LEGACY_SOURCE
) -> DataFrame:
    """Untrusted provenance rows for jobs that have none of that source."""
    have = sources.filter(F.col("source_name") == source).select(F.col("job_id").alias("id"))
    seen = F.coalesce(F.col("created_at"), now)
    return jobs.join(have, "id", "left_anti").select(
        F.col("id").alias("job_id"),
        F.lit(source).alias("source_name"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("raw_payload"),
        seen.alias("first_seen"),
        seen.alias("last_seen"),
        F.lit(D.UNTRUSTED).alias("source_trust"),
    )


def merge_append_new(
    stored: DataFrame, incoming: DataFrame, *, name: str = "name", order: str = "arrival"
) -> DataFrame:
    """Stored rows plus the first incoming row of each new name; blank names are dropped."""
    key = F.lower(strip(F.coalesce(F.col(name), F.lit(""))))
    have = stored.select(key.alias("__key"))
    fresh = incoming.withColumn("__key", key).filter(F.col("__key") != "")
    added = first_by(fresh.join(have, "__key", "left_anti"), keys=["__key"], order=[F.col(order)])
    return stored.unionByName(added.drop("__key"), allowMissingColumns=True)


def agg_platform_array(rows: DataFrame, *, key: str = "canonical_name", order: str = "position") -> DataFrame:
    """Per name the first entry of each platform, as an array of structs in first-seen order.

    The array holds distinct platforms only, so it does not grow with the rows.
    """
    entry = F.struct(
        F.col("ats_platform").alias("platform"),
        F.col("ats_slug").alias("slug"),
        F.coalesce(F.col("ats_slug_verified"), F.lit(False)).alias("verified"),
        F.coalesce(F.col("job_count").cast("bigint"), F.lit(0).cast("bigint")).alias("job_count"),
    )
    first = rows.groupBy(key, "ats_platform").agg(
        F.min(order).alias("pos"), F.min_by(entry, F.col(order)).alias("entry")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "entry")))
    return first.groupBy(key).agg(F.transform(ordered, lambda s: s["entry"]).alias("ats_info"))


def merge_two_lists(list_a: DataFrame, list_b: DataFrame, *, order: str = "position") -> DataFrame:
    """Two reference lists merged by simple name.

    Name: first seen (list A before B). Platforms: distinct, from A. Website and notes: A's
    first row unless empty, else the first non-empty of B. The B columns: the last row of B.
    Provenance ``yc_seed``, ``dream_list`` or ``both`` (also for a name repeated within B).
    """
    a = list_a.withColumn("canonical_name", norm_name_simple(F.col("name")))
    b = list_b.withColumn("canonical_name", norm_name_simple(F.col("name")))
    first_a = F.min_by(F.struct("name", "website", "industry", "notes"), F.col(order))
    left = a.groupBy("canonical_name").agg(
        first_a.alias("a"), F.max(F.coalesce("is_dream_company", F.lit(False))).alias("a_dream")
    ).join(agg_platform_array(a, order=order), "canonical_name", "left")
    last = (
        "why_i_love_this", "attraction_types", "priority", "status", "discovery_path",
        "active_role", "active_role_url", "added",
    )

    def first_filled(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c) != "", F.col(order)))

    right = b.groupBy("canonical_name").agg(
        F.min_by("name", order).alias("b_name"),
        F.min_by("notes", order).alias("b_notes_first"),
        F.min_by("url", order).alias("b_url_first"),
        first_filled("url").alias("b_url"),
        first_filled("notes").alias("b_notes"),
        F.max_by(F.struct(*last), F.col(order)).alias("b"),
        F.count(F.lit(1)).alias("b_rows"),
    )
    joined = left.join(right, "canonical_name", "full_outer")
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()

    def filled(mine: Column, other: Column, other_first: Column) -> Column:
        kept = F.coalesce(F.nullif(mine, F.lit("")), other, mine)
        return F.when(in_a, kept).otherwise(F.coalesce(other, other_first))

    return joined.select(
        "canonical_name",
        F.when(in_a, F.col("a.name")).otherwise(F.col("b_name")).alias("name"),
        filled(F.col("a.website"), F.col("b_url"), F.col("b_url_first")).alias("website"),
        F.col("a.industry").alias("industry"),
        F.col("ats_info"),
        (F.coalesce("a_dream", F.lit(False)) | in_b).alias("is_dream"),
        filled(F.col("a.notes"), F.col("b_notes"), F.col("b_notes_first")).alias("notes"),
        F.when(in_a & in_b, "both")
        .when(in_a, "yc_seed")
        .when(F.col("b_rows") > 1, "both")
        .otherwise("dream_list")
        .alias("source"),
        *[F.col(f"b.{c}").alias(c) for c in last],
    )
