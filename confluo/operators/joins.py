"""Set-based lookups between incoming rows and stored rows.

No join carries a broadcast hint: the session's size threshold decides, on file sizes at
planning and on measured sizes at run time, and skewed keys are split by AQE: lookup tables
that were aggregated by the join key get an exchange of their own for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import card_key
from confluo.functions.text import norm_name_simple, norm_url, slug_candidates, strip, url_key
from confluo.operators.dedup import first_by
from confluo.session import own_exchange


def join_url_exact(incoming: DataFrame, stored: DataFrame, *, url: str = "url") -> DataFrame:
    """``matched_id``: the stored row whose URL equals the incoming one's normal form, else
    the one whose URL equals it as written, else NULL."""
    left = incoming.withColumn("__norm", norm_url(F.col(url)))
    keys = own_exchange(stored.groupBy(F.col("url").alias("__url")).agg(F.min("id").alias("__id")))
    by_norm = keys.select(F.col("__url").alias("__norm"), F.col("__id").alias("__by_norm"))
    by_raw = keys.select(F.col("__url").alias(url), F.col("__id").alias("__by_raw"))
    joined = left.join(by_norm, "__norm", "left").join(by_raw, url, "left")
    matched = F.when(F.coalesce(F.col(url), F.lit("")) != "", F.coalesce("__by_norm", "__by_raw"))
    return joined.select(*incoming.columns, matched.alias("matched_id"))


def join_url_hash(ranked: DataFrame, stored: DataFrame, *, url: str = "url") -> DataFrame:
    """Adds ``job_id`` by URL hash (smallest id per hash); rows without a match are dropped."""
    ids = stored.groupBy(url_key(F.col("url")).alias("__hash")).agg(F.min("id").alias("job_id"))
    return ranked.withColumn("__hash", url_key(F.col(url))).join(own_exchange(ids), "__hash").drop("__hash")


def join_block_candidates(incoming: DataFrame, stored: DataFrame, *, block: str = "company_normalized") -> DataFrame:
    """Size and extremes of each incoming row's block among the stored keys.

    The candidates themselves would be all pairs within a block; those that can still reach
    a floor come, scored, from ``similar_keys``.
    """
    blocks = (
        stored.filter(F.col("canonical_key").isNotNull() & F.col(block).isNotNull())
        .groupBy(block)
        .agg(
            F.count(F.lit(1)).alias("n_candidates"),
            F.min("id").alias("first_candidate_id"),
            F.max("id").alias("last_candidate_id"),
        )
    )
    return incoming.join(own_exchange(blocks), block)


def anti_terminal(jobs: DataFrame, closed: DataFrame, *, key: str = "id", closed_key: str = "job_id") -> DataFrame:
    return jobs.join(closed.select(F.col(closed_key).alias(key)), key, "left_anti")


def anti_existing_title(cards: DataFrame, existing: DataFrame, *, order: str = "arrival") -> DataFrame:
    """Cards whose title is new, first of each title in the batch."""
    known = existing.select(F.lower(strip(F.col("title"))).alias("card_key"))
    keyed = cards.withColumn("card_key", card_key(F.col("title"), F.col("company")))
    return first_by(
        keyed.join(known, "card_key", "left_anti"), keys=["card_key"], order=[F.col(order)]
    )


def anti_processed(posts: DataFrame, processed: DataFrame, *, key: str = "post_url") -> DataFrame:
    return posts.join(processed.select(key), key, "left_anti")


def join_json_key(
    issues: DataFrame,
    events: DataFrame,
    *,
    path: str = "$.linear_issue_id",
    event_type: str = "pushed_to_linear",
    issue_id: str = "id",
    order: str | Column = "id",
) -> DataFrame:
    """Adds ``job_id`` of the first push event whose JSON detail names the issue; issues
    without one are dropped."""
    order = F.col(order) if isinstance(order, str) else order
    pushed = events.filter(F.col("event_type") == event_type)
    found = F.get_json_object("detail", path)
    ids = (
        pushed.select(found.alias("__issue"), "job_id", order.alias("__order"))
        .filter(F.col("__issue").isNotNull())
        .groupBy("__issue")
        .agg(F.min_by("job_id", "__order").alias("job_id"))
    )
    ids = own_exchange(ids)
    return issues.join(ids, issues[issue_id] == ids["__issue"]).drop("__issue")


def enrich_reference(
    rows: DataFrame,
    reference: DataFrame,
    *,
    name: str = "company",
    reference_name: str = "name",
    columns: Sequence[str] = ("priority",),
    order: str = "position",
) -> DataFrame:
    """Left lookup of the reference list by case-insensitive name; first entry per name.
    Adds the columns and ``is_reference``."""
    first = F.min_by(F.struct(*columns), F.col(order))
    listed = reference.groupBy(F.lower(strip(F.col(reference_name))).alias("__name")).agg(first.alias("__ref"))
    joined = rows.withColumn("__name", F.lower(strip(F.col(name)))).join(own_exchange(listed), "__name", "left")
    return joined.select(
        *rows.columns,
        *[F.col(f"__ref.{c}").alias(c) for c in columns],
        F.col("__ref").isNotNull().alias("is_reference"),
    )


def probe_first_hit(
    companies: DataFrame,
    boards: DataFrame,
    *,
    platforms: Sequence[str] = D.PLATFORM_ORDER,
) -> DataFrame:
    """First (platform, slug) of each company that has openings in the board snapshot.

    Input ``name, website`` and ``platform, slug, n_jobs``; companies without a hit are dropped.
    """
    slugs = companies.select(
        "*", F.posexplode(slug_candidates(F.col("name"), F.col("website"))).alias("__slug_pos", "slug")
    )
    rank = F.array_position(F.array(*[F.lit(p) for p in platforms]), F.col("platform"))
    live = boards.filter((F.col("n_jobs") > 0) & F.col("platform").isin(list(platforms)))
    hits = slugs.join(live.withColumn("__platform_pos", rank), "slug")
    best = first_by(
        hits, keys=companies.columns, order=[F.col("__platform_pos"), F.col("__slug_pos")]
    )
    return best.select(
        *companies.columns,
        F.col("platform").alias("ats_platform"),
        F.col("slug").alias("ats_slug"),
        F.col("n_jobs").cast("bigint").alias("job_count"),
        F.lit(True).alias("ats_slug_verified"),
        F.lit("").alias("industry"),
        F.lit(False).alias("is_dream_company"),
        F.concat(
            F.lit("Auto-verified: "), F.col("n_jobs").cast("string"), F.lit(" jobs on "), F.col("platform")
        ).alias("notes"),
    )


def reference_key(name: str = "name") -> Column:
    return norm_name_simple(F.col(name))
