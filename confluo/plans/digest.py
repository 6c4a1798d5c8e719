"""Digest of the ranked list. Only the rows that a message shows are ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import score_tier
from confluo.functions.text import strip
from confluo.operators.joins import enrich_reference


def _text(c: str, default: str = "") -> Column:
    return strip(F.coalesce(F.col(c), F.lit(default)))


def digest_rows(ranked: DataFrame, reference: DataFrame, *, n: int | None = None, order: str = "rank_position") -> DataFrame:
    """Per ranked row: rank (1-based), header, source line, score and decision line, entry."""
    rows = ranked if n is None else ranked.orderBy(order).limit(n)
    rows = enrich_reference(rows, reference, columns=("name",))
    score = F.format_string("%.2f", F.col("similarity"))
    header = F.concat(
        (F.col(order) + 1).cast("string"), F.lit(". "), score_tier(F.col("similarity")),
        F.lit(" **"), _text("title"), F.lit("** @ "), _text("company"),
        F.when(F.col("is_reference"), D.REFERENCE_BADGE).otherwise(""),
        F.when(F.coalesce("is_remote", F.lit(False)), D.REMOTE_BADGE).otherwise(""),
        F.coalesce(F.concat(F.lit(" ("), F.when(F.col("similarity").isNotNull(), score), F.lit(")")), F.lit("")),
    )
    url = F.nullif(_text("url"), F.lit(""))
    source = F.nullif(F.coalesce(F.col("source"), F.lit("")), F.lit(""))
    place = F.concat(
        F.lit("   📍 "), strip(F.coalesce(source, F.lit("unknown"))),
        F.coalesce(F.concat(F.lit(" · "), url), F.lit("")),
    )
    meta = F.concat_ws(
        " · ",
        F.when(F.col("similarity").isNotNull(), F.concat(F.lit("score "), score)),
        F.when(F.coalesce("decision", F.lit("")) != "", F.concat(F.lit("decision: "), F.col("decision"))),
    )
    meta_line = F.when(meta != "", F.concat(F.lit("   "), meta))
    return rows.select(
        (F.col(order) + 1).cast("bigint").alias("rank"),
        _text("company").alias("company"),
        "is_reference",
        header.alias("header"),
        place.alias("source_line"),
        meta_line.alias("meta_line"),
        F.array_compact(F.array(header, place, meta_line)).alias("lines"),
    )


def digest_message(ranked: DataFrame, reference: DataFrame, *, n: int | None = None, order: str = "rank_position") -> DataFrame:
    """One row ``(total, message)`` of all ranked rows, or the first ``n``: header, top picks,
    reference hits, closing line; cut to the message limit.

    The list is counted by partial aggregates; its featured rows and first reference hits are
    all that is gathered, however long it is.
    """
    rows = digest_rows(ranked if n is None else ranked.orderBy(order).limit(n), reference, order=order)
    counted = rows.groupBy().agg(
        F.count(F.lit(1)).alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= D.FEATURED_ROWS, F.struct("rank", "lines")))).alias("top"),
    )
    first = rows.filter("is_reference").select("rank", "company").orderBy("rank").limit(D.REFERENCE_HITS)
    named = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "company"))).alias("hits"))
    gathered = counted.unionByName(named, allowMissingColumns=True).groupBy().agg(
        F.max("total").alias("total"), *[F.first(x, ignorenulls=True).alias(x) for x in ("top", "hits")]
    )
    head = F.array(
        F.concat(
            F.lit("📡 **Ranked Digest** — "), F.col("total").cast("string"),
            F.when(F.col("total") == 1, " role in queue").otherwise(" roles in queue"),
        ),
        F.lit(""),
        F.lit("**Top picks:**"),
    )
    picks = F.flatten(F.transform("top", lambda s: F.concat(s["lines"], F.array(F.lit("")))))
    names = F.array_join(F.transform(F.slice("hits", 1, D.REFERENCE_HITS), lambda s: s["company"]), ", ")
    hits = F.when(
        F.size("hits") > 0, F.array(F.concat(F.lit("⭐ Reference company hits: "), names), F.lit(""))
    ).otherwise(F.array().cast("array<string>"))
    closing = F.array(F.lit("_Next digest follows tomorrow. Reply `apply` on any card to move it forward._"))
    lines = F.concat(head, picks, hits, closing)
    full = F.array_join(lines, "\n")
    short = F.array_join(F.slice(lines, 1, D.MESSAGE_LINES), "\n")
    cut = F.concat(F.left(short, F.lit(D.MESSAGE_LIMIT - 3)), F.lit("..."))
    message = (
        F.when(F.col("total") == 0, "📭 No new roles today.")
        .when(F.char_length(full) <= D.MESSAGE_LIMIT, full)
        .when(F.char_length(short) <= D.MESSAGE_LIMIT, short)
        .otherwise(cut)
    )
    return gathered.select("total", message.alias("message"))
