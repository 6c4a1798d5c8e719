"""Monthly hiring threads and the postings in their comments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.text import html_links, html_strip, remote_flag, strip
from confluo.operators.dedup import dedup_first, first_by, key_company_title_prefix


def recent_months(now: datetime, months_back: int) -> list[datetime]:
    """First day of this month and of the ``months_back`` months before it."""
    serial = now.year * 12 + now.month - 1
    return [datetime((serial - k) // 12, (serial - k) % 12 + 1, 1) for k in range(months_back + 1)]


def src_thread_select(
    stories: DataFrame,
    *,
    now: datetime,
    months_back: int = 1,
    title_text: str = D.THREAD_TITLE,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Per month the first story whose title has the text and the year and that was created
    after the month began. Input ``id, title, created_at``; newest first unless ``order``."""
    title = F.lower(F.coalesce("title", F.lit("")))
    hits = [
        F.when(
            title.contains(str(m.year)) & (F.col("created_at") > F.lit(m).cast("timestamp_ntz")),
            F.lit(f"{m:%Y-%m}"),
        )
        for m in recent_months(now, months_back)
    ]
    matched = stories.filter(title.contains(title_text)).select(
        "*", F.explode(F.array_compact(F.array(*hits))).alias("month")
    )
    return first_by(matched, keys=["month"], order=order or [F.col("created_at").desc(), F.col("id")])


def comment_rows(
    comments: DataFrame,
    *,
    text: str = "comment_text",
    role: str = D.THREAD_ROLE_PATTERN,
    accept: str = D.THREAD_ACCEPT_PATTERN,
    reject: str = D.THREAD_REJECT_PATTERN,
) -> DataFrame:
    """Comments that read as a posting, before de-duplication. Other columns are kept."""
    keep = [c for c in comments.columns if c != text]
    rows = comments.select(*keep, F.col(text).alias("__raw"), html_strip(F.col(text)).alias("__clean"))
    clean = F.col("__clean")
    lines = F.split(clean, "\n")
    parts = F.transform(F.split(strip(F.get(lines, F.lit(0))), r"\|"), strip)
    rows = rows.select(
        *keep, "__raw", "__clean", parts.alias("__parts"), F.regexp_extract(clean, role, 0).alias("__role")
    )
    company, found = F.get("__parts", F.lit(0)), F.col("__role")
    rows = rows.filter(
        (F.size("__parts") >= 2) & (company != "") & (found != "")
    )
    holder = F.get(F.filter(F.split(clean, "\n"), lambda x: F.lower(x).contains(F.lower(found))), F.lit(0))
    snippet = strip(holder)
    title = F.when(F.char_length(snippet) > F.char_length(found), snippet).otherwise(strip(found))
    remote = remote_flag(clean, variant="phrases")
    near = ~clean.rlike(reject) | clean.rlike(accept) | remote
    return rows.filter(near).select(
        *keep,
        company.alias("company"),
        title.alias("title"),
        F.get("__parts", F.lit(1)).alias("location"),
        remote.alias("is_remote"),
        F.coalesce(F.get(html_links(F.col("__raw")), F.lit(0)), F.lit("")).alias("url"),
        F.lit("hn_hiring").alias("source"),
        clean.alias("raw_text"),
    )


def src_comment_postings(
    comments: DataFrame, *, order: str = "arrival", title_chars: int | None = None, **patterns: str
) -> DataFrame:
    """Postings of the comments, first per (company, title), or per its first
    ``title_chars`` characters where given."""
    return dedup_first(comment_rows(comments, **patterns), keys=key_company_title_prefix(chars=title_chars), order=order)
