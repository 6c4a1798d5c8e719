"""First, latest and best row per key.

Every operator keeps at most one row per key and map task before the shuffle (group-limit
on the window, or a partial aggregate), so a key that holds most of the rows is not
gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import source_priority
from confluo.functions.text import norm_company, norm_title, strip

_RN = "__rn"


def first_by(df: DataFrame, *, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit total order."""
    names = [f"__k{i}" for i in range(len(keys))]
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(cols, names)])
    window = Window.partitionBy(*names).orderBy(*order)
    return keyed.withColumn(_RN, F.row_number().over(window)).filter(F.col(_RN) == 1).drop(_RN, *names)


def dedup_first(df: DataFrame, *, keys: Sequence[str | Column], order: str = "arrival") -> DataFrame:
    """Keep the first arrival per key. See ``key_*`` for the usual keys."""
    return first_by(df, keys=keys, order=[F.col(order).asc()])


def key_company_title(company: str = "company", title: str = "title") -> list[Column]:
    empty = F.lit("")
    return [norm_company(F.coalesce(F.col(company), empty)), norm_title(F.coalesce(F.col(title), empty))]


def key_company_title_prefix(company: str = "company", title: str = "title", chars: int | None = None) -> list[Column]:
    """Lower-case company and title; of the title only the first ``chars`` where given."""
    name = F.col(title) if chars is None else F.substring(F.col(title), 1, chars)
    return [F.lower(F.col(company)), F.lower(name)]


def key_lower_name(name: str = "name") -> list[Column]:
    return [F.lower(strip(F.col(name)))]


def latest_per_key(
    df: DataFrame, *, key: str = "job_id", time: str = "occurred_at", tie: str = "id"
) -> DataFrame:
    return first_by(df, keys=[key], order=[F.col(time).desc(), F.col(tie).desc()])


def terminal_keys(
    events: DataFrame,
    *,
    key: str = "job_id",
    time: str = "occurred_at",
    tie: str = "id",
    types: Sequence[str] = D.TERMINAL_TYPES,
) -> DataFrame:
    """Keys whose latest event is terminal (an earlier terminal event does not count)."""
    newest = latest_per_key(events.select(key, time, tie, "event_type"), key=key, time=time, tie=tie)
    return newest.filter(F.col("event_type").isin(list(types))).select(key)


def prefer_key(company: Column, title: Column) -> list[Column]:
    none = F.lit("None")
    name = F.lower(strip(F.coalesce(company, none)))
    words = F.regexp_replace(F.lower(strip(F.coalesce(title, none))), r"\s+", " ")
    return [name, words]


def dedup_prefer_source(df: DataFrame, *, arrival: str = "arrival") -> DataFrame:
    """One row per (company, title): the best source class, then the earliest arrival.

    ``position`` is the first arrival of the key, whichever row wins.
    """
    company, title = prefer_key(F.col("company"), F.col("title"))
    keyed = df.withColumns({"__c": company, "__t": title})
    # two readings, one partitioning: the window keeps a row per key and task before the
    # shuffle, the aggregate carries a number per key, and their join needs no exchange
    window = Window.partitionBy("__c", "__t").orderBy(source_priority(F.col("source")), F.col(arrival))
    best = keyed.withColumn(_RN, F.row_number().over(window)).filter(F.col(_RN) == 1).drop(_RN)
    first = keyed.groupBy("__c", "__t").agg(F.min(arrival).alias("position"))
    return best.join(first, ["__c", "__t"]).select(*df.columns, "position")
