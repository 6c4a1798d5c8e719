"""Reference lists, paged company batches and daily telemetry."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.text import strip
from confluo.operators.dedup import first_by, key_lower_name
from confluo.schemas import TELEMETRY_SCHEMA

COMPANY_LIST = (
    "companies array<struct<name:string,website:string,ats_platform:string,ats_slug:string,"
    "ats_slug_verified:boolean,job_count:bigint,industry:string,is_dream_company:boolean,"
    "notes:string,url:string,why_i_love_this:string,attraction_types:array<string>,"
    "priority:string,status:string,added:string,discovery_path:string,active_role:string,"
    "active_role_url:string>>"
)


def src_reference_list(spark: SparkSession, path: str, *, verified_only: bool = False) -> DataFrame:
    """One row per company of a ``{_meta, companies:[…]}`` document, with its position. A
    missing or corrupt file gives no rows."""
    try:
        doc = spark.read.schema(COMPANY_LIST).option("multiLine", True).json(path)
    except AnalysisException:
        doc = spark.createDataFrame([], COMPANY_LIST)
    rows = doc.select(F.posexplode("companies").alias("position", "c")).select("position", "c.*")
    return rows.filter(F.coalesce("ats_slug_verified", F.lit(False))) if verified_only else rows


def src_paged_batches(pages: DataFrame, *, batches: Sequence[str] = D.BATCHES) -> DataFrame:
    """Companies of landed pages ``batch, page, companies array<struct<…>>`` with defaults;
    first per name in (batch order, page, position); blank names dropped."""
    batch_pos = F.array_position(F.array(*[F.lit(b) for b in batches]), F.col("batch"))
    rows = pages.filter(F.col("batch").isin(list(batches))).select(
        "batch", batch_pos.alias("batch_pos"), "page", F.posexplode("companies").alias("pos", "c")
    )
    empty = F.lit("")
    rows = rows.select(
        "batch_pos", "page", "pos",
        F.col("c.name").alias("name"),
        F.col("c.slug").alias("slug"),
        F.coalesce("c.website", empty).alias("website"),
        F.coalesce(F.nullif("c.batch", empty), F.col("batch")).alias("batch"),
        F.coalesce("c.oneLiner", empty).alias("one_liner"),
        F.coalesce("c.industries", F.array().cast("array<string>")).alias("industries"),
        F.col("c.status").alias("status"),
    ).filter(strip(F.coalesce("name", empty)) != "")
    order: list[Column] = [F.col("batch_pos"), F.col("page"), F.col("pos")]
    return first_by(rows, keys=key_lower_name(), order=order)


def parse_window(text: str) -> timedelta:
    """``7`` and ``7d`` are days, ``1h`` hours, ``30m`` minutes."""
    text = text.strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return timedelta(days=int(text))
    match = re.fullmatch(r"(\d+)([dhmDHM])", text)
    if not match:
        raise ValueError(f"Invalid time window format: {text}. Use '1d', '7d', '1h', '30', etc.")
    unit = {"d": "days", "h": "hours", "m": "minutes"}[match[2].lower()]
    return timedelta(**{unit: int(match[1])})


def telemetry_since(records: DataFrame, since: datetime) -> DataFrame:
    """Records whose ``ts`` parses and is not before ``since`` (UTC)."""
    moment = F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp("ts").cast("timestamp_ntz"))
    return records.filter(moment >= F.lit(since).cast("timestamp_ntz"))


def src_telemetry_window(
    spark: SparkSession, path: str, *, now: datetime, last: str = "1d", layout: str = "daily"
) -> DataFrame:
    """Telemetry of the last window. ``daily``: folders ``dt=YYYY-MM-DD``; ``flat``: files
    named ``…YYYY-MM-DD.jsonl``. Days before the window are pruned before reading; malformed
    lines are dropped."""
    since = now - parse_window(last)
    reader = spark.read.option("mode", "DROPMALFORMED")
    try:
        if layout == "daily":
            records = reader.schema(f"{TELEMETRY_SCHEMA}, dt date").json(path)
            records = records.filter(F.col("dt") >= F.lit(since.date())).drop("dt")
        else:
            records = reader.schema(TELEMETRY_SCHEMA).json(path)
            named = F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})\.jsonl$", 1)
            records = records.filter(named >= F.lit(since.date().isoformat()))
    except AnalysisException:
        return spark.createDataFrame([], TELEMETRY_SCHEMA)
    return telemetry_since(records, since)
