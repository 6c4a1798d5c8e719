"""Landed job-board payloads → canonical rows.

Input rows are ``slug, payload`` (JSON text: a list of postings or an object that wraps
one under ``jobs``). Shapes vary per board, so payloads are read as VARIANT.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions.labels import json_build
from confluo.functions.text import blank_to_null, job_type_map, remote_flag, ts_coerce
from confluo.schemas import JOB_SCHEMA, columns

_TYPES = dict(part.split() for part in JOB_SCHEMA.split(", "))


def canonical(rows: DataFrame, values: Mapping[str, Column], *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the canonical schema; columns not given are NULL."""
    cols = [values.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in columns(JOB_SCHEMA)]
    return rows.select(*keep, *cols)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines ``{platform, name, slug, payload}`` with the payload as text."""
    return spark.read.schema("platform string, name string, slug string, payload string").json(path)


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _value(v: Column, path: str) -> Column:
    """Scalar at a path as text; objects and lists give NULL."""
    kind = _kind(v, path)
    scalar = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    return F.when(scalar, F.try_variant_get(v, path, "string"))


def _filled(v: Column, path: str) -> Column:
    return F.nullif(_value(v, path), F.lit(""))


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def postings(payloads: DataFrame, *, wrapped: bool = True) -> DataFrame:
    """One row per posting, as VARIANT ``p``; undecodable payloads give no rows."""
    doc = F.try_parse_json("payload")
    items = F.coalesce(_list(doc, "$.jobs"), _list(doc, "$")) if wrapped else _list(doc, "$")
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*keep, F.explode(items).alias("p")).filter(_kind(F.col("p"), "$").startswith("OBJECT"))


def src_board_greenhouse(payloads: DataFrame) -> DataFrame:
    rows, p = postings(payloads), F.col("p")
    slug, ident = F.col("slug"), F.coalesce(_value(p, "$.id"), F.lit(""))
    location = F.coalesce(_filled(p, "$.location.name"), _filled(p, "$.location"))
    apply_links = F.filter(_list(p, "$.metadata"), lambda m: F.lower(_value(m, "$.name")) == "apply url")
    url = F.coalesce(
        _filled(F.get(apply_links, F.lit(0)), "$.value"),
        _filled(p, "$.absolute_url"),
        F.concat(F.lit("https://boards.greenhouse.io/"), slug, F.lit("/jobs/"), ident),
    )
    title = F.coalesce(_value(p, "$.title"), F.lit("Unknown"))
    return canonical(
        rows,
        {
            "source": F.lit("greenhouse"),
            "source_id": ident,
            "url": url,
            "title": title,
            "company": F.coalesce(_filled(p, "$.company_name"), slug),
            "location": location,
            "description": F.coalesce(blank_to_null(_value(p, "$.content")), blank_to_null(_value(p, "$.title"))),
            "is_remote": remote_flag(location),
            "department": _value(p, "$.departments[0].name"),
            "metadata": json_build(
                {
                    "greenhouse_internal_id": F.try_variant_get(p, "$.internal_job_id", "bigint"),
                    "greenhouse_updated_at": _value(p, "$.updated_at"),
                },
                keep_nulls=True,
            ),
        },
    )


def src_board_lever(payloads: DataFrame) -> DataFrame:
    rows, p = postings(payloads, wrapped=False), F.col("p")
    ident = F.coalesce(_value(p, "$.id"), F.lit(""))
    places = F.array_join(F.transform(_list(p, "$.categories.location"), lambda x: _value(x, "$")), ", ")
    location = F.coalesce(
        F.nullif(F.coalesce(_value(p, "$.categories.location"), places), F.lit("")),
        _filled(p, "$.categories.team"),
    )
    parts = F.transform(
        _list(p, "$.description"),
        lambda d: F.when(_kind(d, "$").startswith("OBJECT"), F.coalesce(_value(d, "$.content"), F.lit(""))).otherwise(
            _value(d, "$")
        ),
    )
    described = F.nullif(F.coalesce(_value(p, "$.description"), F.array_join(parts, "\n")), F.lit(""))
    return canonical(
        rows,
        {
            "source": F.lit("lever"),
            "source_id": ident,
            "url": F.coalesce(
                _filled(p, "$.hostedUrl"),
                _filled(p, "$.applyUrl"),
                F.concat(F.lit("https://jobs.lever.co/"), F.col("slug"), F.lit("/"), ident),
            ),
            "title": F.coalesce(_value(p, "$.text"), F.lit("Unknown")),
            "company": F.coalesce(_filled(p, "$.categories.company"), F.col("slug")),
            "location": blank_to_null(location),
            "description": blank_to_null(F.coalesce(described, blank_to_null(_value(p, "$.descriptionPlain")))),
            "is_remote": remote_flag(location),
            "job_type": job_type_map(_value(p, "$.categories.commitment")),
            "department": blank_to_null(_value(p, "$.categories.team")),
            "metadata": json_build(
                {"lever_id": _value(p, "$.id"), "lever_created_at": F.try_variant_get(p, "$.createdAt", "bigint")},
                keep_nulls=True,
            ),
        },
    )


def src_board_ashby(payloads: DataFrame) -> DataFrame:
    rows, p = postings(payloads), F.col("p")
    location = F.nullif(F.concat_ws(", ", _filled(p, "$.location"), _filled(p, "$.locationType")), F.lit(""))
    explicit = F.try_variant_get(p, "$.isRemote", "boolean")
    return canonical(
        rows,
        {
            "source": F.lit("ashby"),
            "source_id": F.coalesce(_value(p, "$.id"), F.lit("")),
            "url": F.coalesce(_filled(p, "$.url"), _filled(p, "$.externalUrl"), F.lit("")),
            "title": F.coalesce(_value(p, "$.title"), F.lit("Unknown")),
            "company": F.coalesce(_filled(p, "$.companyName"), F.col("slug")),
            "location": blank_to_null(location),
            "description": F.coalesce(
                blank_to_null(_value(p, "$.description")), blank_to_null(_value(p, "$.descriptionPlain"))
            ),
            "salary_min": F.try_variant_get(p, "$.compensation.min", "double"),
            "salary_max": F.try_variant_get(p, "$.compensation.max", "double"),
            "is_remote": F.coalesce(explicit, remote_flag(location)),
            "job_type": job_type_map(_value(p, "$.employmentType")),
            "department": blank_to_null(_value(p, "$.department")),
            "metadata": json_build({"ashby_id": _value(p, "$.id"), "ashby_is_remote": explicit}, keep_nulls=True),
        },
    )


BOARDS = {"greenhouse": src_board_greenhouse, "lever": src_board_lever, "ashby": src_board_ashby}


def src_board_router(payloads: DataFrame) -> DataFrame:
    """Normalise by platform; unknown platforms give no rows. Land payloads partitioned by
    ``platform`` and each branch prunes to its own files."""
    slug = F.coalesce(
        F.nullif(F.col("slug"), F.lit("")), F.replace(F.lower(F.coalesce("name", F.lit(""))), F.lit(" "), F.lit(""))
    )
    out = None
    for platform, normalise in BOARDS.items():
        part = payloads.filter(F.lower("platform") == platform).select(slug.alias("slug"), "payload")
        rows = normalise(part)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


_LOGO_FIELDS = ("company_logo", "company_url", "company_url_direct", "company_rating", "company_revenue", "emails")


def src_board_rows(rows: DataFrame, *, date_kind: str = "text") -> DataFrame:
    """Flat tabular export → canonical row. Missing values read as the text ``None``, as the
    later sentinel check expects."""
    have = set(rows.columns)

    def text(c: str, missing: str = "", null: str = "None") -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(null)) if c in have else F.lit(missing)

    def raw(c: str) -> Column:
        return F.col(c) if c in have else F.lit(None)

    urls = [F.nullif(F.col(c), F.lit("")) for c in ("job_url", "url") if c in have]
    return canonical(
        rows,
        {
            "source": F.lower(text("site", "unknown")),
            "source_id": text("job_id"),
            "url": F.coalesce(*urls, F.lit("")),
            "title": text("title"),
            "company": text("company"),
            "location": text("location"),
            "description": text("description"),
            "salary_min": raw("min_amount"),
            "salary_max": raw("max_amount"),
            "salary_currency": text("currency", "USD"),
            "date_posted": ts_coerce(raw("date_posted"), kind=date_kind),
            "is_remote": F.coalesce(raw("is_remote").cast("boolean"), F.lit(False)),
            "job_type": text("job_type"),
            "department": F.lit(""),
            "company_industry": text("company_industry"),
            "company_size": text("company_num_employees"),
            "metadata": json_build({c: text(c) for c in _LOGO_FIELDS}, keep_nulls=True),
        },
    )


