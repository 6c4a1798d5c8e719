"""Registry of queries and the SQL they are compared with, and SQL fragments shared by them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from confluo.functions.text import WHITE_SPACE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"\p{L}\p{Nd}_"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments ----------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITE_SPACE)})"


def case(pairs: Sequence[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def mapped(x: str, mapping: Mapping[str, str], default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def bounded(pattern: str) -> str:
    """The pattern with word boundaries spelled out for any alphabet."""
    if pattern.endswith(r"\)\b"):
        pattern = pattern[:-2] + f"[{WORD}]"
    elif pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:[^{WORD}]|$)"
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|[^{WORD}])" + pattern[2:]
    return pattern


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + bounded(pattern.removeprefix('(?i)')))})"


def any_match(x: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(matches(x, p) for p in patterns) + ")"


def any_in(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def norm_base(x: str) -> str:
    plain = f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9 \\-]', ' ', 'g')"
    return f"trim(regexp_replace({plain}, ' +', ' ', 'g'))"
