"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.session import materialize

#: The white space of the contracts: space, and tab to carriage return.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def without_blanks(text: Column) -> Column:
    """The text after deleting every blank of :data:`BLANKS`."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A projection would do, but the optimizer may merge projections and so repeat a costly
    value inside a lambda, once per element.
    """
    return F.transform(F.array(value), body)[0]


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = 4 << 20) -> Iterator[None]:
    """Hand Python at most ``rows`` rows, and about ``size`` bytes, at a time in what is run inside:
    rows with whole texts, or with many, would else come ten thousand or 64 MB at once."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in limits}
    for key, most in limits.items():
        now = int(before[key].rstrip("b"))
        spark.conf.set(key, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def numbered(rows: DataFrame, label: str, column: str) -> DataFrame:
    """The rows, written to the shared folder with a row number that later reads agree on.

    Ids can repeat, rows too; the number tells repeated rows apart. It is unique, not gapless.
    """
    return materialize(rows.withColumn(column, F.monotonically_increasing_id()), label)
