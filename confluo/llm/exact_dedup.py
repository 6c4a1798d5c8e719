"""Exact de-duplication by a tree merge of sorted digest runs (DataFrame functions only).

Each map partition is reduced to a *run*: its distinct digests, each with the row that would
stay and the number of rows. Runs are exchanged in rounds: ``FANOUT`` neighbouring runs meet
(run number divided by the fan-out), equal digests merge, the better row stays and counts add
up. After ``ceil(log_FANOUT(partitions))`` rounds one run remains, still spread over all tasks
by digest. A merge is a grouped aggregate on (run, digest): Spark sorts each run by digest and
merges the sorted streams, and combines map-side first, so a text that a third of all rows
share costs one row per partition and round, never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import numbered, whole_text, without_blanks
from confluo.session import materialize

#: Runs that one merge takes in.
FANOUT = 8

#: A digest stands for its text only together with these two: a collision of SHA-256 would
#: have to agree in length and in a hash of another family too, else the texts stay apart.
IDENTITY = ("digest", "check_hash", "norm_chars")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, digest, check_hash, norm_chars, run) per row; null text is empty."""
    norm = without_blanks(whole_text())
    return (
        docs.select("doc_id", whole_text().alias("whole"), norm.alias("norm"))
        .select(
            "doc_id",
            F.length("whole").cast("long").alias("n_chars"),
            F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"),
            F.xxhash64("norm").alias("check_hash"),
            F.length("norm").alias("norm_chars"),
            F.spark_partition_id().alias("run"),
        )
    )


def better_first() -> Column:
    """Orders rows of one text: most code points, then smallest doc_id (null ids last), then row."""
    return F.struct(
        (-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_no")
    )


def merge_runs(runs: DataFrame, n_runs: int, fanout: int = FANOUT) -> DataFrame:
    """One run of distinct digests from ``n_runs`` runs: (digest…, best, group_size)."""
    while n_runs > 1:
        n_runs = -(-n_runs // fanout)
        runs = runs.withColumn("run", F.floor(F.col("run") / fanout).cast("int"))
        runs = runs.groupBy("run", *IDENTITY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return runs.drop("run")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Mark the row that stays for each distinct normalised text.

    Texts are equal when identical after deleting space, tab, line feed, vertical tab, form
    feed and carriage return. The row with the most code points in the original text stays,
    then the smallest doc_id. Null and blank-only texts all equal the empty text. Rows
    repeated with their id: exactly one of them is kept. Extra columns are ignored; an
    empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = numbered(digests(docs), "digests", "row_no")
    n_runs = rows.agg(F.max("run")).first()[0]
    first = rows.groupBy("run", *IDENTITY).agg(F.min(better_first()).alias("best"), F.count("*").alias("group_size"))
    merged = merge_runs(first, 1 if n_runs is None else n_runs + 1)
    # Only texts that occur more than once need looking up. Written, so that both sides of the
    # join have an exchange of their own and Spark can split the rows of a hot text.
    copies = materialize(
        merged.where("group_size > 1").select(
            *IDENTITY, F.col("best.doc_id").alias("best_id"), F.col("best.row_no").alias("best_row"), "group_size"
        ),
        "copies",
    )
    single = F.col("best_row").isNull()
    return rows.join(copies, list(IDENTITY), "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("best_row") == F.col("row_no"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The stay-list is joined by id. Where an id repeats in ``docs``, the text must be the
    winning one too, and of rows that agree in both, one of the longest is returned.
    """
    marked = exact_dedup(docs)
    stay = marked.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_text")).distinct()
    mark = F.sha2(without_blanks(whole_text()), 256)
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay_id"]) & (mark == stay["stay_text"]), "left_semi")
    if not marked.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        return kept
    once = Window.partitionBy("doc_id", mark).orderBy(F.length(whole_text()).desc(), whole_text())
    return kept.withColumn("__place_in_id", F.row_number().over(once)).where("__place_in_id = 1").drop("__place_in_id")
