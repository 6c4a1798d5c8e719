"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

Points are rows; dimensions are metadata of their text: its size, its words, its line breaks, its
bytes per code point (which follows the language). A node that is to become several shards is cut where its bytes divide in proportion
(a weighted median for two), along the dimension with the widest spread of its bytes, until each
leaf is one shard of the target bytes. All nodes of a level are cut in the same pass.

A cut is found from histograms of 64-bit sort keys: the dimension's coarse value, the text's
hash, the row's id. Bytes per (node, bin) are summed before the shuffle; bins narrow until the
bin that holds the cut is light. Equal texts have equal keys but for the id, so they stay together
unless a cut falls within them: a text that a third of all rows share is cut like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import whole_text
from confluo.session import materialize

SHARDS = 24
OVERHEAD = 8  # bytes per row besides its text
DIMENSIONS = ("by_size", "by_words", "by_lines", "by_script")
#: Sort key: 16 bits of the dimension, 24 of the text, 24 of the row; a histogram takes 12 bits.
KEY_BITS, STEP_BITS = 63, 12
#: A cut may be off by this share of a shard's bytes, if one row allows it.
TOLERANCE = 1e-3
SLOTS_PER_TASK = 200_000


def points(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, row_no, one key per dimension) per row, written once."""
    text = whole_text()
    size = F.octet_length(text).cast("long") + overhead
    without = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.length(text).alias("chars"), without(" ").alias("spaces"), without("\n").alias("breaks"), F.octet_length(text).alias("octets"),
    )
    rows = rows.withColumn("row_no", F.monotonically_increasing_id())
    tail = F.shiftleft(F.shiftrightunsigned("text_hash", 40), 23) + F.shiftrightunsigned(F.xxhash64("doc_id", "row_no"), 41)
    scaled = lambda x, unit: F.least(F.floor(x * unit), F.lit(65535)).cast("long")
    coarse = {
        "by_size": scaled(F.log2("size"), 2048), "by_words": scaled(F.log2(F.col("spaces") + 1), 2048),
        "by_lines": scaled(F.log2(F.col("breaks") + 1), 2048),
        "by_script": scaled(F.when(F.col("chars") > 0, F.col("octets") / F.col("chars") - 1).otherwise(0.0), 16384),
    }
    keys = [(F.shiftleft(coarse[d], 47) + tail).alias(d) for d in DIMENSIONS]
    return materialize(rows.select("doc_id", "size", "text_crc32", "row_no", *keys), "points")


@dataclass
class Node:
    """A set of points that is to become ``leaves`` shards from number ``first`` on."""

    first: int
    leaves: int
    weight: float
    dimension: str = ""
    low: int = 0  # the bin that holds the cut begins here
    bits: int = KEY_BITS  # and is this wide
    before: float = 0.0  # weight below it
    goal: float = 0.0
    done: bool = False


def _choose(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def _widest(rows: DataFrame, nodes: list[Node]) -> list[Node]:
    """The nodes that have rows, each with the dimension whose coarse value spreads its bytes widest."""
    moments = []
    for d in DIMENSIONS:
        x = F.shiftrightunsigned(d, 47) / 65536.0
        moments += [F.sum(x * F.col("size")).alias(f"{d}_1"), F.sum(x * x * F.col("size")).alias(f"{d}_2")]
    found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *moments).collect()}  # a row per node
    present = [n for n in nodes if n.first in found]
    for n in present:
        r = found[n.first]
        n.weight = float(r["w"])
        n.dimension = max(DIMENSIONS, key=lambda d: r[f"{d}_2"] / r["w"] - (r[f"{d}_1"] / r["w"]) ** 2)
        n.goal = n.weight * (n.leaves // 2) / n.leaves
    return present


def _cut(rows: DataFrame, nodes: list[Node], error: float) -> None:
    """Narrow each node's bin until the weight in it is below ``error`` or it is one key."""
    while open_nodes := [n for n in nodes if not n.done]:
        tests = [(F.col("node") == n.first, n) for n in open_nodes]
        key = _choose([(t, F.col(n.dimension)) for t, n in tests], F.lit(None).cast("long"))
        low = _choose([(t, F.lit(n.low).cast("long")) for t, n in tests], F.lit(0).cast("long"))
        shift = {n.first: max(0, n.bits - STEP_BITS) for n in open_nodes}
        off = key - low
        bins = _choose([(t, F.shiftrightunsigned(off, shift[n.first])) for t, n in tests], F.lit(None).cast("long"))
        within = _choose([(t, (off >= 0) & (off < F.lit(1 << n.bits))) if n.bits < 63 else (t, off >= 0) for t, n in tests], F.lit(False))
        table = rows.where(within).groupBy("node", bins.alias("bin")).agg(F.sum("size").alias("w")).collect()  # nodes × 2^STEP_BITS at most
        by_node: dict[int, list[tuple[int, float]]] = {}
        for r in table:
            by_node.setdefault(r["node"], []).append((r["bin"], float(r["w"])))
        for n in open_nodes:
            for b, w in sorted(by_node[n.first]):
                if n.before + w > n.goal or b == max(x for x, _ in by_node[n.first]):
                    n.low += b << shift[n.first]
                    n.bits = shift[n.first]
                    break
                n.before += w
            n.done = w <= error or n.bits == 0
            if n.done and n.goal - n.before > n.before + w - n.goal:  # the nearer end of the bin
                n.low += 1 << n.bits


def kd_shards(docs: DataFrame, *, shards: int = SHARDS, overhead: int = OVERHEAD, tolerance: float = TOLERANCE) -> DataFrame:
    """Shard of every row, bytes near equal: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text (null: none) plus ``overhead``. Null sources, languages
    and ids are values like others. Repeated rows are dealt each; with fewer rows than shards some
    shards are empty. ``slot`` counts a shard's rows without gaps from 0. Extra columns are ignored.
    """
    rows = points(docs, overhead)
    total = rows.agg(F.sum("size")).first()[0]
    shard = F.lit(0)
    nodes = [Node(0, shards, float(total or 0))]
    while total and (split := [n for n in nodes if n.leaves > 1]):
        level = rows.withColumn("node", shard)
        inner = level.where(F.col("node").isin([n.first for n in split]))
        split = _widest(inner, split)
        if not split:
            break
        _cut(inner, split, tolerance * total / shards)
        cuts = [((F.col("node") == n.first) & (F.col(n.dimension) >= F.lit(n.low)), n.first + n.leaves // 2) for n in split]
        shard = _choose([(t, F.lit(v)) for t, v in cuts], F.col("node"))
        placed = level.withColumn("place", shard).select("doc_id", "size", "text_crc32", "row_no", *DIMENSIONS, "place")
        rows = materialize(placed, "kd-level")
        shard = F.col("place")
        nodes = [m for n in split for m in (Node(n.first, n.leaves // 2, 0), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2, 0))]
    return _numbered(rows.withColumn("shard", shard.cast("int")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Slots per shard: numbers within parts of a shard, shifted by the parts before."""
    count = rows.count()
    parts = max(1, -(-count // SLOTS_PER_TASK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards × parts rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row_no")) - 1
    return rows.withColumn("inside", inside).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
