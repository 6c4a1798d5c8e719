"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A turn is a 16-byte digest of role and text, a conversation the string of its turns' digests.
Distinct strings are range-partitioned, so a first turn that a third of all conversations
share is spread over many shards. Each shard writes its part of the trie as a sequence of
balanced parentheses in string order. The excess (opens less closes) has minima per block and a
tree over them: ``find_close`` climbs and descends it to the parenthesis that ends a subtree. A
subtree is then an interval, and its totals are differences of cumulative arrays: members,
leaves (pairs "()"), saved bytes, children.

Nodes on the path that two neighbouring shards share (the spine) appear in both. Every total is
kept additive over shards: a node's bytes and its place among the children count in the shard
that opens it first, a leaf is one that the *next* string doesn't prolong, and what is summed
over members is summed where the members are. So spines merge in one grouped aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import arrow_batches
from confluo.session import materialize, own_exchange

WIDTH = 16  # bytes of a turn's digest
HEADS = 9  # a rebuilt conversation takes 0 to 8 turns from the first of its family
FAMILY = 5

#: Conversation ids that one row of an id list holds, about.
ID_BLOCK = 1024
#: Nodes of one sequence of parentheses, about: a shard is a series of such pieces.
PIECE_NODES = 100_000
BLOCK = 64  # parentheses per block of the excess
BATCH_ROWS = 500

NO_IDS = hashlib.sha256(b"").hexdigest()


# --- conversations as strings of digests ----------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, size)) in order of turn; only digests are shuffled."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = F.struct(
        F.col("turn").isNotNull().alias("known"), F.col("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size")
    )
    turns = F.transform(F.sort_array(F.collect_list("one")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return conversations.where("conv_id is not null").select("conv_id", one.alias("one")).groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first h turns taken from the first conversation of the family.

    h is crc32 of the decimal id modulo 9; the family's first id is conv_id - conv_id % 5.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = turns.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    own = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    tail = F.slice("turns", h + 1, F.size("turns"))
    return own.join(heads, "family", "left").select("conv_id", F.concat(head, tail).alias("turns"))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes, key): digests one after another, bytes per turn, digest of the path."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    sizes = F.transform("turns", lambda t: t["size"])
    return turns.select("conv_id", path.alias("path"), sizes.alias("sizes")).withColumn("key", F.unhex(F.sha2("path", 256)))


def id_lists(found: DataFrame) -> DataFrame:
    """(key, n, low, ids_sha256): the ids of each path, ascending, comma-joined and hashed.

    Ids meet in blocks first, so a path that a third of all conversations have is sorted by many
    tasks; one task then only streams its blocks through the hash, which takes them in order.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    blocks = found.groupBy("key", F.expr(f"conv_id div {ID_BLOCK}").alias("block")).agg(
        F.array_join(ids, ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("low")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, low, state = None, 0, None, None
        done: list[tuple] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "ids", "n", "low"))
            for k, ids, m, first in zip(*columns, strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, n, low, state.hexdigest()))
                    key, n, low, state = k, 0, first, hashlib.sha256()
                elif n:
                    state.update(b",")
                state.update(ids.encode())
                n += m
            yield _lists(done)
            done = []
        if key is not None:
            yield _lists([(key, n, low, state.hexdigest())])

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(hashed, "key binary, n long, low long, ids_sha256 string")


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "low", "ids_sha256"])


def shards(found: DataFrame) -> DataFrame:
    """(shard, path, sizes, n, low, ids_sha256): one row per distinct path, shards in path order.

    Each shard also has the last path of the shard before and the first of the shard after it
    (with null ``n``); they sort to its ends.
    """
    once = found.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    ordered = once.join(id_lists(found), "key").drop("key").repartitionByRange("path").withColumn("shard", F.spark_partition_id())
    ordered = materialize(ordered, "trie-paths")
    ends = ordered.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")  # a row per shard
    near = ends.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    sentinels = near.select("shard", F.explode(F.array("before", "after")).alias("path")).where("path is not null")
    return ordered.unionByName(sentinels, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "path")


# --- balanced parentheses ---------------------------------------------------------------


def find_close(excess: np.ndarray, opens: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The position of the parenthesis that closes each open one: the first lower excess after it."""
    leaves = 1 << max(0, -(-len(excess) // block) - 1).bit_length()
    padded = np.full(leaves * block, np.iinfo(np.int64).max)
    padded[: len(excess)] = excess
    tree = np.empty(2 * leaves, np.int64)
    tree[leaves:] = padded.reshape(leaves, block).min(axis=1)
    level = leaves
    while level > 1:
        tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).min(axis=1)
        level //= 2
    goal = excess[opens]
    close = np.full(len(opens), -1, np.int64)

    def scan(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Look from ``start`` to the end of its block; returns the rows not found there."""
        lost = []
        for step in range(block):
            if not len(rows):
                break
            at = start + step
            inside = at // block == start // block
            lost.append(rows[~inside])
            rows, start, at = rows[inside], start[inside], at[inside]
            hit = padded[at] < goal[rows]
            close[rows[hit]] = at[hit]
            rows, start = rows[~hit], start[~hit]
        return np.concatenate([*lost, rows]) if lost else rows

    rows = np.arange(len(opens))
    last = opens % block == block - 1  # nothing after it in its block
    rows = np.concatenate([rows[last], scan(rows[~last], opens[~last] + 1)])
    node, climbing = leaves + opens[rows] // block, np.ones(len(rows), bool)
    while climbing.any():
        right = climbing & (node % 2 == 0) & (tree[np.minimum(node + 1, 2 * leaves - 1)] < goal[rows])
        node[right] += 1
        climbing &= ~right
        node[climbing] //= 2
    while (high := node < leaves).any():
        left = 2 * node[high]
        node[high] = left + (tree[left] >= goal[rows[high]])
    scan(rows, (node - leaves) * block)
    return close


def interval_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """min(values[a:b]) for each a < b, from minima over powers of two."""
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        rows = level == k
        out[rows] = np.minimum(table[start[rows]], table[stop[rows] - (1 << k)])
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def spine_keys(path: bytes, depth: int) -> list[bytes]:
    """Keys of the nodes at depth 0 to ``depth`` of a path."""
    state, keys = hashlib.sha256(), []
    for d in range(depth + 1):
        keys.append(state.digest())
        state.update(path[d * WIDTH : (d + 1) * WIDTH])
    return keys


@dataclass
class Piece:
    """Consecutive distinct paths of a shard; ``shared`` turns of the first are open before it (-1: nothing is)."""

    shared: int = -1
    paths: list[bytes] = field(default_factory=list)
    common: list[int] = field(default_factory=list)  # turns shared with the path before
    sizes: list[np.ndarray] = field(default_factory=list)
    ends: list[tuple] = field(default_factory=list)  # (n, low, ids_sha256)
    nodes: int = 0

    def add(self, path: bytes, common: int, sizes: np.ndarray, end: tuple) -> None:
        if not self.paths:
            common = -1
        self.paths.append(path)
        self.common.append(common)
        self.sizes.append(sizes[max(0, common) :])
        self.ends.append(end)
        self.nodes += len(path) // WIDTH - common

    def rows(self, after: bytes | None) -> pa.RecordBatch:
        """One row per node; ``after`` is the path that follows this piece, if any."""
        depth_of = np.array([len(p) // WIDTH for p in self.paths])
        common = np.array(self.common)
        new = depth_of - common
        n_nodes = int(new.sum())
        starts = np.cumsum(new) - new
        depth = np.arange(n_nodes) - np.repeat(starts, new) + np.repeat(common, new) + 1
        size = np.concatenate([[0], *self.sizes]).astype(np.int64)
        at_end = starts + new - 1

        closes = np.append(depth_of[:-1] - common[1:], depth_of[-1] + 1)
        runs = np.stack([new, closes], axis=1).ravel()
        bits = np.repeat(np.tile([1, -1], len(new)), runs)
        opens = np.flatnonzero(bits == 1)
        close = find_close(np.cumsum(bits), opens)
        node = np.arange(n_nodes)
        stop = node + (close - opens + 1) // 2  # the subtree is node .. stop in preorder

        prolonged = -1 if after is None else common_turns(self.paths[-1], after)
        leaf = bits[opens + 1] == -1
        leaf[-1] &= prolonged != depth_of[-1]
        owned = np.ones(n_nodes, bool)
        owned[: self.shared + 1] = False

        ends, low = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.iinfo(np.int64).max)
        ends[at_end], low[at_end] = [e[0] for e in self.ends], [e[1] for e in self.ends]
        hashes = np.full(n_nodes, None, object)
        hashes[at_end] = [e[2] for e in self.ends]

        def within(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[stop] - total[node]

        members = within(ends)
        low = interval_minima(low, node, stop)
        saved = within(members * size - np.where(owned, size, 0))

        by_depth = np.argsort(depth, kind="stable")
        place = depth[by_depth] * n_nodes + by_depth
        parent = by_depth[np.searchsorted(place, (depth - 1) * n_nodes + node) - 1]
        parent[0] = 0
        children = np.bincount(parent[1:][owned[1:]], minlength=n_nodes)

        # The spine: what the path before, or the one after, also has.
        key = np.full(n_nodes, None, object)
        if self.shared >= 0:
            key[: self.shared + 1] = spine_keys(self.paths[0], self.shared)
        if prolonged >= 0:
            at, keys = int(at_end[-1]), spine_keys(self.paths[-1], prolonged)
            while depth[at] > prolonged:
                at = int(parent[at])
            for d in range(prolonged, -1, -1):
                key[at] = keys[d]
                at = int(parent[at])
        parent_key, top = key[parent], np.array([k is None for k in key[parent]])
        parent_key[0] = None
        parent_low = [None if i == 0 or not plain else v for i, (v, plain) in enumerate(zip(low[parent].tolist(), top.tolist(), strict=True))]
        columns = {
            "key": pa.array(key, pa.binary()),
            "parent_key": pa.array(parent_key, pa.binary()),
            "parent_conv_id": pa.array(parent_low, pa.int64()),
            "conv_id": pa.array(low, pa.int64()),
            "depth": pa.array(depth, pa.int64()),
            "n_convs": pa.array(members, pa.int64()),
            "n_children": pa.array(children, pa.int64()),
            "n_leaves": pa.array(within(leaf), pa.int64()),
            "saved_tokens": pa.array(saved, pa.int64()),
            "ends_sha256": pa.array(hashes, pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)


NODE_ROWS = (
    "key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def pieces(rows: Iterator[tuple], most: int = PIECE_NODES) -> Iterator[pa.RecordBatch]:
    """Node rows from (shard, path, sizes, n, low, ids_sha256), sorted by shard and path."""
    piece, shard, last = Piece(), None, None
    for here, path, sizes, *end in rows:
        if here != shard:
            if piece.paths:
                yield piece.rows(None)
            piece, shard, last = Piece(), here, None
        common = -1 if last is None else common_turns(last, path)
        if end[0] is None:  # the path of a neighbouring shard
            if piece.paths:
                yield piece.rows(path)
                piece = Piece()
            last = path
            continue
        if piece.nodes >= most:
            yield piece.rows(path)
            piece = Piece()
        if not piece.paths:
            piece.shared = common
        piece.add(path, common, np.asarray(sizes, np.int64), tuple(end))
        last = path
    if piece.paths:
        yield piece.rows(None)


def node_rows(sharded: DataFrame, most: int = PIECE_NODES) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "n", "low", "ids_sha256")), strict=True)

        return pieces(rows(), most)

    return sharded.mapInArrow(build, NODE_ROWS)


def merged(nodes: DataFrame) -> DataFrame:
    """One row per node: spines of all shards added up, parents on a spine looked up."""
    totals = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    spine = nodes.where("key is not null").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        F.max("ends_sha256").alias("ends_sha256"), *[F.sum(c).alias(c) for c in totals],
    )
    spine = materialize(spine, "trie-spines")
    columns = ("conv_id", "depth", *totals, "ends_sha256")
    inner = nodes.where("key is null and parent_key is null").select("parent_conv_id", *columns)
    below = nodes.where("key is null and parent_key is not null").select("parent_key", *columns)
    lows = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    below = below.unionByName(spine.select("parent_key", *columns)).join(own_exchange(lows), "parent_key", "left")
    return inner.unionByName(below.select("parent_conv_id", *columns)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))


def prefix_trie(conversations: DataFrame, *, most: int = PIECE_NODES) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation and are left out; null roles and texts are
    empty; null turns come first. Turns of equal number, repeated rows too, are ordered by the
    digest of role and text, and each counts. Extra columns are ignored. An empty table has no
    conversation and gives no row. Texts are hashed where they are read; a conversation is one
    row of 24 bytes a turn from then on.
    """
    spark = conversations.sparkSession
    turns = materialize(conversation_turns(conversations), "trie-turns")
    with arrow_batches(spark, BATCH_ROWS):
        found = materialize(paths(rebuilt(turns)), "trie-conversations")
        nodes = materialize(node_rows(shards(found), most), "trie-nodes")
    return merged(nodes).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same as DuckDB SQL; crc32 is computed bit by bit.
SQL = """
WITH t AS (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
           octet_length(encode(coalesce(text, ''))) AS b
    FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
    SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(b ORDER BY turn NULLS FIRST, k) AS bs,
           xor(list_reduce(
               [4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
               lambda crc, byte: list_reduce([xor(crc, byte)] || [CAST(i AS BIGINT) FOR i IN range(8)],
                   lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
           ), 4294967295) % 9 AS h
    FROM t GROUP BY conv_id
),
r AS (
    SELECT c.conv_id,
           coalesce(f.ks, [])[1 : c.h] || c.ks[c.h + 1 :] AS ks,
           coalesce(f.bs, [])[1 : c.h] || c.bs[c.h + 1 :] AS bs
    FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % 5
),
m AS (
    SELECT conv_id, d, array_to_string(ks[1 : d], '') AS p, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, d = len(ks) AS ends
    FROM r, LATERAL (SELECT unnest(range(0, len(ks) + 1)) AS d)
),
n AS (
    SELECT p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS own,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM m GROUP BY p
),
kids AS (SELECT left(p, 64 * (d - 1)) AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
sub AS (
    SELECT left(n.p, 64 * a) AS p, sum(own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
    FROM n LEFT JOIN kids USING (p), LATERAL (SELECT unnest(range(0, n.d + 1)) AS a)
    GROUP BY left(n.p, 64 * a)
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
       sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sub USING (p) LEFT JOIN kids USING (p)
LEFT JOIN n up ON n.d > 0 AND up.p = left(n.p, 64 * (n.d - 1))
"""
