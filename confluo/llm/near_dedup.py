"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document's set has a signature of minwise tokens. A tree branches all sets by one of these
tokens after the other: sets that chose the same path share a node. Nodes of at most ``SMALL``
sets are compared exhaustively; larger ones branch on. Independent trees are walked, 12 at the
threshold 0.85 (``trees``); a pair at the threshold follows the same path of d steps in one tree with probability 0.85^d,
so 12 trees miss it with probability below 1e-6 at depth 2 and about 1e-4 at depth 4.

Equal sets are one set from the start. Large nodes whose sets are similar to each other would
never become small: there every set is compared with the node's pivot, and a node is settled once
its sets are in one component. Where a few sets stay outside, these are compared with the whole
node; where many do, the node branches on along several paths each time (``ways``, 5 at 0.85), drawn for each node by a hash
of its path, so that what one node separates another of the same pair keeps. A pair at the
threshold whose nodes all stay large through all 8 phases is missed with probability about 0.002
(simulated). So a group of copies costs its size, not its square, and nothing
is capped.

Signatures only choose what to compare; links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from confluo.llm.common import arrow_batches, whole_text
from confluo.llm.components import components
from confluo.session import materialize

WORDS = 5
PERCENT = 85
COORDINATES = 64  # minwise tokens that paths are chosen from
SKETCH = 192  # minwise tokens compared, a byte of each
DEPTH = 4
SMALL = 16
#: Sets outside a large node's main component that are still compared with the whole node.
FEW = 512
PHASES = 8
MIDDLE = 16  # coordinates that a large node's middle is made of
CHUNK = 64  # sets of a node in one row, when outsiders are compared with it
KEPT_BYTES = 8 << 20  # sets that a task keeps while it confirms pairs
_CHUNK = 1 << 20


def look_at(percent: int) -> float:
    """Share of equal sketch bytes below which a pair isn't compared: 4.5 standard deviations
    under the share that a pair at the threshold has."""
    share = percent / 100 + (1 - percent / 100) / 256
    return share - 4.5 * (share * (1 - share) / SKETCH) ** 0.5


def trees(percent: int) -> int:
    """Trees of which a pair at the threshold shares no node of ``DEPTH`` with probability 1e-4 or so."""
    together = min(0.9999, (percent / 100) ** DEPTH)
    return max(1, math.ceil(math.log(1.5e-4) / math.log(1 - together)))


def ways(percent: int) -> int:
    """Paths that a large node branches on along: a pair at the threshold stays together in 2.5 of them on average."""
    return math.ceil(2.5 / (percent / 100) ** DEPTH)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for one chunk and one word beyond."""
    n = 2 * _CHUNK
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.view(np.int8), [1]])))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(raw) > 2 * _CHUNK:  # one word longer than a chunk
        return np.array([int.from_bytes(hashlib.blake2b(raw[s:e].tobytes(), digest_size=8).digest(), "little") for s, e in zip(starts, ends, strict=True)], np.uint64)
    up, down = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without a word.

    A-Z are lower-cased; words end at space and tab to carriage return. With fewer than ``words``
    words the whole sequence is the one shingle.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        while end < len(raw) and not (raw[end] == 32 or 9 <= raw[end] <= 13):
            # Cut at a blank; a word that crosses the chunk's end goes on.
            ahead = raw[end : end + 4096]
            stop = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            end += int(stop[0]) if len(stop) else len(ahead)
            if len(stop):
                break
        parts.append(_word_hashes(raw[at:end]))
        at = end
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(w):
        return w
    k = min(words, len(w))
    total = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        total = _mix(total * np.uint64(0xA24BAED4963EE407) + w[i : len(w) - k + 1 + i])
    return np.unique(total)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate: the smallest of its hashes over the set, 32 bits."""
    mult, add = _functions()
    best = np.full(SKETCH, np.uint64(0xFFFFFFFF))
    for at in range(0, len(found), 1024):
        part = (found[None, at : at + 1024] * mult[:, None] + add[:, None]) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=1))
    return best.astype(np.uint32)


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, digest, signature, sketch) per row; the digest is of the whole sorted set."""
    kind = pa.list_(pa.int32())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, digest, sig, sketch = [], [], [], []
            for text in part.column(1):
                found = shingles(text.as_py(), words)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                tokens = signature(found) if len(found) else np.zeros(0, np.uint32)
                sig.append(tokens[:COORDINATES].view(np.int32))
                sketch.append(tokens.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()),
                    "signature": pa.array(sig, kind), "sketch": pa.array(sketch, pa.binary()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, signature array<int>, sketch binary")


@F.pandas_udf(DoubleType())
def _share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal sketch bytes."""
    one, two = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), SKETCH) for x in (a, b))
    return pd.Series((one == two).mean(axis=1))


#: Called so, a test of the share doesn't compute it once more, in a worker of its own.
_alike = _share.asNondeterministic()


def _near_pairs(ids: np.ndarray, sketches: np.ndarray, others: np.ndarray, theirs: np.ndarray, least: float) -> list[dict]:
    """Pairs of two lists of sets that look alike enough, smaller id first."""
    share = np.stack([(s == theirs).mean(axis=1) for s in sketches]) if len(ids) and len(others) else np.zeros((len(ids), len(others)))
    i, j = np.nonzero((share >= least) & (ids[:, None] != others[None, :]))
    return [{"a": int(min(ids[x], others[y])), "b": int(max(ids[x], others[y])), "alike": float(share[x, y])} for x, y in zip(i, j, strict=True)]


def _unpack(held: list) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([x["rep"] for x in held], np.int64)
    return ids, np.frombuffer(b"".join(x["sketch"] for x in held), np.uint8).reshape(len(ids), SKETCH)


_PAIRS = "array<struct<a:long,b:long,alike:double>>"


def _branch(rows: DataFrame, reps: DataFrame, phase: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Walk ``DEPTH`` levels down from ``rows`` (path, rep): (small, large) nodes as (node, rep).

    At each level nodes of one set end, those of at most ``SMALL`` are small, the others branch
    by the next chosen coordinate. In the first phase the paths are the trees' roots; later each
    node has coordinates of its own, different ones for all its ways and levels.
    """
    n_ways = ways(percent) if phase else trees(percent)
    rows = rows.join(reps.select("rep", "signature"), "rep") if phase else reps.select("rep", "signature", F.lit(0).cast("long").alias("path"))
    rows = rows.withColumn("way", F.explode(F.array(*[F.lit(w) for w in range(n_ways)])))
    if phase == 0:
        rng = np.random.default_rng(100)
        chosen = np.array([rng.permutation(COORDINATES) for _ in range(-(-n_ways * DEPTH // COORDINATES))]).reshape(-1)[: n_ways * DEPTH].reshape(n_ways, DEPTH)
        coordinates = F.array(*[F.array(*[F.lit(int(c)) for c in way]) for way in chosen])
        coordinate = lambda d: F.get(F.get(coordinates, F.col("way")), F.lit(d))
    else:
        # A start and an odd step modulo the power of two: no coordinate comes twice in a node.
        rows = rows.withColumn("draw", F.xxhash64("path", F.lit(100 + phase)))
        start, step = F.pmod("draw", F.lit(COORDINATES)), F.pmod(F.shiftright("draw", 32), F.lit(COORDINATES // 2)) * 2 + 1
        coordinate = lambda d: F.pmod(start + step * (F.col("way") * DEPTH + d), F.lit(COORDINATES)).cast("int")
    token = lambda d: F.get("signature", coordinate(d))
    keys = [F.xxhash64("path", "way", F.lit(phase), *[token(i) for i in range(d + 1)]).alias(f"k{d}") for d in range(DEPTH)]
    open_rows = rows.select("rep", *keys)
    small, large = [], None
    for d in range(DEPTH):
        sizes = open_rows.groupBy(f"k{d}").agg(F.count("*").alias("size")).where("size > 1")
        held = materialize(open_rows.join(materialize(sizes, "node-sizes"), f"k{d}"), "nodes")
        small.append(held.where(f"size <= {SMALL}").select(F.col(f"k{d}").alias("node"), "rep"))
        open_rows = held.where(f"size > {SMALL}").drop("size", *([f"k{d}"] if d < DEPTH - 1 else []))
        if d == DEPTH - 1:
            large = open_rows.select(F.col(f"k{d}").alias("node"), "rep")
    out = small[0]
    for s in small[1:]:
        out = out.union(s)
    return out.distinct(), large.distinct()


def _within(small: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b, alike) of a small node's sets that look alike enough."""
    held = small.join(reps.select("rep", "sketch"), "rep").groupBy("node").agg(F.collect_list(F.struct("rep", "sketch")).alias("held"))  # at most SMALL each
    least = look_at(percent)

    @F.pandas_udf(_PAIRS)
    def compare(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([_near_pairs(*_unpack(node), *_unpack(node), least) for node in part], dtype=object)

    pairs = held.select(F.explode(compare("held")).alias("p")).select("p.a", "p.b", "p.alike")
    return pairs.groupBy("a", "b").agg(F.max("alike").alias("alike"))


def _looked_at(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with their share of equal tokens, those that look alike enough, a < b."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    one = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("s_a"))
    two = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("s_b"))
    return ordered.join(one, "a").join(two, "b").withColumn("alike", _alike("s_a", "s_b")).where(F.col("alike") >= look_at(percent)).select("a", "b", "alike")


def _to_pivot(large: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of each large node's pivot and its other sets.

    The pivot is the set nearest to the node's middle: the one that agrees most with the most
    frequent token of each coordinate. In a group of edited copies that is the text they were
    made from, which is nearer to all of them than they are to each other.
    """
    near = reps.select("rep", F.slice("signature", 1, MIDDLE).alias("tokens"))
    rows = materialize(large.join(near, "rep"), "large-tokens")
    # The sketch of frequent tokens is of fixed size, however many sets and tokens a node has.
    middle = rows.groupBy("node").agg(F.array(*[F.expr(f"approx_top_k(tokens[{i}], 1, 64)[0].item") for i in range(MIDDLE)]).alias("middle"))
    middle = materialize(middle, "middles")
    agree = F.size(F.filter(F.zip_with("tokens", "middle", lambda x, y: x == y), lambda e: e))
    pivot = rows.join(middle, "node").groupBy("node").agg(F.max(F.struct(agree.alias("agree"), (-F.col("rep")).alias("back"))).alias("p"))
    pivot = materialize(pivot.select("node", (-F.col("p.back")).alias("a")), "pivots")
    return large.join(pivot, "node").select("a", F.col("rep").alias("b"))


def _kept_sets(words: int) -> Callable[[str], np.ndarray]:
    """Shingle sets of texts, keeping the latest up to ``KEPT_BYTES``."""
    kept: dict[str, np.ndarray] = {}
    size = 0

    def of(text: str) -> np.ndarray:
        nonlocal size
        found = kept.get(text)
        if found is None:
            found = shingles(text, words)
            size += found.nbytes + 4 * len(text)
            if size > KEPT_BYTES:
                kept.clear()
                size = found.nbytes + 4 * len(text)
            kept[text] = found
        return found

    return of


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(one) + len(two) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = _kept_sets(words)
        for left, right in parts:
            yield pd.Series([_similar(of(a), of(b), percent) for a, b in zip(left, right, strict=True)], dtype=bool)

    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("t_a"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("t_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").where(similar("t_a", "t_b")).select("a", "b").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that aren't in one component yet."""
    side = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def _links(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different sets, enough to join every component."""
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, component long")
    texts: DataFrame | None = None
    open_nodes: DataFrame | None = None

    seen = spark.createDataFrame([], "a long, b long")

    def confirm(pairs: DataFrame) -> None:
        """Add the links among ``pairs`` that join components: first each set with the one it looks
        most like, then what is still apart. No pair is confirmed twice."""
        nonlocal links, labels, texts, seen
        pairs = materialize(_apart(pairs.join(seen, ["a", "b"], "left_anti"), labels), "new-pairs")
        if not pairs.limit(1).count():
            return
        texts = _texts(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), docs, texts)
        best = pairs.groupBy("b").agg(F.max(F.struct("alike", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
        for some in (best, pairs.select("a", "b")):
            with arrow_batches(spark, 400):
                fresh = materialize(_confirmed(_apart(some, labels), texts, words, percent), "links")
            if fresh.limit(1).count():
                links = links.unionByName(fresh)
                labels = components(links)
        seen = seen.unionByName(pairs.select("a", "b"))

    for phase in range(PHASES + 1):
        small, large = _branch(open_nodes, reps, phase, percent)
        large = materialize(large, "large-nodes")
        pairs = _within(small, reps, percent).unionByName(_looked_at(_to_pivot(large, reps), reps, percent))
        with arrow_batches(spark, 2000):
            pairs = materialize(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")), "pairs")
        confirm(pairs)
        # Large nodes in one component are settled; so are those whose few outsiders are compared.
        mixed = _mixed(large, labels)
        if not mixed.limit(1).count():
            break

        def texts_of(ids: DataFrame) -> DataFrame:
            nonlocal texts
            texts = _texts(ids, docs, texts)
            return texts

        fresh, rest = _outsiders(mixed, reps, labels, texts_of, words, percent, last=phase == PHASES)
        if fresh.limit(1).count():
            links = links.unionByName(fresh)
            labels = components(links)
        open_nodes = _mixed(rest, labels).withColumnRenamed("node", "path")
        if not open_nodes.limit(1).count():
            break
    return links


def _mixed(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of nodes whose sets are in several components."""
    placed = large.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = placed.groupBy("node").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("node")
    return materialize(large.join(materialize(mixed, "mixed"), "node", "left_semi").select("node", "rep"), "open-nodes")


def _texts(ids: DataFrame, docs: DataFrame, known: DataFrame | None) -> DataFrame:
    """(rep, text) of the sets in ``ids`` and those ``known``; new ones are read and written once."""
    ids = ids.distinct()
    if known is not None:
        ids = ids.join(known.select("rep"), "rep", "left_anti")
    ids = materialize(ids, "ids")
    source = docs.select(F.col("doc_id").cast("long").alias("rep"), whole_text().alias("text"))
    if known is not None and not ids.limit(1).count():
        return known
    found = materialize(source.join(ids, "rep", "left_semi"), "texts")
    return found if known is None else known.unionByName(found)


def _outsiders(
    large: DataFrame, reps: DataFrame, labels: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, percent: int, *, last: bool
) -> tuple[DataFrame, DataFrame]:
    """(links, rest): confirmed links of sets outside a node's main component to the node's other
    sets, where they are few (or this is the last phase); and the nodes that have to branch on.

    Outsiders and sets meet as chunks of a node, ``CHUNK`` sets a row, and are confirmed there:
    what is made are links, one for each outsider, chunk and component at most, not pairs.
    """
    placed = large.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    placed = materialize(placed.select("node", "rep", "c"), "placed")
    per = placed.groupBy("node", "c").agg(F.count("*").alias("n"))
    main = per.groupBy("node").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("size"))
    main = materialize(main.select("node", F.col("m.c").alias("main"), "size", (F.col("size") - F.col("m.n")).alias("outside")), "main")
    now = main if last else main.where(F.col("outside") <= FEW)
    rows = placed.join(now, "node")
    rows = rows.join(reps.select("rep", "sketch"), "rep").join(texts_of(rows.select("rep")).groupBy("rep").agg(F.max("text").alias("text")), "rep")

    def chunks(some: DataFrame, total: str, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("rep"), F.ceil(F.col(total) / CHUNK))
        held = F.collect_list(F.struct("rep", "c", "sketch", "text")).alias(name)
        return materialize(some.groupBy("node", part.alias("part")).agg(held).drop("part"), name)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _kept_sets(words)
        least = look_at(percent)
        for part in parts:
            a, b = [], []
            for few, all_ in zip(part.column("few"), part.column("all"), strict=True):
                few, all_ = few.as_py(), all_.as_py()
                theirs = np.frombuffer(b"".join(x["sketch"] for x in all_), np.uint8).reshape(len(all_), SKETCH)
                for x in few:
                    share = (np.frombuffer(x["sketch"], np.uint8) == theirs).mean(axis=1)
                    met = {x["c"]}
                    for j in np.argsort(-share, kind="stable"):
                        if share[j] < least:
                            break
                        y = all_[j]
                        if y["c"] not in met and _similar(of(x["text"]), of(y["text"]), percent):
                            met.add(y["c"])
                            a.append(min(x["rep"], y["rep"]))
                            b.append(max(x["rep"], y["rep"]))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = chunks(rows.where("c != main"), "outside", "few").join(chunks(rows, "size", "all"), "node").select("few", "all")
    with arrow_batches(large.sparkSession, 4):
        links = materialize(met.mapInArrow(compare, "a long, b long").distinct(), "links")
    return links, large.join(now.select("node"), "node", "left_anti")


def near_dedup(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Component of every document under 100 · intersection ≥ ``percent`` · union of shingle sets.

    Null texts are empty; texts without a word have an empty set and are linked with nothing.
    Equal sets are linked. Rows of one id are one document with several texts. A row without an
    id is linked with nothing, its component is null and it is kept. Extra columns are ignored.

    Returns doc_id, n_shingles, component_id, kept.
    """
    with arrow_batches(docs.sparkSession, 1000):
        rows = materialize(sets(docs, words), "sets")
    known = rows.where("n > 0 and doc_id is not null")
    # One set each, whoever has it; its document is the one with the smallest id.
    groups = known.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    reps = materialize(groups, "reps")
    links = _links(reps, docs, words, percent)
    copies = known.join(reps.where("rep != other").select("digest", "n", "rep"), ["digest", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a != b")
    repeated = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").limit(1).count()
    if repeated:  # an id with several texts ties their classes together: all copies become links
        links = links.unionByName(copies)
    labels = components(links)
    if repeated:
        found = rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("rep", F.lit(None).cast("long"))
    else:
        classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").where("component is not null or rep != other")
        classes = materialize(classes.select("digest", "n", F.coalesce("component", "rep").alias("component")), "classes")
        found = rows.join(classes, ["digest", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    if repeated:
        component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    gone = near_dedup(docs, words=words, percent=percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
