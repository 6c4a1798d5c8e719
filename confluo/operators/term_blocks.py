"""Document frequencies of n-grams, by exchanging distinct terms of blocks of documents.

A *block* is a run of documents that one task reads, up to ``BLOCK_WORDS`` words, written as its
distinct words and the places of its words in that list. Its n-grams are put together from the
places wherever they are needed. What a block sends out is each of its distinct terms once, as a
96-bit hash with the number of its documents that have it, packed by ranges of the hash; what
comes back are the frequencies in the same order. So neither texts, terms nor postings are
shuffled, and a term that all documents have is one entry per block.

A group of a shuffle is one range (about ``RANGE_TERMS`` entries, more ranges for more input) or
one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from confluo.session import materialize, spread

BLOCK_WORDS = 1 << 20
RANGE_TERMS = 1 << 21
#: The block of the query text; others count from 0.
QUERY = -1
_ODD = 0x9E3779B97F4A7C17
_KEYS = ("term-blocks/low.", "term-blocks/high")
_ASKED = "part int, block long, h binary, g binary, n binary"
_FOUND = "block long, part int, df binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per string in two columns, and the factor for a string that follows after a space.

    Strings are hashed by their space-separated pieces, so a word with a space in it, which other
    token patterns may give, has the hash of the pair that reads the same.
    """
    if not len(words):
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.uint64)
    sizes, pieces = np.ones(len(words), np.int64), words
    if pc.any(pc.match_substring(words, " ")).as_py():
        split = pc.split_pattern(words, " ")
        sizes, pieces = pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten()
    values = pieces.to_numpy(zero_copy_only=False)
    flat = np.stack([hash_array(values, hash_key=k, categorize=False) for k in _KEYS], axis=1)
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()), _ODD, np.uint64)], dtype=np.uint64)
    turn = powers[np.arange(len(flat)) - np.repeat(starts, sizes)]
    return np.add.reduceat(flat * turn[:, None], starts), powers[sizes]


def _in_order(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, and which entries of that order begin a run of equal ones."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], g[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] < b[:-1])):
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
    starts = np.ones(len(h), bool)
    starts[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, starts


class Terms:
    """The n-grams of a block: distinct ``terms`` in order of their words, ``h`` and ``g`` of each
    distinct hash in order, and one posting per document and term (``row``, ``term``, ``tf``)."""

    def __init__(self, words: pa.Array, places: np.ndarray, lengths: np.ndarray):
        self.words = words = words.cast(pa.string())
        self.by_name = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[self.by_name] = np.arange(len(words))
        word, row = rank[places], np.repeat(np.arange(len(lengths)), lengths)
        pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
        width = len(words) + 1
        grams = np.r_[word * width, word[pair] * width + word[pair + 1] + 1]
        known, gram = np.unique(grams, return_inverse=True)
        self.first, self.second = known // width, known % width - 1  # −1: a word by itself
        mixed, factor = _hashes(words.take(pa.array(self.by_name)))
        if len(known):
            tail = np.where((self.second < 0)[:, None], np.uint64(0), mixed[self.second] * factor[self.first][:, None])
            mixed = mixed[self.first] + tail
        h, g = np.ascontiguousarray(mixed[:, 0]), (mixed[:, 1] >> np.uint64(32)).astype("<u4")
        order, starts = _in_order(h, g)
        self.h, self.g = h[order][starts], g[order][starts]
        #: Of each term, its number among the distinct hashes. Terms that read the same count as the first.
        self.number = np.empty(len(known), np.int64)
        self.number[order] = np.cumsum(starts) - 1
        same = order[starts][self.number] if len(known) else order
        posted, self.tf = np.unique(np.r_[row, row[pair]] * max(len(known), 1) + same[gram], return_counts=True)
        self.row, self.term = np.divmod(posted, max(len(known), 1))

    def names(self) -> pa.Array:
        words = self.words.take(pa.array(self.by_name))
        first, pairs = words.take(pa.array(self.first)), pa.array(self.second >= 0)
        second = words.take(pa.array(np.maximum(self.second, 0)))
        return pc.if_else(pairs, pc.binary_join_element_wise(first, second, " "), first)

    def documents(self) -> np.ndarray:
        """Documents of the block that have each distinct hash."""
        return np.bincount(self.number[self.term], minlength=len(self.h)).astype("<u8")


def _block(keys: list[pa.Array], lists: list[pa.Array], number: int, kind: pa.Schema) -> pa.RecordBatch:
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    codes = coded.indices.to_numpy()
    common = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    place = np.empty(len(common), "<u4")
    place[common] = np.arange(len(common))
    lengths = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]).astype("<u4")
    words, places = coded.dictionary.take(pa.array(common)), place[codes]
    held = pa.concat_arrays(keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(held)], held).cast(kind.field("keys").type),
            pa.ListArray.from_arrays([0, len(words)], words).cast(kind.field("words").type),
            pa.array([_packed(lengths)], pa.binary()), pa.array([_packed(places)], pa.binary()), pa.array([len(places)], pa.int64()),
        ],
        schema=kind,
    )


def _cut(block_words: int, kind: pa.Schema):
    """The task body that deals rows of key and words into blocks; a block has one row at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        keys: list[pa.Array] = []
        lists: list[pa.Array] = []
        held = 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                to = max(int(np.searchsorted(ends, before + block_words - held, "right")), at + (not keys))
                if to > at:
                    keys.append(batch.column(0).slice(at, to - at))
                    lists.append(batch.column(1).slice(at, to - at))
                    held += int(ends[to - 1]) - before
                    at = to
                if at < len(ends):
                    yield _block(keys, lists, number, kind)
                    number, held = number + 1, 0
                    keys, lists = [], []
        if keys:
            yield _block(keys, lists, number, kind)

    return run


def blocks(docs: DataFrame, words: Column, *, key: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(block, keys, words, lengths, places, n_words)`` of all rows, written to the shared folder.

    ``words`` gives the array of words of a row. Keys may repeat or be null.
    """
    kind = StructType().add("block", LongType()).add("keys", ArrayType(docs.schema[key].dataType)).add("words", ArrayType(StringType()))
    kind = kind.add("lengths", BinaryType()).add("places", BinaryType()).add("n_words", LongType())
    rows = spread(docs).select(F.col(key), words.alias("__words"))
    return materialize(rows.mapInArrow(_cut(block_words, to_arrow_schema(kind)), kind), "term-blocks")


def terms_of(block: pa.RecordBatch) -> Terms:
    """The n-grams of a block, given as one row."""
    places, lengths = (_unpacked(block.column(c)[0].as_py(), "<u4") for c in ("places", "lengths"))
    return Terms(block.column("words").flatten(), places, lengths)


def query_terms(words: Sequence[str]) -> Terms:
    """The query as a block of one document."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    return Terms(coded.dictionary, coded.indices.to_numpy(), np.array([len(words)]))


def _asked(block: int, h: np.ndarray, g: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row per range of hashes; ``h`` in order, as differences."""
    ends = np.searchsorted(h, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64))
    cuts = [0, *ends.tolist(), len(h)]
    spans = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64()),
            pa.array([_packed(np.diff(h[s], prepend=np.uint64(0))) for _, s in spans], pa.binary()),
            pa.array([_packed(g[s]) for _, s in spans], pa.binary()), pa.array([_packed(n[s]) for _, s in spans], pa.binary()),
        ],
        names=["part", "block", "h", "g", "n"],
    )


def _entries(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    h = [np.cumsum(_unpacked(x.as_py(), "<u8"), dtype=np.uint64) for x in table.column("h")]
    g = [_unpacked(x.as_py(), "<u4") for x in table.column("g")]
    return h, g, [_unpacked(x.as_py(), "<u8") for x in table.column("n")]


def _frequencies(asked: pa.Table, kept: pa.Table | None = None) -> pa.Table:
    """The frequencies of one range of hashes, to each block for its own terms. 0: not among ``kept``."""
    hs, gs, ns = _entries(asked)
    sizes = [len(h) for h in hs]
    if kept is not None:
        more = _entries(kept)
        hs, gs, ns = hs + more[0], gs + more[1], ns + [np.zeros_like(n) for n in more[2]]
    df = np.zeros(sum(map(len, hs)), "<u8")
    if sizes:
        order, starts = _in_order(np.concatenate(hs), np.concatenate(gs))
        at = np.flatnonzero(starts)
        total = np.add.reduceat(np.concatenate(ns)[order], at)
        if kept is not None:
            total[~np.logical_or.reduceat(order >= sum(sizes), at)] = 0
        df[order] = total[np.cumsum(starts) - 1]
    bodies = [_packed(x) for x in np.split(df, np.cumsum(sizes))[: len(sizes)]]
    return pa.table({"block": asked.column("block"), "part": asked.column("part"), "df": pa.chunked_array([pa.array(bodies, pa.binary())])})


def frequencies(held: DataFrame, query: Terms, *, kept: DataFrame | None = None) -> DataFrame:
    """``(block, part, df)`` for the blocks of ``held`` and for :data:`QUERY`, counting the query as
    one more document. With ``kept(term)``, terms that are not in it have frequency 0."""
    spark = held.sparkSession
    n_words = held.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]  # about as many as distinct terms of blocks
    parts = max(2 * spark.sparkContext.defaultParallelism, n_words // RANGE_TERMS + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = terms_of(batch.slice(i, 1))
                yield _asked(batch.column("block")[i].as_py(), own.h, own.g, own.documents(), parts)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed, _ = _hashes(batch.column(0))
            h, g = np.ascontiguousarray(mixed[:, 0]), (mixed[:, 1] >> np.uint64(32)).astype("<u4")
            order, _ = _in_order(h, g)
            yield _asked(QUERY, h[order], g[order], np.ones(len(h), "<u8"), parts)

    asked = held.select("block", "words", "lengths", "places").mapInArrow(ask, _ASKED)
    if len(query.h):
        rows = _asked(QUERY, query.h, query.g, query.documents(), parts).to_pylist()
        asked = asked.unionByName(spark.createDataFrame([tuple(r.values()) for r in rows], _ASKED))
    if kept is None:
        return asked.groupBy("part").applyInArrow(lambda rows: _frequencies(rows), _FOUND)
    return asked.groupBy("part").cogroup(kept.select("term").mapInArrow(keep, _ASKED).groupBy("part")).applyInArrow(lambda rows, terms: _frequencies(rows, terms), _FOUND)


def in_hash_order(found: list[tuple[int, bytes]]) -> np.ndarray:
    """The frequencies of a block's distinct hashes, from its ``(part, df)``."""
    return np.concatenate([np.zeros(0, "<u8"), *[_unpacked(df, "<u8") for _, df in sorted(found)]])


def per_block(
    held: DataFrame, found: DataFrame, body: Callable[[pa.RecordBatch, Terms, np.ndarray], Iterator[dict[str, pa.Array]]], schema: StructType
) -> DataFrame:
    """The rows of ``body(block, terms, df)`` of every block, ``df`` by distinct hash."""
    kind = to_arrow_schema(schema)

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        for row in block.combine_chunks().to_batches(max_chunksize=1):
            df = in_hash_order(list(zip(known.column("part").to_pylist(), known.column("df").to_pylist(), strict=True)))
            out += [pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in kind], schema=kind) for made in body(row, terms_of(row), df)]
        return pa.Table.from_batches(out, kind)

    return held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)
