"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

The cost of a piece is linear (per token) plus quadratic (attention) in its length. Documents are
taken in groups of about ``GROUP_TOKENS`` tokens as they lie in a partition. A group's documents
give as many full sequences as they fill; what is left of each is assigned in descending length
to the sequence of lowest cost that still has room for it. If none has, it is cut over the
sequences with most room. Room and tokens of a group are equal: the odd tokens at its end get
sequences whose lengths are the powers of two that they add up to, so nothing is padded.

A group is packed where its rows are read; no text or token moves between tasks, memory is
bounded by a group and its longest document, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import whole_text
from confluo.llm.tokens import CachedIds, vocabulary_path

LENGTH = 4096
END_ID = 2
GROUP_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
_WIDTH = 4
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def piece_cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def layout(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, size, sequence, offset) of every piece; sequences are numbered from 0."""
    out, rests = [], []
    sequence = 0
    for doc, n in enumerate(sizes):
        for start in range(0, n - n % length, length):
            out.append((doc, start, length, sequence, 0))
            sequence += 1
        if n % length:
            rests.append((n % length, doc))
    total = sum(n for n, _ in rests)
    room = np.array([length] * (total // length) + powers_of_two(total % length), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    for n, doc in sorted(rests, key=lambda x: (-x[0], x[1])):
        start = sizes[doc] - n
        while n:
            fits = np.flatnonzero(room >= n)
            best = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
            take = min(n, int(room[best]))
            out.append((doc, start, take, sequence + best, int(used[best])))
            room[best] -= take
            used[best] += take
            cost[best] += piece_cost(take)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, *, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack every whole text: one row per piece with its token ids (little-endian 32 bit).

    A document is its ids and then ``end_id``; null and empty texts are that id alone. Repeated
    rows are packed each. Extra columns are ignored; an empty table gives no piece.
    """
    path = path or vocabulary_path()

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedIds(path, _WIDTH)
        end = end_id.to_bytes(_WIDTH, "little")
        base = TaskContext.get().partitionId() << 36  # sequences of one task follow each other
        ids, names, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal base
            sizes = [len(x) // _WIDTH for x in ids]
            rows = layout(sizes, length)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d, *_ in rows], pa.int64()), pa.array([s for _, s, *_ in rows], pa.int64()),
                    pa.array([ids[d][s * _WIDTH : (s + n) * _WIDTH] for d, s, n, *_ in rows], pa.binary()), pa.array([sizes[d] for d, *_ in rows], pa.int64()),
                    pa.array([base + q for *_, q, _ in rows], pa.int64()), pa.array([o for *_, o in rows], pa.int64()),
                ],
                schema=_ARROW,
            )
            base += 1 + max(q for *_, q, _ in rows)
            ids.clear()
            names.clear()
            return out

        for part in parts:
            for name, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids.append(encoder.encode(text.as_py()) + end)
                names.append(name)
                held += len(ids[-1]) // _WIDTH
                if held >= group_tokens:
                    yield close()
                    held = 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(packed, PIECES)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / _WIDTH).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
