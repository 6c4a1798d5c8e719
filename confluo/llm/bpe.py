"""BPE encoding and decoding by a distinct-word table.

Texts are split into words where they lie. A *block* is the run of documents one task reads, up to
``BLOCK_CHARS``: it lists each of its distinct words once, with a place number, and each document
as place numbers. The (word, slot) rows, a slot being block and place, meet by word: sorted runs of
one word make the distinct-word table, each word is encoded once, and its ids are joined back to
its slots by position. They return to their blocks, where documents are put together again.
Decoding joins ids with the vocabulary's pieces, a table of fixed size that every task has.

What moves between tasks is distinct words per block and packed place numbers, not texts or
occurrences: a word that is a third of a corpus is one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import whole_text
from confluo.llm.tokens import encoder, vocabulary_path
from confluo.session import materialize

BLOCK_CHARS = 8_000_000
_SHIFT = 1 << 25  # places of a block; a block has fewer words than code points
_RUN = 100_000  # slots of one word in a row at most


def _packed(places: np.ndarray) -> bytes:
    """Place numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(places.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes[:3]).tobytes() + planes[3].tobytes() * bool(planes[3].any()), 3)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data, max_output_size=4 * n), np.uint8)
    planes = np.zeros((4, n), np.uint8)
    planes.reshape(-1)[: len(raw)] = raw
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Numbers(dict):
    """Numbers of words in order of first sight."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _blocks(path: str, want: str, block_chars: int):
    """The task body that gives the words of its blocks, or their documents.

    Both are computed by reading the same rows in the same order, so places agree. Places are
    in order of frequency in the block, so most take one byte.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(path).words
        block = TaskContext.get().partitionId() << 12
        seen = _Numbers()
        docs: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            counts = np.bincount(np.concatenate([np.zeros(0, np.uint32), *[x for _, x in docs]]), minlength=len(seen))
            place = np.empty(len(seen), np.int64)
            place[np.argsort(-counts, kind="stable")] = np.arange(len(seen))
            if want == "documents":
                for i in range(0, len(docs), 500):
                    some = docs[i : i + 500]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([block] * len(some), pa.int64()), "doc_id": pa.array([d for d, _ in some], pa.int64()), "n": pa.array([len(x) for _, x in some], pa.int32()),
                            "places": pa.array([_packed(place[x]) if len(x) else b"" for _, x in some], pa.binary()),
                        }
                    )
            else:  # in word order: neighbours share their beginnings, which compresses well
                words = sorted(seen)
                for i in range(0, len(words), 50_000):
                    some = words[i : i + 50_000]
                    slots = block * _SHIFT + place[[seen[w] for w in some]]
                    yield pa.RecordBatch.from_pydict({"word": pa.array(some), "slot": pa.array(slots, pa.int64())})

        for part in parts:
            for name, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                if held and held + len(text) > block_chars:
                    yield from close()
                    block, held = block + 1, 0
                    seen.clear()
                    docs.clear()
                held += len(text)
                words = split(text)
                docs.append((name, np.fromiter(map(seen.__getitem__, words), np.uint32, len(words))))
        yield from close()

    return run


def _stable(docs: DataFrame) -> DataFrame:
    """The rows, readable twice in the same order: files as they are, anything else written first."""
    plan = [docs._jdf.queryExecution().optimizedPlan()]
    while plan:
        node = plan.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation"):
            return materialize(docs, "texts")
        below = node.children()
        plan += [below.apply(i) for i in range(below.size())]
    return docs


@lru_cache(maxsize=2)
def pieces(path: str) -> np.ndarray:
    """Piece by id, in UTF-8: as many entries as the vocabulary has tokens."""
    known = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    out = np.full(max(known.values()) + 1, b"", object)
    for piece, i in known.items():
        out[i] = piece.encode()
    return out


def _encoded(path: str):
    """The task body that turns sorted (word, slot) rows into (word, ids, slots)."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        last, ids = None, b""
        for part in parts:
            words = part.column(0).to_pylist()
            slots = part.column(1).to_numpy()
            starts = [i for i, w in enumerate(words) if i % _RUN == 0 or w != words[i - 1]]
            encoded = []
            for i in starts:
                if words[i] != last:
                    last, ids = words[i], np.array(own.ids(words[i]), "<u4").tobytes()
                encoded.append(ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([words[i] for i in starts], pa.string()), "ids": pa.array(encoded, pa.binary()),
                    "slots": pa.ListArray.from_arrays(pa.array([*starts, len(words)], pa.int32()), pa.array(slots, pa.int64())),
                }
            )

    return encode


def _by_word(words: DataFrame) -> DataFrame:
    return words.repartition("word").sortWithinPartitions("word")


def word_table(words: DataFrame, path: str) -> DataFrame:
    """The distinct-word table (word, ids, slots) of (word, slot) rows: each word is encoded once.

    ``ids`` are little-endian 32 bit. Rows of a word lie in one partition, sorted; a word with
    very many slots takes several rows, so no task holds them all.
    """
    return _by_word(words).mapInArrow(_encoded(path), "word string, ids binary, slots array<long>")


def _by_block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn rows of the table around: per batch, a row for each block with the places and ids of
    the batch's words in it. Never more rows than (word, slot) pairs, and far fewer if blocks are."""
    for part in parts:
        ids, lists = part.column("ids").to_pylist(), part.column("slots")
        slots = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        block = slots // _SHIFT
        order = np.argsort(block, kind="stable")
        found, starts = np.unique(block[order], return_index=True)
        out: dict[str, list] = {k: [] for k in ("block", "n", "places", "counts", "total", "ids")}
        for b, start, end in zip(found, starts, [*starts[1:], len(order)], strict=True):
            some = order[start:end]
            mine = [ids[i] for i in owner[some]]
            flat = np.frombuffer(b"".join(mine), "<u4")
            values = (int(b), len(some), _packed(slots[some] % _SHIFT), _packed(np.array([len(x) // 4 for x in mine])), len(flat), _packed(flat))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def encode_documents(docs: DataFrame, *, path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text: ids as little-endian unsigned 32 bit, decoded in UTF-8.

    Equal to encoding the text without adding special tokens and decoding without skipping any.
    Null and empty texts have no ids and decode to nothing. Repeated rows give repeated results.
    Extra columns are ignored; an empty table gives an empty result.
    """
    path = path or vocabulary_path()
    rows = _stable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    words = rows.mapInArrow(_blocks(path, "words", block_chars), "word string, slot long")
    # The rows of the word table go to their blocks where they are made: one worker a task.
    encode = _encoded(path)
    filled = _by_word(words).mapInArrow(lambda parts: _by_block(encode(parts)), "block long, n int, places binary, counts binary, total int, ids binary")
    documents = rows.mapInArrow(_blocks(path, "documents", block_chars), "block long, doc_id long, n int, places binary")

    def put_together(held: pa.Table, known: pa.Table) -> pa.Table:
        table = pieces(path)
        ids: list[bytes] = [b""] * sum(known.column("n").to_pylist())
        for r in known.to_batches():
            columns = [r.column(c).to_pylist() for c in ("n", "places", "counts", "total", "ids")]
            for n, places, counts, total, body in zip(*columns, strict=True):
                flat, ends = _unpacked(body, total).astype("<u4").tobytes(), np.cumsum(_unpacked(counts, n)).tolist()
                start = 0
                for at, end in zip(_unpacked(places, n).tolist(), ends, strict=True):
                    ids[at] = flat[4 * start : 4 * end]
                    start = end
        decoded = [b" ".join(table[np.frombuffer(x, "<u4")]) for x in ids]
        out = []
        for name, n, data in zip(held.column("doc_id").to_pylist(), held.column("n").to_pylist(), held.column("places"), strict=True):
            at = _unpacked(data.as_py(), n).tolist() if n else []
            out.append((name, b"".join(map(ids.__getitem__, at)), b" ".join(map(decoded.__getitem__, at))))
        d, i, t = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": pa.array(d, pa.int64()), "ids": pa.array(i, pa.binary()), "decoded": pa.array(t, pa.binary())})

    return documents.groupBy("block").cogroup(filled.groupBy("block")).applyInArrow(put_together, "doc_id long, ids binary, decoded binary")


def documents_digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
