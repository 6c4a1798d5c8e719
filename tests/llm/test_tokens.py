"""Encoding, decoding and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from cases import awkward, empty
from confluo.llm import bpe, packing
from confluo.llm.tokens import CachedIds, encoder, vocabulary_path
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts():
    draw = random.Random(2)
    bits = [*map(chr, range(256)), "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "İ", "Σ", "ﬁ", "漢字", "🎉", "é", " ", "½", "٣"]
    return ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 25))) for _ in range(1500)]


def test_words_and_ids(library):
    own, cached = encoder(vocabulary_path()), CachedIds(vocabulary_path(), 4, most=50)
    for t in texts():
        want = ids_of(library, t)
        assert [i for w in own.words(t) for i in own.ids(w)] == want, repr(t)
        assert cached.encode(t) == np.array(want, "<u4").tobytes()


def test_documents(spark, library):
    table = awkward(spark, texts()[:200]).repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(table, block_chars=2000).collect())
    want = []
    for r in table.collect():
        ids = ids_of(library, r.text)
        want.append((-1 if r.doc_id is None else r.doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()))
    assert got == sorted(want)
    assert bpe.documents_digest(bpe.encode_documents(empty(spark))).collect() == []


def test_files_are_read_as_they_are(spark, tmp_path):
    spark.range(3).selectExpr("id AS doc_id", "'a b' AS text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert bpe._stable(docs) is docs and bpe._stable(docs.repartition(2)) is not docs


@pytest.mark.parametrize("group", [64, 5000, 1 << 20])
def test_pack(spark, library, group):
    table = awkward(spark, texts()[:100])
    length = 256
    pieces = packing.pack(table, length=length, group_tokens=group).collect()
    want = {}
    for r in table.collect():
        want.setdefault(r.doc_id, []).append(ids_of(library, r.text) + [packing.END_ID])
    by_doc = {}
    for p in pieces:
        assert p.ids and len(p.ids) // 4 <= length
        by_doc.setdefault(p.doc_id, []).append(p)
    assert set(by_doc) == set(want)
    for doc, ps in by_doc.items():
        if len(want[doc]) == 1:
            ps.sort(key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in ps) == np.array(want[doc][0], "<u4").tobytes()
            assert [p.start for p in ps] == [sum(len(q.ids) // 4 for q in ps[:i]) for i in range(len(ps))]
        assert sum(len(p.ids) // 4 for p in ps) == sum(map(len, want[doc]))
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(len(q.ids) // 4 for q in ps[:i]) for i in range(len(ps))]
        total = sum(len(p.ids) // 4 for p in ps)
        assert total <= length and total & (total - 1) == 0  # nothing is padded
    digest = packing.pieces_digest(packing.pack(table)).collect()
    assert all(p.ids_crc32 >= 0 and p.length > 0 for p in digest)
    assert packing.pack(empty(spark)).collect() == []


def test_layout_balances_cost():
    draw = random.Random(3)
    sizes = [draw.randrange(1, 3000) for _ in range(2000)]
    used, cost = {}, {}
    for _, _, n, sequence, _ in packing.layout(sizes):
        used[sequence] = used.get(sequence, 0) + n
        cost[sequence] = cost.get(sequence, 0) + packing.piece_cost(n)
    full = [c for s, c in cost.items() if used[s] == packing.LENGTH]
    assert sum(used.values()) == sum(sizes) and len(full) == sum(sizes) // packing.LENGTH
    assert np.percentile(full, 90) < 1.6 * np.mean(full)


def test_crc(spark):
    rows = spark.createDataFrame([(1, 0, bytearray(b"\x01\x00\x00\x00"), 1, 0, 0)], packing.PIECES)
    assert packing.pieces_digest(rows).first().ids_crc32 == zlib.crc32(b"\x01\x00\x00\x00")
