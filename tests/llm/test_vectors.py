"""Vector codes against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
from confluo.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int"


def plain(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """The contract in Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: kept[r][0])[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        found = [[nearest(x[p], books[p])[0] for p in range(parts)] for x in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p] for x, f in zip(cut, found, strict=True) if f[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = {}
    for (i, _, label), x in zip(kept, cut, strict=True):
        best = [nearest(x[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{c:02x}" for c, _ in best), sum(e for _, e in best), label)
    sums = {}
    for _, e, label in out.values():
        sums[label] = sums.get(label, 0) + e
    text = ",".join(str(x) for p in books for e in p for x in e)
    return {i: (c, e, sums[label]) for i, (c, e, label) in out.items()}, hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "extra", 1) for i, v, label in rows], SCHEMA).repartition(5)


def test_products_are_exact():
    draw = np.random.default_rng(1)
    for top in (3, 4095, 4096, 1 << 20, 1 << 27):
        a, b = draw.integers(-top, top + 1, (50, 16)), draw.integers(-top, top + 1, (7, 16))
        a[0], b[0] = -top, top
        assert (V.exact_dot(a, b) == a @ b.T).all()
        assert (sum(x.astype(np.int64) << V.LIMB_BITS * i for i, x in enumerate(V.limbs(a))) == a).all()
    assert len(V.limbs(np.array([[5000]]))) == 2


def test_ties_go_to_the_first():
    book = np.array([[0, 0], [4, 0], [0, 0]])
    best, far = V.nearest(np.array([[2, 0], [0, 0], [4, 1]]), book)
    assert best.tolist() == [0, 0, 1] and far.tolist() == [4, 0, 1]


def test_codes_equal_plain_arithmetic(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(16)], draw.choice([0, 1, 1, 1, None])) for i in range(300)]
    rows += [(500 + i, rows[i % 3][1], 1) for i in range(80)]  # copies of a few vectors
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [float("nan")] + [0.0] * 15, 2), (903, [float("inf")] * 16, 2), (-4, [7.5] * 16, 9), (904, [-31_000.25] * 16, 9)]
    want, books = plain(rows)
    got = V.compress_vectors(table(spark, rows)).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want)
    assert {r.codebooks_sha256 for r in got} == {books}


def test_awkward_tables(spark):
    few = [(3, [0.5] * 8, None), (1, [0.25] * 8, None), (1, [0.25] * 8, None), (None, [0.125] * 8, 4), (7, [], 4), (8, [1.0] * 16, 4), (9, [1e300] * 8, 5)]
    got = V.compress_vectors(table(spark, few)).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == [(False, 1), (False, 1), (False, 3), (False, 9), (True, None)]
    assert all(r.error == 0 for r in got)
    assert V.compress_vectors(table(spark, few).limit(0)).collect() == []
    assert V.compress_vectors(table(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_sql(spark):
    draw = random.Random(6)
    rows = [(i * 3, [draw.uniform(-2, 2) for _ in range(16)], draw.choice([0, 1, None])) for i in range(120)]
    want = {r.vec_id: tuple(r) for r in V.compress_vectors(table(spark, rows)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert {r[0]: r for r in con.execute(V.sql()).fetchall()} == want


def test_codes_decode_to_the_entries(spark):
    rows = [(i, [float(i % 16 == j) for j in range(16)], 0) for i in range(64)]
    ints, width = V.integers(table(spark, rows), V.PARTS, V.SCALE)
    books = V.train(ints, width)
    for r in V.encode(ints, books).collect():
        assert r.error == sum((a - b) ** 2 for a, b in zip(V.decode(r.code, books).tolist(), [4096 * (r.vec_id % 16 == j) for j in range(16)], strict=True))
