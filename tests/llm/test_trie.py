"""The prefix trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from confluo.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, shard int"


def plain(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [t[3:] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    below = defaultdict(lambda: [0, 0, 0])  # leaves, saved, children
    parents = {n[:-1] for n in members if n}
    for n, m in members.items():
        for d in range(len(n) + 1):
            below[n[:d]][0] += n not in parents
            below[n[:d]][1] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
        if n:
            below[n[:-1]][2] += 1
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), below[n][2], below[n][0], below[n][1],
         hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def ours(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


def conversations(n, seed=3):
    draw = random.Random(seed)
    rows = []
    for c in range(-10, n):
        for turn in range(draw.randrange(0, 7)):
            text = draw.choice(["hot", "hot", "hot", "é" * 3, "", None, f"t{draw.randrange(4)}"])
            rows.append((c * 3, turn if turn else draw.choice([None, 0]), draw.choice(["user", "user", None]), text))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("most", [100_000, 7])
def test_trie_equals_a_dictionary_of_prefixes(spark, most):
    rows = conversations(600) + [(None, 0, "user", "nobody's"), (1, 1, "a", "tie"), (1, 1, "a", "eit"), (1, 1, "a", "tie")]
    rows += [(5_000 + 5 * i, t, "u", f"copy {t}") for i in range(400) for t in range(3)]  # one conversation many times
    assert ours(P.prefix_trie(table(spark, rows), most=most)) == plain(rows)


def test_long_and_empty(spark):
    rows = [(5 * k, t, "u", "x" if t < 1500 else f"{k}") for k in range(3) for t in range(2500)]
    assert len(ours(P.prefix_trie(table(spark, rows), most=500))) == 1 + 1500 + 3 * 1000
    assert ours(P.prefix_trie(table(spark, [(7, 0, None, "y" * 100_000)]))) == plain([(7, 0, None, "y" * 100_000)])
    turnless = [(c, 0, "u", "a") for c in range(30) if c % 5]
    assert ours(P.prefix_trie(table(spark, turnless))) == plain(turnless)
    assert P.prefix_trie(table(spark, rows).limit(0)).collect() == []


def test_find_close():
    draw = random.Random(1)
    for shape in ("wide", "deep", "mixed"):
        bits, depth = [1], 1
        while len(bits) < 5000:
            up = depth == 1 or draw.random() < {"wide": 0.3, "deep": 0.9, "mixed": 0.5}[shape]
            bits.append(1 if up else -1)
            depth += bits[-1]
        bits += [-1] * depth
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b == 1:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(np.array(bits) == 1)
        assert P.find_close(np.cumsum(bits), opens, 16).tolist() == [want[i] for i in opens]


def test_interval_minima():
    values = np.random.default_rng(2).integers(0, 99, 40)
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    start, stop = np.array(pairs).T
    assert P.interval_minima(values, start, stop).tolist() == [values[a:b].min() for a, b in pairs]


def test_sql(spark):
    rows = [r for r in conversations(200, 8) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in con.execute(P.SQL).fetchall())
    assert got == plain(rows) == ours(P.prefix_trie(table(spark, rows)))
