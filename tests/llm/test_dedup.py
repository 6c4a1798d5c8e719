"""Exact and near de-duplication against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import PROSE, SCHEMA, awkward, empty, rows
from confluo.llm import exact_dedup as E
from confluo.llm import near_dedup as N
from confluo.llm.components import components


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(spark):
    table = awkward(spark, ["a b", "ab", " ab ", "AB", "é", "é́"] * 3)
    got = E.exact_dedup(table).collect()
    data = table.collect()
    assert len(got) == len(data)
    groups = defaultdict(list)
    for r in data:
        groups[norm(r.text)].append(r)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    for text, members in groups.items():
        out = by_text[hashlib.sha256(text.encode()).hexdigest()]
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert len(out) == len(members) and {o.group_size for o in out} == {len(members)}
        assert {o.keep_id for o in out} == {best.doc_id}
        assert [o.doc_id for o in out if o.kept] == [best.doc_id]
    assert E.exact_dedup(empty(spark)).collect() == []


def test_runs_merge_to_the_same_result_for_any_partitioning(spark):
    table = spark.createDataFrame(rows([f"text {i % 40}" + " " * (i % 3) for i in range(600)]), SCHEMA)
    want = sorted(map(tuple, E.exact_dedup(table.coalesce(1)).collect()))
    assert sorted(map(tuple, E.exact_dedup(table.repartition(77)).collect())) == want


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    table = awkward(spark, ["a b", "ab"])
    out = E.drop_copies(table)
    assert out.columns == table.columns
    texts = [norm(r.text) for r in out.collect()]
    assert sorted(texts) == sorted({norm(r.text) for r in table.collect()})


def plain_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain_components(data):
    sets = [(r.doc_id, plain_set(r.text)) for r in data if r.doc_id is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return [(i, len(s), find(i)) for i, s in sets]


def words(draw, n):
    return ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def family_texts():
    """Copies with growing edits, chains, a family around a base, and a common passage."""
    draw = random.Random(5)
    out = []
    base = words(draw, 150)
    out.append(" ".join(base))
    for _ in range(60):  # a star: copies near the base, often not near each other
        w = base[:]
        at = draw.randrange(150)
        w[at] = "zz" + words(draw, 1)[0]
        out.append(" ".join(w))
    chain = words(draw, 200)
    for i in range(25):  # a chain: each near the next only
        chain[i * 7] = "q" + words(draw, 1)[0]
        out.append(" ".join(chain))
    passage = words(draw, 60)
    for _ in range(40):  # a shared passage, but not near
        out.append(" ".join(passage + words(draw, 50)))
    for _ in range(40):
        out.append(" ".join(words(draw, draw.randrange(1, 30))))
    return out + ["one two three", "ONE two three", "one two", " one  two\tthree "]


def test_near_dedup(spark):
    table = awkward(spark, family_texts())
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_dedup(table).collect() if r.doc_id is not None)
    assert got == sorted(plain_components(table.collect()))
    assert all(r.kept == (r.doc_id == r.component_id) for r in N.near_dedup(table).collect() if r.doc_id is not None)


def test_near_dedup_of_one_large_family_branches_on(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "FEW", 1)
    table = spark.createDataFrame(rows(family_texts()), SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_dedup(table).collect())
    assert got == sorted(plain_components(table.collect()))


def test_trees_of_a_large_family_branch_on_independently(spark):
    """Pairs alike by 0.85 in a family that 12 trees left in one node each: nearly all meet again.
    The same coordinates in every tree would bring together 1 - (1 - 0.85^4)^2 = 0.77 of them."""
    draw = random.Random(7)
    n, base = 200, [draw.randrange(1 << 30) for _ in range(N.COORDINATES)]
    edit = lambda tokens, share: [draw.randrange(1 << 30) if draw.random() < share else t for t in tokens]
    first = [edit(base, 0.02) for _ in range(n)]
    signatures = first + [edit(tokens, 0.15) for tokens in first]
    reps = spark.createDataFrame(list(enumerate(signatures)), "rep long, signature array<int>").repartition(4)
    paths = spark.createDataFrame([(p * 7919,) for p in range(12)], "path long")
    small, large = N._branch(paths.crossJoin(reps.select("rep")), reps, 1)
    nodes = defaultdict(set)
    for r in small.union(large).collect():
        nodes[r.node].add(r.rep)
    met = {i for node in nodes.values() for i in node if i < n and i + n in node}
    assert len(met) >= 0.98 * n


def test_what_is_compared_follows_the_threshold():
    assert abs(N.look_at(85) - 0.735) < 1e-3 and (N.trees(85), N.ways(85)) == (12, 5)
    assert N.look_at(80) < 0.675 and (N.trees(80), N.ways(80)) == (17, 7)


def test_near_dedup_of_repeated_ids_and_empty_tables(spark):
    data = [(1, PROSE), (1, "other words here for the same id and more of them"), (2, "other words here for the same id and more of them"), (3, PROSE), (4, None), (5, ""), (None, PROSE)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in N.near_dedup(table).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, None)}
    assert N.near_dedup(empty(spark)).collect() == []


def test_shingles_of_long_texts(monkeypatch):
    draw = random.Random(1)
    text = " ".join(words(draw, 3000))
    want = N.shingles(text)
    assert len(want) == len(plain_set(text))
    monkeypatch.setattr(N, "_CHUNK", 512)
    N._powers.cache_clear()
    assert (N.shingles(text) == want).all()
    N._powers.cache_clear()


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(5, 5)], [(1, 2), (3, 4), (2, 3), (9, 8)]])
def test_components(spark, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    want = {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want and Counter(got.values()) == Counter(want.values())
