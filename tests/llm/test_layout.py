"""Fingerprints and shards against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from cases import PROSE, SCHEMA, awkward, empty, rows
from confluo.llm import sharding as K
from confluo.llm import syncmers as S
from pyspark.sql import functions as F


@pytest.mark.parametrize("group_chars", [8_000_000, 300])
def test_edited_texts(spark, monkeypatch, group_chars):
    monkeypatch.setattr(S, "GROUP_CHARS", group_chars)
    table = spark.createDataFrame(rows([None, "", "é", PROSE, PROSE, "ab", *[f"{i} " + PROSE[i % 90 :] for i in range(150)]]), SCHEMA).repartition(5)
    data = sorted(table.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in S.fingerprints(table).collect()}
    assert len(got) == len(data)
    for i, r in enumerate(data):
        text, after = r.text or "", data[(i + 1) % len(data)].text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert got[3].fingerprint == got[4].fingerprint and got[0].fingerprint == got[1].fingerprint == ""


def test_awkward_rows(spark):
    table = awkward(spark)
    got = S.fingerprints(table).collect()
    assert len(got) == table.count()
    prints = defaultdict(set)
    texts = defaultdict(set)
    for r in table.collect():
        texts[r.doc_id].add(r.text or "")
    for r in got:
        if len(texts[r.doc_id]) == 1:
            prints[next(iter(texts[r.doc_id]))].add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert S.fingerprints(empty(spark)).collect() == []
    assert S.fingerprints(spark.createDataFrame([(1, PROSE)], "doc_id long, text string")).first().near_next == 1.0


def test_anchors_are_closed_syncmers_and_context_free(spark):
    a, b = PROSE * 3, "something else came before " + PROSE * 3 + " and after it all went on"
    rows_ = spark.createDataFrame([(a,), (b,)], "text string").select(
        S.anchors(F.col("text")).alias("f"), F.transform(F.split(F.trim("text"), " +"), lambda w: F.xxhash64(w)).alias("h")
    )
    found = []
    for r in rows_.collect():
        s = len(r.h) - S.S + 1
        pairs = spark.createDataFrame([(i, r.h[i], r.h[i + 1]) for i in range(s)], "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("g"))
        g = [x.g for x in pairs.orderBy("i").collect()]
        m = S.K - S.S
        want = [i for i in range(len(r.h) - S.K + 1) if min(g[i : i + m + 1]) in (g[i], g[i + m])]
        assert list(r.f["at"]) == want
        assert max(y - x for x, y in zip(want, want[1:], strict=False)) <= m
        found.append(set(r.f["key"]))
    assert found[0] <= found[1]


def test_anchors_of_text_without_blanks_do_not_depend_on_the_offset(spark):
    passage = "".join(chr(0x4E00 + (i * i * 7919 + i * 31) % 20_000) for i in range(60)) + "🎉"
    texts = [passage, "插" + passage, "ab cd " + passage + " ef", "https://a.example/" + "q7" * 9, "x" * 16 + " " + "y" * 17]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", S.anchors(F.col("text")).alias("f")).collect()
    keys = {r.i: set(r.f["key"]) for r in got}
    assert len(keys[0]) > 10 and keys[0] <= keys[1] and keys[0] <= keys[2]
    import re

    units = [m[1] for m in re.finditer(S._UNITS, texts[4])]
    assert units == ["x" * 16] + ["y" * 8] * 10


def test_plan_has_no_python(spark):
    text = S.fingerprints(spark.createDataFrame(rows([PROSE]), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_shards(spark):
    texts = [None, "", *[PROSE[: i % 97] * (1 + i % 5) for i in range(3000)], *["hot text " * 9] * 1500, "long " * 3000]
    table = spark.createDataFrame(rows(texts), SCHEMA).repartition(6)
    got = K.kd_shards(table).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(by_id) == len(texts)
    size, slots = defaultdict(int), defaultdict(list)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        r = by_id[i]
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    assert max(size.values()) <= mean + 5 * 3000 + 0.01 * mean and min(size.values()) >= mean - 5 * 3000 - 0.01 * mean
    spread = defaultdict(set)
    for i, t in enumerate(texts):
        spread[t].add(by_id[i].shard)
    assert sum(len(s) > 1 for s in spread.values()) <= 23 and len(spread["hot text " * 9]) > 1


def test_shards_of_awkward_tables(spark):
    table = awkward(spark)
    got = K.kd_shards(table).collect()
    assert len(got) == table.count() and all(0 <= r.shard < 24 for r in got)
    assert K.kd_shards(empty(spark)).collect() == []
    one = K.kd_shards(spark.createDataFrame([(7, "x")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].slot == 0
