"""The pipeline's stages against each other's inputs, and the registered queries."""

from __future__ import annotations

import os

import corpus_pipeline as P
import pytest
from cases import awkward, empty
from compare import compare, connect
from confluo.llm.queries import ORACLES, QUERIES

SF = os.environ.get("CONFLUO_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry_has_all():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = P.run(spark, SF).collect()
    ids = {p.doc_id for p in pieces}
    assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert {p.doc_id for p in pieces if p.start == 0} == ids
    for doc in ids:
        own = [p for p in pieces if p.doc_id == doc]
        assert sum(p.length for p in own) == own[0].doc_tokens


def test_near_stage_drops_copies_from_80_percent_on(spark):
    words = [f"w{i}" for i in range(204)]  # 200 shingles
    copy = [*words[:60], "other", *words[61:120], "another", *words[121:180], "third", *words[181:190], "x", *words[191:]]
    texts = {1: words, 2: copy, 3: [f"v{i}" for i in range(204)]}  # 1 and 2 share 180 of 220: 0.818
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near(spark, docs, SF).collect()) == [1, 3]


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_take_awkward_rows(spark, make, tmp_path):
    docs = make(spark)
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
