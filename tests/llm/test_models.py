"""Language identification and quality: plain versions, held-out accuracy, awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
from cases import PROSE, SCHEMA, awkward, empty, rows
from confluo.llm import language as L
from confluo.llm import quality as Q

SAMPLES = {
    "en": "the cat sat on the mat while rain fell over the quiet town and people went home early that evening ",
    "fr": "le chat est assis sur le tapis pendant que la pluie tombe sur la ville et les gens rentrent chez eux ",
    "de": "die katze sitzt auf der matte während der regen über die stadt fällt und die leute nach hause gehen ",
}


def plain_phrases(text, codes_of, source):
    """Greedy longest matches against the labelled text, lane by lane."""
    train, count = bytes(codes_of(source)), 0
    codes = bytes(codes_of(text))
    for at in range(0, len(codes), L.LANE):
        lane = codes[at : at + L.LANE]
        i = 0
        while i < len(lane):
            n = 1
            while i + n <= len(lane) and lane[i : i + n] in train:
                n += 1
            i += max(1, n - 1)
            count += 1
    return count


def test_phrases_are_longest_matches():
    parser = L.Parser(SAMPLES)
    texts = [*SAMPLES.values(), "the katze est on a 12 tapis!!", "zzz qqq", "é", PROSE * 30]
    coded = [L.classes(t, parser.table) for t in texts]
    got = parser.phrases(coded)
    for i, t in enumerate(texts):
        for j, source in enumerate(SAMPLES.values()):
            # a class that no labelled text has ends a phrase by itself
            assert got[i, j] == plain_phrases(t, lambda x: L.classes(x, parser.table), source), (t, j)


def test_languages(spark):
    texts = [SAMPLES[lang][a : a + 70] for lang in SAMPLES for a in range(0, 30)]
    langs = [lang for lang in SAMPLES for _ in range(30)]
    data = [(i, t, langs[i], "s", None, None, None, None) for i, t in enumerate(texts)]
    table = spark.createDataFrame(data, SCHEMA)
    got = {r.doc_id: r for r in L.identify_languages(table).collect()}
    assert len(got) == len(data)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in got)
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_every_labelled_language_is_learned_from_several_texts(spark):
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    huge = [(i, SAMPLES["de"] * 6000, "de") for i in train[:2]]  # 600,000 code points each
    mixed = [(train[2], "x" * 50_000, "fr"), *[(i, SAMPLES["fr"], "fr") for i in train[3:13]]]
    copies = [(train[13], SAMPLES["en"], "en")] * 500
    table = spark.createDataFrame([*huge, *mixed, *copies], "doc_id long, text string, lang string").repartition(4)
    got = L.labelled_texts(table, per_language=2000)
    assert set(got) == {"de", "fr", "en"} and got["en"] == SAMPLES["en"]
    assert all(len(t.replace("\n", "")) <= 2000 for t in got.values()) and len(got["de"]) == 2001
    assert got["fr"].count(SAMPLES["fr"]) == 10 and got["fr"].count("x") >= 900
    assert not L.labelled_texts(empty(spark))


def test_pieces_share_the_bound():
    assert L.pieces([5, 7], 1000) == [5, 7]
    assert L.pieces([100_000, 10, 100_000], 40_000) == [19_995, 10, 19_995]
    assert L.pieces([100_000] * 400, 40_000) == [1000] * 40
    assert L.pieces([100] * 500, 40_000) == [100] * 400


def test_languages_of_awkward_rows(spark):
    table = awkward(spark)
    got = L.identify_languages(table).collect()
    assert len(got) == table.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[2].lang_pred == "und" and by_id[0].score == 0
    assert all(r.lang_pred in ("und", "en", "fr") for r in got)
    assert L.identify_languages(empty(spark)).collect() == []
    unlabelled = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert L.identify_languages(unlabelled).first().lang_pred == "und"


def noisy(i):
    return PROSE if i % 2 else " ".join(w + "###$$$" for w in PROSE.split())


def test_quality(spark):
    n = 400
    table = spark.createDataFrame(rows([noisy(i) + f" {i} x" * (i % 7) for i in range(n)]), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, None, "clash") for i in range(n)], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in Q.quality_scores(table, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in got)
    assert np.mean([got[i].predicted == i % 2 for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    kept = Q.drop_rejected(table, labels)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_without_labels_and_awkward_rows(spark):
    table = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.quality_scores(table, none).collect()} == {0.5}
    assert Q.drop_rejected(table, none).count() == table.count()
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0), (99, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(table, some).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    assert Q.quality_scores(empty(spark), some).collect() == []


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 5, 30).astype(float)
    ones = np.minimum(n, rng.integers(0, 5, 30))
    fit = Q.pool_adjacent_violators(ones, n)
    assert (np.diff(fit) >= -1e-12).all() and np.isclose((fit * n).sum(), ones.sum())
    loss = lambda f: (n * (ones / n - f) ** 2).sum()
    for _ in range(200):
        other = np.sort(np.clip(fit + rng.normal(scale=0.05, size=30), 0, 1))
        assert loss(fit) <= loss(other) + 1e-9
