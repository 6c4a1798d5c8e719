"""Similarity, candidate generation and resolution against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confluo.functions.bounds import Profiles, best_matches, upper_bounds
from confluo.functions.similarity import Prepared, score_at_least, wratio, wratio_above, wratio_text
from confluo.operators import resolve as R
from confluo.operators import similar
from confluo.operators.similar import best_of_block, fuzzy_best_match, similar_keys

INCOMING = "arrival bigint, source string, source_id string, url string, title string, company string, location string"
STORED = "id bigint, url string, company_normalized string, canonical_key string"
SOURCES = "job_id bigint, source_name string, source_trust string"
NOW = "2024-01-02 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


LOCKED = [
    ("senior software engineer|stripe|remote", "senior software engineer|stripe|remote", 100.0),
    ("product manager|stripe|remote", "senior product manager|stripe|remote", 95.0),
    ("software engineer|stripe|remote", "software engineer iii|stripe|remote", 93.9),
    ("senior software engineer|acme|remote", "staff software engineer|acme|remote", 87.3),
    ("software engineer|acme|remote", "product designer|acme|remote", 70.2),
]


def test_locked_scores(spark):
    df = spark.createDataFrame(LOCKED, "a string, b string, want double")
    for row in df.withColumn("got", wratio(F.col("a"), F.col("b"))).collect():
        assert round(row.got, 1) == row.want
    assert wratio_text("", "x") == 0.0


def _words(rng):
    vocabulary = "senior staff software product engineer manager designer iii ii data platform growth lead a b".split()
    title = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 7)))
    return title[: len(title) - rng.randint(0, 2)] if rng.random() < 0.5 else title


@pytest.mark.parametrize("floor", [91.0, 93.0, 95.0, 97.0])
def test_similar_keys_is_exact(spark, floor):
    rng = random.Random(7)
    keys = set()
    while len(keys) < 350:
        company = rng.choice(["acme", "acme labs", "", "z"])
        place = rng.choice(["remote", "new york", "x"])
        keys.add((company, f"{_words(rng)}|{company}|{place}".strip()))
    got = {
        (r.block, r.key, r.other): r.score
        for r in similar_keys(spark.createDataFrame(sorted(keys), "block string, key string"), floor=floor).collect()
    }
    want = {}
    for (b1, a), (b2, b) in itertools.combinations(sorted(keys), 2):
        if b1 == b2:
            score = wratio_text(a, b)
            assert score_at_least(a, b, floor) == (score if score >= floor else 0.0)
            if score >= floor:
                want[(b1, min(a, b), max(a, b))] = score
    assert len(want) >= 3
    assert got == want
    indexed = similar_keys(spark.createDataFrame(sorted(keys), "block string, key string"), floor=floor, paged=0)
    assert {(r.block, r.key, r.other): r.score for r in indexed.collect()} == want


def test_keys_of_few_words_are_not_indexed(spark, monkeypatch):
    """Each gram of such keys is frequent, so the index would make more rows than there are pairs."""
    names = [" ".join(p) for p in itertools.product(["red", "blue", "hot", "old"], ["ring", "bolt", "gear", "nut"], ["eng", "swe", ""], ["remote", "london"])]
    few = spark.createDataFrame([("acme", n.strip()) for n in names], "block string, key string")
    rng = random.Random(5)
    many = {("z", " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3))) for _ in range(300)}
    many |= {("z", key + "s") for _, key in sorted(many)[:9]}
    many = spark.createDataFrame(sorted(many), "block string, key string")
    want = {(r.key, r.other, r.score) for r in similar_keys(few, floor=93.0).collect()}
    assert {(r.key, r.other, r.score) for r in similar_keys(few, floor=93.0, paged=0, dense=0).collect()} == want
    seen = []
    indexed = similar._indexed_pairs
    monkeypatch.setattr(similar, "_indexed_pairs", lambda base, *rest: seen.extend(r.block for r in base.select("block").distinct().collect()) or indexed(base, *rest))
    got = similar_keys(few.unionByName(many), floor=93.0, paged=0).collect()
    assert seen == ["z"]
    assert {(r.key, r.other, r.score) for r in got if r.block == "acme"} == want
    assert sum(r.block == "z" for r in got) == 9


def test_pairs_are_made_once_for_both_directions(spark):
    pairs = spark.createDataFrame([("b", "x", "y", 95.0)], "block string, key string, other string, score double")
    both = similar.mirrored(pairs)
    assert sorted(map(tuple, both.collect())) == [("b", "x", "y", 95.0), ("b", "y", "x", 95.0)]
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_similar_keys_needs_high_floor(spark):
    with pytest.raises(ValueError):
        similar_keys(spark.createDataFrame([("a", "b")], "block string, key string"), floor=80.0)


def test_fuzzy_best_match(spark):
    stored = spark.createDataFrame(
        [(1, "acme", "senior product manager|acme|remote"), (2, "acme", "product manager|acme|remote"), (3, None, "x"), (4, "b", None)],
        "id bigint, company_normalized string, canonical_key string",
    )
    fresh = spark.createDataFrame(
        [(1, "acme", "product manager|acme|remote"), (2, "acme", "nurse|acme|oslo"), (3, "b", "x|b|y")],
        "arrival bigint, company_normalized string, canonical_key string",
    )
    got = {r.arrival: (r.match_id, r.score) for r in fuzzy_best_match(fresh, stored).collect()}
    low = wratio_text("nurse|acme|oslo", "product manager|acme|remote")
    assert got == {1: (2, 100.0), 2: (1, pytest.approx(low)), 3: (None, None)}


KEYS = st.text(alphabet="abc |", max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(KEYS, min_size=1, max_size=12), st.lists(KEYS, min_size=1, max_size=12))
def test_bounds_hold_and_the_search_is_exact(keys, names):
    a, b = [Prepared.of(k) for k in keys], [Prepared.of(n) for n in names]
    alphabet = {c: i for i, c in enumerate("abc |")}
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(k.set for k in (*a, *b)))))}
    bounds = upper_bounds(Profiles(a, alphabet, vocabulary), Profiles(b, alphabet, vocabulary), slice(0, len(a)))
    scores = [[wratio_text(k, n) for n in names] for k in keys]
    for i, row in enumerate(scores):
        for j, score in enumerate(row):
            assert score <= bounds[i, j] + 1e-9
            for floor in (0.0, score, score + 1e-9, 60.0, 90.0, 96.0):
                got = wratio_above(a[i], b[j], floor)
                assert got == score if score >= floor else got < floor
    assert list(best_matches(keys, names, tile=5)) == [(i, row.index(max(row)), max(row)) for i, row in enumerate(scores)]


def test_best_match_at_any_score_equals_brute_force(spark):
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("sale", "engin", "data", "oper", "desk") for b in ("s", "er", "eer", "ing", "lead")]
    keys = {("hot" if draw.random() < 0.5 else draw.choice("xyz"), f"{' '.join(draw.choices(words, k=draw.randrange(1, 6)))}|{draw.choice(words)}") for _ in range(700)}
    keys = sorted(keys) + [("x", ""), ("y", " "), ("x", "z" * 200)]
    stored = [(i, b, k) for i, (b, k) in enumerate(keys) if i % 2]
    fresh = [(i, b, k) for i, (b, k) in enumerate(keys) if i % 3 == 0] + [(9000, "none", "x"), (9001, None, "x"), (9002, "x", None)]
    want = {}
    for i, b, k in fresh:
        options = [(-wratio_text(k, n), j, n) for j, c, n in stored if c == b] if k is not None else []
        want[i] = (min(options)[1], min(options)[2], -min(options)[0]) if options else (None, None, None)
    schema = "long, company_normalized string, canonical_key string"
    for page in (512, 20):
        names = spark.createDataFrame(stored, f"id {schema}").selectExpr("id", "company_normalized AS block", "canonical_key AS key")
        asked = spark.createDataFrame(fresh, f"arrival {schema}").selectExpr("company_normalized AS block", "canonical_key AS key").distinct()
        got = {(r.block, r.key): (r.id, r.other, r.score) for r in best_of_block(asked, names, page=page).collect()}
        assert got == {(b, k): want[i] for i, b, k in fresh if want[i][0] is not None}
    rows = fuzzy_best_match(spark.createDataFrame(fresh, f"arrival {schema}"), spark.createDataFrame(stored, f"id {schema}")).collect()
    assert {r.arrival: (r.match_id, r.match_key, r.score) for r in rows} == want


def _sequential(incoming, stored, sources, ids):
    """The rule, row by row."""

    def norm(u):
        u = u.strip().lower()
        return u[:-1] if u.endswith("/") else u

    jobs = [dict(id=i, url=u, c=c, k=k) for i, u, c, k in sorted(stored)]
    seen = {(j, s): t for j, s, t in sources}
    out = {}
    for r in incoming:
        match, score, flagged = None, None, None
        if r.url.strip():
            match = next((j for j in jobs if j["url"] == norm(r.url)), None) or next(
                (j for j in jobs if j["url"] == r.url), None
            )
        if match is None:
            block = [j for j in jobs if j["c"] == r.company_normalized and j["k"] is not None]
            match = next((j for j in block if j["k"] == r.canonical_key), None)
            if match:
                score = 100.0
            else:
                scored = [(wratio_text(r.canonical_key, j["k"]), -n, j) for n, j in enumerate(block)]
                if scored:
                    top, _, job = max(scored, key=lambda x: x[:2])
                    if top >= 95:
                        match, score = job, top
                    elif top >= 93:
                        flagged = (job["id"], top)
                if match is None and not r.url.strip():
                    match = next((j for j in jobs if j["url"] == r.stored_url), None)
        if match is None:
            job = dict(id=ids[r.stored_url], url=r.stored_url, c=r.company_normalized, k=r.canonical_key)
            jobs.append(job)
            seen[(job["id"], r.source)] = "trusted"
            out[r.arrival] = ("review_flagged" if flagged else "new_job", job["id"], *(flagged or (None, None)), False)
        else:
            pair, flip = (match["id"], r.source), False
            outcome = "duplicate" if pair in seen else "new_source"
            if outcome == "new_source":
                doubtful = [p for p in seen if p[0] == match["id"] and seen[p] == "untrusted"]
                seen[pair], flip = "trusted", bool(doubtful)
                for p in doubtful:
                    seen[p] = "trusted"
            out[r.arrival] = (outcome, match["id"], match["id"], score, flip)
    return out


@pytest.mark.parametrize("seed", [3, 11])
def test_resolution_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)

    def rows(n):
        return [
            (
                i, rng.choice("abc"), rng.choice(["", "1", str(i)]),
                rng.choice(["", "  ", f"https://x/{rng.randint(0, 40)}", f"https://X/{rng.randint(0, 40)}/"]),
                _words(rng), rng.choice(["Acme Inc", "Stripe", "Stripe Corp", ""]), rng.choice(["SF", "Remote", "remote"]),
            )
            for i in range(n)
        ]

    incoming = spark.createDataFrame(rows(220), INCOMING)
    stored, sources, urls = [], [], set()
    for i, r in enumerate(R.with_keys(spark.createDataFrame(rows(30), INCOMING)).orderBy("arrival").collect()):
        if r.stored_url not in urls:
            urls.add(r.stored_url)
            blank = rng.random() < 0.15
            stored.append((1000 + i, r.stored_url, None if blank else r.company_normalized, None if blank else r.canonical_key))
            sources.append((1000 + i, rng.choice(["a", "legacy"]), rng.choice(["trusted", "untrusted"])))
    keyed = R.with_keys(incoming).withColumn("h", F.xxhash64("stored_url")).orderBy("arrival").collect()
    want = _sequential(keyed, stored, sources, {r.stored_url: r.h for r in keyed})
    outcomes = R.resolve_outcomes(spark.createDataFrame(stored, STORED), spark.createDataFrame(sources, SOURCES), incoming)
    got = {
        r.arrival: (r.outcome, r.job_id, r.matched_job_id, r.fuzzy_score, r.trust_flipped) for r in outcomes.collect()
    }
    assert {o for o, *_ in want.values()} >= {"new_job", "new_source", "duplicate"}
    assert got == want


def test_batch_tables(spark):
    rows = [
        (0, "a", "1", "https://x/1", "Software Engineer", "Stripe", "Remote"),
        (1, "b", "2", "https://x/2", "Software Engineer", "Stripe", "Remote"),
        (2, "a", "3", "https://x/3", "Software Engineer", "Stripe", "Remote"),
        (3, "a", "4", "https://x/4", "Software Engineer III", "Stripe", "Remote"),
    ]
    from confluo.schemas import SOURCE_SCHEMA, STORED_JOB_SCHEMA

    result = R.resolve_batch(
        spark.createDataFrame([], STORED_JOB_SCHEMA), spark.createDataFrame([], SOURCE_SCHEMA),
        spark.createDataFrame(rows, INCOMING), now=now(),
    )
    assert [r.outcome for r in result.outcomes.orderBy("arrival").collect()] == [
        "new_job", "new_source", "duplicate", "review_flagged",
    ]
    assert result.jobs.count() == 2 and result.sources.count() == 3
    event = result.events.collect()
    assert len(event) == 1 and event[0].event_type == "possible_duplicate" and '"fuzzy_score":93.9' in event[0].detail
    again = R.resolve_batch(result.jobs, result.sources, spark.createDataFrame(rows, INCOMING), now=now())
    assert {r.outcome for r in again.outcomes.collect()} == {"duplicate"}


def test_exact_only_ignores_near_keys(spark):
    rows = [(0, "a", "1", None, "Product Manager", "S", "R"), (1, "a", "2", None, "Senior Product Manager", "S", "R")]
    args = spark.createDataFrame([], STORED), spark.createDataFrame([], SOURCES), spark.createDataFrame(rows, INCOMING)
    assert [r.outcome for r in R.resolve_outcomes(*args, fuzzy=False).orderBy("arrival").collect()] == ["new_job", "new_job"]
    assert [r.outcome for r in R.resolve_outcomes(*args).orderBy("arrival").collect()] == ["new_job", "duplicate"]


def test_hot_key_is_one_row_per_job(spark):
    rows = spark.range(3000).selectExpr(
        "id AS arrival", "CAST(id % 3 AS STRING) AS source", "'' AS source_id", "'' AS url",
        "'Engineer' AS title", "'Acme' AS company", "'Remote' AS location",
    )
    outcomes = R.resolve_outcomes(spark.createDataFrame([], STORED), spark.createDataFrame([], SOURCES), rows)
    counts = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    assert counts == {"new_job": 1, "new_source": 2, "duplicate": 2997}


def test_stored_pairs_are_left_out_and_low_matches_marked(spark):
    keys = [("c", "senior engineer|c|x", True), ("c", "senior engineers|c|x", False), ("c", "senior engineerz|c|x", False)]
    got = similar_keys(spark.createDataFrame(keys, "block string, key string, fresh boolean"), floor=93.0).collect()
    assert len(got) == 2 and all("senior engineer|c|x" in (r.key, r.other) for r in got)
    stored = spark.createDataFrame([(1, "c", "senior engineers|c|x"), (2, "d", "painter|d|y")], "id long, company_normalized string, canonical_key string")
    rows = [(0, "c", "senior engineer|c|x"), (1, "d", "zoo keeper|d|q"), (2, "e", "zoo keeper|e|q")]
    best = fuzzy_best_match(spark.createDataFrame(rows, "arrival long, company_normalized string, canonical_key string"), stored)
    assert {(r.arrival, r.match_id, r.below_floor) for r in best.collect()} == {(0, 1, False), (1, 2, True), (2, None, False)}
