"""Entity resolution of a batch against the stored table, set-based and order-exact.

The rule is sequential: a row is inserted unless an *earlier inserted* row has its URL, its
key, or (same company) a key at or above the duplicate threshold. That is the
lexicographically first independent set of the conflict graph, and it is computed in
parallel rounds: a pending row is settled as soon as an earlier inserted conflict exists
(out) or no earlier pending one does (in). Conflicts by URL and key are never expanded to
pairs; the smallest arrival per URL and per key decides, so copies cost one row each.

No block is gathered into one task: every step is a partial aggregate or an equi-join that
AQE may split. Each round is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import json_build
from confluo.functions.text import canonical_key, norm_company, norm_url, strip, url_key, url_synth
from confluo.operators.similar import fresh_keys, mirrored, similar_keys
from confluo.schemas import EVENT_SCHEMA, JOB_SCHEMA, SOURCE_SCHEMA, STORED_JOB_SCHEMA, columns
from confluo.session import materialize, own_exchange

STORED_ARRIVAL = -1


@dataclass(frozen=True)
class Resolution:
    """``outcomes`` has one row per incoming row. ``inserted``, ``jobs``, ``sources`` and
    ``events`` are the new job rows, the full tables after the batch, and the new events."""

    outcomes: DataFrame
    inserted: DataFrame
    jobs: DataFrame
    sources: DataFrame
    events: DataFrame


def with_keys(incoming: DataFrame) -> DataFrame:
    """Adds the derived keys and the URL a row would be stored under.

    Normal forms are made once per distinct (title, company, location) and looked up.
    """
    empty = F.lit("")
    url = F.coalesce(F.col("url"), empty)
    texts = ["title", "company", "location"]
    key = canonical_key(F.col("title"), F.col("company"), F.col("location"))
    forms = incoming.select(*texts).distinct().select(
        *[F.col(c).alias(f"__{c}") for c in texts], key.alias("canonical_key"), norm_company(F.coalesce("company", empty)).alias("company_normalized")
    )
    same = F.lit(True)
    for c in texts:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return (
        incoming.join(own_exchange(materialize(forms, "normal-forms")), same)
        .drop(*[f"__{c}" for c in texts])
        .withColumn("stored_url", url_synth(url, F.col("source"), F.col("source_id"), F.col("canonical_key")))
        .withColumn("has_url", strip(url) != "")
        .withColumn("probe_url", F.when(F.col("has_url"), norm_url(url)).otherwise(F.col("stored_url")))
    )


def _settle(nodes: DataFrame, stored: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Nodes with ``inserted`` true or false. ``stored(company, key, url)`` counts as inserted."""
    key_cols = ["company_normalized", "canonical_key"]
    pending = nodes.select(*key_cols, "stored_url", "probe_url", "arrival")
    arrived = stored.select(*key_cols, "stored_url", F.lit(STORED_ARRIVAL).cast("bigint").alias("arrival"))
    done: DataFrame | None = None
    marks = [F.min(F.when(F.col("fixed"), F.col("arrival"))).alias("i"), F.min(F.when(~F.col("fixed"), F.col("arrival"))).alias("p")]
    while True:
        # a pending row is already known to have no conflict with rows fixed in earlier
        # rounds, so each round looks at the newly inserted and the pending rows only
        narrow = [*key_cols, "stored_url", "arrival"]
        live = pending.select(*narrow, F.lit(False).alias("fixed")).unionByName(
            arrived.select(*narrow, F.lit(True).alias("fixed"))
        )
        by_key = own_exchange(live.filter(F.col("canonical_key").isNotNull()).groupBy(*key_cols).agg(*marks))
        by_url = own_exchange(live.groupBy("stored_url").agg(*marks))
        joined = (
            pending.join(by_key.withColumnsRenamed({"i": "ki", "p": "kp"}), key_cols, "left")
            .join(by_url.withColumnsRenamed({"i": "ri", "p": "rp"}), "stored_url", "left")
            .join(by_url.withColumnsRenamed({"stored_url": "probe_url", "i": "ni", "p": "np"}), "probe_url", "left")
        )
        fixed_marks, pending_marks = ["ki", "ri", "ni"], ["kp", "rp", "np"]
        if edges is not None:
            near = (
                edges.join(by_key.withColumnRenamed("canonical_key", "other"), ["company_normalized", "other"])
                .groupBy(*key_cols)
                .agg(F.min("i").alias("ei"), F.min("p").alias("ep"))
            )
            joined = joined.join(near, key_cols, "left")
            fixed_marks, pending_marks = [*fixed_marks, "ei"], [*pending_marks, "ep"]
        earlier_fixed = F.coalesce(F.least(*fixed_marks) < F.col("arrival"), F.lit(False))
        earlier_pending = F.coalesce(F.least(*pending_marks) < F.col("arrival"), F.lit(False))
        verdict = F.when(earlier_fixed, F.lit(False)).when(~earlier_pending, F.lit(True))
        settled = materialize(
            joined.select(*key_cols, "stored_url", "probe_url", "arrival", verdict.alias("inserted")), "settle"
        )
        fixed = settled.filter(F.col("inserted").isNotNull())
        done = fixed if done is None else done.unionByName(fixed)
        arrived = settled.filter(F.col("inserted"))
        pending = settled.filter(F.col("inserted").isNull())
        if pending.isEmpty():
            return done


def resolve_outcomes(
    stored_jobs: DataFrame,
    stored_sources: DataFrame,
    incoming: DataFrame,
    *,
    duplicate_at: float = D.DUPLICATE_AT,
    review_at: float = D.REVIEW_AT,
    fuzzy: bool = True,
) -> DataFrame:
    """One row per incoming row: outcome, job, match, score, trust flip, and the keys.

    ``incoming`` needs a unique ``arrival`` that orders it, and ``source, source_id, url,
    title, company, location``.
    """
    key_cols = ["company_normalized", "canonical_key"]
    rows = materialize(
        with_keys(incoming).select("arrival", "source", *key_cols, "stored_url", "probe_url", "has_url"),
        "resolve-keys",
    )
    # rows with equal key and URL share their fate: only the first of them can be inserted
    nodes = rows.groupBy(*key_cols, "stored_url", "probe_url").agg(F.min("arrival").alias("arrival"))
    stored = stored_jobs.select(*key_cols, F.col("url").alias("stored_url"), "id")
    pairs = None
    if fuzzy:
        named = {"company_normalized": "block", "canonical_key": "key"}
        kept = stored.filter(F.col("canonical_key").isNotNull() & F.col("company_normalized").isNotNull())
        # pairs of two stored keys decide nothing: they are neither searched nor scored
        found = similar_keys(
            fresh_keys(nodes.select(*key_cols).withColumnsRenamed(named), kept.select(*key_cols).withColumnsRenamed(named)),
            floor=review_at,
        )
        pairs = materialize(
            mirrored(found).withColumnsRenamed({"block": "company_normalized", "key": "canonical_key"}), "edges"
        )
    edges = None if pairs is None else pairs.filter(F.col("score") >= duplicate_at)
    state = _settle(nodes, stored, edges)

    born = state.filter("inserted").select(
        *key_cols, "stored_url", "arrival", F.xxhash64("stored_url").alias("id"), F.lit(1).alias("gen")
    )
    jobs = materialize(
        born.unionByName(
            stored.select(
                *key_cols, "stored_url", F.lit(STORED_ARRIVAL).cast("bigint").alias("arrival"), "id", F.lit(0).alias("gen")
            )
        ),
        "resolve-jobs",
    )
    place = F.struct("gen", "arrival", "id").alias("place")
    by_url = jobs.groupBy("stored_url").agg(F.min(place).alias("u"))
    by_key = jobs.filter(F.col("canonical_key").isNotNull()).groupBy(*key_cols).agg(F.min(place).alias("k"))
    found = (
        rows.join(by_url.select(F.col("stored_url").alias("probe_url"), F.col("u").alias("un")), "probe_url", "left")
        .join(by_url.select("stored_url", F.col("u").alias("ur")), "stored_url", "left")
        .join(by_key, key_cols, "left")
    )

    def earlier(c: str) -> Column:
        return F.when(F.col(f"{c}.arrival") < F.col("arrival"), F.col(c))

    found = found.select(
        *rows.columns,
        F.coalesce(earlier("un"), earlier("ur")).alias("by_url"),
        earlier("k").alias("by_key"),
        F.coalesce(F.col("ur.arrival") == F.col("arrival"), F.lit(False)).alias("is_born"),
    )
    if pairs is not None:
        options = pairs.join(
            jobs.select("company_normalized", F.col("canonical_key").alias("other"), place), ["company_normalized", "other"]
        )
        # only rows that neither URL nor key settles look at their neighbours
        open_rows = found.filter(
            F.col("by_key").isNull() & (F.col("by_url").isNull() | ~F.col("has_url"))
        ).select("arrival", *key_cols)
        best = (
            open_rows.join(options, key_cols)
            .filter(F.col("place.arrival") < F.col("arrival"))
            .groupBy("arrival")
            .agg(
                F.min_by(
                    F.struct("place", "other", "score"), F.struct(-F.col("score"), F.col("place"))
                ).alias("near")
            )
        )
        found = found.join(best, "arrival", "left")
    else:
        found = found.withColumn(
            "near",
            F.lit(None).cast("struct<place:struct<gen:int,arrival:bigint,id:bigint>,other:string,score:double>"),
        )

    near_hit = F.when(F.col("near.score") >= duplicate_at, F.col("near.place.id"))
    via_url = F.when(F.col("has_url"), F.col("by_url.id"))
    via_urn = F.when(~F.col("has_url"), F.col("by_url.id"))
    born_id = F.when(F.col("is_born"), F.xxhash64("stored_url"))
    flagged = F.col("is_born") & F.coalesce(F.col("near.score") >= review_at, F.lit(False))
    matched = F.coalesce(via_url, F.col("by_key.id"), near_hit, via_urn)
    score = (
        F.when(F.col("is_born"), F.when(flagged, F.col("near.score")))
        .when(via_url.isNotNull(), F.lit(None).cast("double"))
        .when(F.col("by_key").isNotNull(), F.lit(100.0))
        .when(near_hit.isNotNull(), F.col("near.score"))
    )
    matched_key = (
        F.when(F.col("is_born"), F.when(flagged, F.col("near.other")))
        .when(via_url.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("by_key").isNotNull(), F.col("canonical_key"))
        .when(near_hit.isNotNull(), F.col("near.other"))
    )
    matches = materialize(
        found.select(
            "arrival",
            F.col("source").alias("source_name"),
            F.coalesce(born_id, matched).alias("job_id"),
            F.when(F.col("is_born"), F.when(flagged, F.col("near.place.id"))).otherwise(matched).alias("matched_job_id"),
            score.alias("fuzzy_score"),
            "is_born",
            flagged.alias("flagged"),
            *key_cols,
            matched_key.alias("matched_canonical_key"),
            "stored_url",
        ),
        "resolve-matches",
    )
    return _outcomes(matches, stored_sources)


def _outcomes(matches: DataFrame, stored_sources: DataFrame) -> DataFrame:
    pair = ["job_id", "source_name"]
    known = stored_sources.select(*pair).distinct().withColumn("known", F.lit(True))
    first = (
        matches.groupBy(*pair)
        .agg(F.min("arrival").alias("first"))
        .join(known, pair, "left")
        .withColumn("fresh", F.col("known").isNull())
        .drop("known")
    )
    labelled = matches.join(first, pair).withColumn(
        "outcome",
        F.when(F.col("flagged"), "review_flagged")
        .when(F.col("is_born"), "new_job")
        .when(F.col("fresh") & (F.col("first") == F.col("arrival")), "new_source")
        .otherwise("duplicate"),
    )
    # the first new source of a job with untrusted rows flips all of them
    doubtful = (
        stored_sources.filter(F.col("source_trust") == D.UNTRUSTED).select("job_id").distinct()
    )
    flips = (
        first.filter("fresh")
        .join(doubtful, "job_id", "left_semi")
        .groupBy("job_id")
        .agg(F.min("first").alias("flip_at"))
    )
    return labelled.join(flips, "job_id", "left").select(
        "arrival",
        "outcome",
        "job_id",
        "matched_job_id",
        "fuzzy_score",
        (F.coalesce(F.col("flip_at") == F.col("arrival"), F.lit(False)) & (F.col("outcome") == "new_source")).alias(
            "trust_flipped"
        ),
        "source_name",
        "company_normalized",
        "canonical_key",
        "matched_canonical_key",
        "stored_url",
    )


def apply_insert(incoming: DataFrame, outcomes: DataFrame, *, now: Column) -> DataFrame:
    """Full job rows of the inserted rows, with defaults and derived columns."""
    born = outcomes.filter(F.col("outcome").isin("new_job", "review_flagged")).select(
        "arrival", F.col("job_id").alias("id"), "company_normalized", "canonical_key", "stored_url"
    )
    have = set(incoming.columns)
    types = dict(part.split() for part in JOB_SCHEMA.split(", "))

    def given(c: str) -> Column:
        return (F.col(c) if c in have else F.lit(None)).cast(types[c])

    values = {c: given(c) for c in columns(JOB_SCHEMA)}
    values["url"] = F.col("stored_url")
    for c, default in (("title", ""), ("company", ""), ("salary_currency", "USD"), ("status", "new"), ("metadata", "{}")):
        values[c] = F.coalesce(values[c], F.lit(default))
    derived = {
        "url_hash": url_key(F.col("stored_url")),
        "linear_issue_id": F.lit(None).cast("string"),
        "date_first_seen": now,
        "date_last_seen": now,
        "created_at": now,
        "updated_at": now,
    }
    rows = incoming.drop("company_normalized", "canonical_key", "stored_url", "id").join(born, "arrival")
    full = rows.select("id", "company_normalized", "canonical_key", *[v.alias(c) for c, v in {**values, **derived}.items()])
    return full.select(*columns(STORED_JOB_SCHEMA))


def apply_provenance(
    stored_sources: DataFrame, outcomes: DataFrame, incoming: DataFrame | None = None, *, now: Column
) -> DataFrame:
    """Provenance after the batch: known pairs bump ``last_seen``, new pairs are added as
    trusted; the inserting row also keeps its URL and payload. Trust flips are applied."""
    pair = ["job_id", "source_name"]
    seen = outcomes.groupBy(*pair).agg(
        F.min(F.when(F.col("outcome").isin("new_job", "review_flagged"), F.col("arrival"))).alias("born")
    )
    if incoming is None:
        seen = seen.withColumns({c: F.lit(None).cast("string") for c in ("new_url", "new_payload")})
    else:
        payload = F.to_json(F.struct(*[c for c in incoming.columns if c != "arrival"]))
        first = incoming.select(
            F.col("arrival").alias("born"), F.col("url").alias("new_url"), payload.alias("new_payload")
        )
        seen = seen.join(first, "born", "left")
    merged = stored_sources.join(seen.withColumn("__seen", F.lit(True)), pair, "full_outer")
    old = F.col("first_seen").isNotNull() | F.col("last_seen").isNotNull() | F.col("source_trust").isNotNull()
    table = merged.select(
        *pair,
        F.coalesce("source_url", "new_url").alias("source_url"),
        F.coalesce("raw_payload", "new_payload").alias("raw_payload"),
        F.when(old, F.col("first_seen")).otherwise(now).alias("first_seen"),
        F.when(F.col("__seen"), now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("source_trust", F.lit(D.TRUSTED)).alias("source_trust"),
    )
    flipped = outcomes.filter("trust_flipped").select("job_id").distinct().withColumn("__flip", F.lit(True))
    return (
        table.join(flipped, "job_id", "left")
        .withColumn("source_trust", F.when(F.col("__flip"), D.TRUSTED).otherwise(F.col("source_trust")))
        .select(*columns(SOURCE_SCHEMA))
    )


def trust_flip(sources: DataFrame, new_sources: DataFrame) -> DataFrame:
    """Jobs with any untrusted row that gain a source become trusted throughout.

    ``new_sources(job_id, source_name)``; pairs already present do not count. Adds
    ``trust_flipped`` and returns the existing rows.
    """
    pair = ["job_id", "source_name"]
    gained = new_sources.select(*pair).join(sources.select(*pair), pair, "left_anti").select("job_id").distinct()
    doubtful = sources.filter(F.col("source_trust") == D.UNTRUSTED).select("job_id").distinct()
    flips = gained.join(doubtful, "job_id", "left_semi").withColumn("trust_flipped", F.lit(True))
    return sources.join(flips, "job_id", "left").withColumns(
        {
            "source_trust": F.when(F.col("trust_flipped"), D.TRUSTED).otherwise(F.col("source_trust")),
            "trust_flipped": F.coalesce("trust_flipped", F.lit(False)),
        }
    )


def review_events(outcomes: DataFrame, *, now: Column) -> DataFrame:
    """A ``possible_duplicate`` event per flagged row, with both ids, keys and the score."""
    detail = json_build(
        {
            "new_job_id": F.col("job_id"),
            "matched_job_id": F.col("matched_job_id"),
            "fuzzy_score": F.col("fuzzy_score"),
            "canonical_key_new": F.col("canonical_key"),
            "canonical_key_matched": F.col("matched_canonical_key"),
        },
        keep_nulls=True,
    )
    values = {
        "job_id": F.col("job_id"),
        "event_type": F.lit("possible_duplicate"),
        "occurred_at": now,
        "actor": F.lit("system"),
        "detail": detail,
    }
    return outcomes.filter(F.col("outcome") == "review_flagged").select(
        *[values[c].alias(c) for c in columns(EVENT_SCHEMA)]
    )


def telemetry_records(outcomes: DataFrame, *, now: Column) -> DataFrame:
    """One telemetry record per resolved row."""
    return outcomes.select(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        "outcome", "job_id", "matched_job_id", "source_name", "canonical_key", "fuzzy_score", "trust_flipped",
    )


def resolve_batch(
    stored_jobs: DataFrame,
    stored_sources: DataFrame,
    incoming: DataFrame,
    *,
    now: Column,
    duplicate_at: float = D.DUPLICATE_AT,
    review_at: float = D.REVIEW_AT,
    fuzzy: bool = True,
) -> Resolution:
    outcomes = resolve_outcomes(
        stored_jobs, stored_sources, incoming, duplicate_at=duplicate_at, review_at=review_at, fuzzy=fuzzy
    )
    outcomes = materialize(outcomes, "outcomes")
    inserted = apply_insert(incoming, outcomes, now=now)
    return Resolution(
        outcomes=outcomes,
        inserted=inserted,
        jobs=stored_jobs.select(*columns(STORED_JOB_SCHEMA)).unionByName(inserted),
        sources=apply_provenance(stored_sources, outcomes, incoming, now=now),
        events=review_events(outcomes, now=now),
    )


def resolve_exact_only(stored_jobs: DataFrame, stored_sources: DataFrame, incoming: DataFrame, *, now: Column) -> Resolution:
    """URL and key matches only."""
    return resolve_batch(stored_jobs, stored_sources, incoming, now=now, fuzzy=False)
