"""Row gates. All are null-safe booleans (or the matching pattern) over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import _case, any_pattern, contains_any, ignore_case, let
from confluo.functions.text import strip

_NONE = "None"


def _low(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(_NONE))))


def first_pattern_title(title: Column, *, patterns: Sequence[str] = D.TITLE_EXCLUSIONS) -> Column:
    """The first pattern that matches (its text), else NULL."""
    text = F.coalesce(title, F.lit(""))
    return _case([(text.rlike(ignore_case(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def first_pattern_title_location(
    title: Column, location: Column, *, patterns: Sequence[str] = D.GEO_EXCLUSIONS
) -> Column:
    empty = F.lit("")
    text = F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(location, empty))
    return first_pattern_title(text, patterns=patterns)


def whitelist_exact(company: Column, *, names: Sequence[str] = D.REMOTE_FIRST_COMPANIES) -> Column:
    return F.lower(F.coalesce(company, F.lit(""))).isin([n.lower() for n in names])


def remote_gate(is_remote: Column, location: Column, *, blockers: Sequence[str] = D.NON_REMOTE_MARKERS) -> Column:
    """Explicit flag passes; an on-site marker fails; a remote word passes; else fail."""
    place = F.lower(F.coalesce(location, F.lit("")))
    return (
        F.when(F.coalesce(is_remote, F.lit(False)), F.lit(True))
        .when(contains_any(place, blockers), F.lit(False))
        .otherwise(contains_any(place, ("remote", "anywhere")))
    )


def remote_gate_or_whitelist(
    company: Column,
    is_remote: Column,
    location: Column,
    *,
    names: Sequence[str] = D.REMOTE_FIRST_COMPANIES,
    blockers: Sequence[str] = D.NON_REMOTE_MARKERS,
) -> Column:
    return whitelist_exact(company, names=names) | remote_gate(is_remote, location, blockers=blockers)


def geo_gate(
    title: Column,
    location: Column,
    description: Column,
    is_remote: Column,
    *,
    accept: Sequence[str] = D.GEO_ACCEPT,
    reject: Sequence[str] = D.GEO_REJECT,
    description_chars: int | None = None,
    whole_words: bool = False,
) -> Column:
    """Reject list first, then accept list, then the remote flag. The lists are substrings
    unless ``whole_words``; ``description_chars=None`` looks at the whole description."""
    body = F.lower(F.coalesce(description, F.lit(_NONE)))
    if description_chars is not None:
        body = F.substring(body, 1, description_chars)

    def hit(text: Column, words: Sequence[str]) -> Column:
        if whole_words:
            return any_pattern(text, [rf"(?<!\w)\Q{w}\E(?!\w)" for w in words])
        return contains_any(text, words)

    def verdict(v: Column) -> Column:
        return (
            F.when(hit(v["text"], reject), F.lit(False)).when(hit(v["text"], accept), F.lit(True)).otherwise(v["flag"])
        )

    text = F.concat_ws(" ", _low(title), _low(location), body)
    return let({"text": text, "flag": F.coalesce(is_remote, F.lit(False))}, verdict)


def curated_title_hit(title: Column, *, titles: Sequence[str] = D.TARGET_TITLES) -> Column:
    """The title contains, or is contained in, a listed title. An empty title passes."""
    def listed(v: Column) -> Column:
        hit = F.lit(False)
        for name in titles:
            hit = hit | v["low"].contains(name.lower()) | F.lit(name.lower()).contains(v["low"])
        return hit

    return let({"low": _low(title)}, listed)


def relevant(
    title: Column,
    company: Column,
    location: Column,
    description: Column,
    is_remote: Column,
    text: Column,
    *,
    accept: Sequence[str] = D.GEO_ACCEPT,
    reject: Sequence[str] = D.GEO_REJECT,
    exclude: Sequence[str] = D.EXCLUDE_PATTERNS,
    include: Sequence[str] = D.INCLUDE_PATTERNS,
    titles: Sequence[str] = D.TARGET_TITLES,
    geo_chars: int | None = None,
) -> Column:
    """Conjunction of all relevance gates over one row."""
    named = ~_low(company).isin(list(D.SENTINEL_COMPANIES))
    near = geo_gate(
        title, location, description, is_remote, accept=accept, reject=reject, description_chars=geo_chars
    )

    def wanted(v: Column) -> Column:
        return ~any_pattern(v["body"], exclude) & (v["curated"] | any_pattern(v["body"], include))

    body = F.concat_ws(" ", _low(title), text)
    topic = let({"body": body, "curated": curated_title_hit(title, titles=titles)}, wanted)
    return named & near & topic


def decide(
    score: Column,
    title: Column,
    company: Column,
    location: Column,
    is_remote: Column,
    *,
    threshold: float = D.DECISION_THRESHOLD,
    title_patterns: Sequence[str] = D.TITLE_EXCLUSIONS,
    geo_patterns: Sequence[str] = D.GEO_EXCLUSIONS,
    names: Sequence[str] = D.REMOTE_FIRST_COMPANIES,
) -> tuple[Column, Column]:
    """``(decision, reason)``; first rule wins: title, geo, score, remote or whitelist, rest."""
    by_title = first_pattern_title(title, patterns=title_patterns)
    by_geo = first_pattern_title_location(title, location, patterns=geo_patterns)
    remote = remote_gate(is_remote, location)
    decision = (
        F.when(by_title.isNotNull(), "rejected_title")
        .when(by_geo.isNotNull(), "rejected_geo")
        .when(score < F.lit(threshold), "rejected")
        .when(remote, "promoted")
        .when(whitelist_exact(company, names=names), "promoted_whitelist_remote")
        .otherwise("shortlisted")
    )
    return decision, F.coalesce(by_title, by_geo)
