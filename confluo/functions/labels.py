"""Labels, classes, scores and composed texts as expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.text import lookup, strip


def _case(pairs: Sequence[tuple[Column, Column]], default: Column) -> Column:
    chain = None
    for condition, value in pairs:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return default if chain is None else chain.otherwise(default)


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``body`` over values that are computed once per row.

    Without it the optimizer copies a long text expression into each of many tests, and the
    generated code outgrows a method.
    """
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(row), body), F.lit(0))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def ignore_case(pattern: str) -> str:
    return pattern if pattern.startswith("(?i)") else f"(?i){pattern}"


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern matches: one alternation, so the text is scanned once. Word
    boundaries that all patterns share are tested once per position."""
    if not patterns:
        return F.lit(False)
    edge = r"\b"
    if all(p.startswith(edge) and p.endswith(edge) and len(p) > 4 for p in patterns):
        return text.rlike(f"(?i){edge}(?:" + "|".join(f"(?:{p[2:-2]})" for p in patterns) + f"){edge}")
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def regex_ladder(text: Column, *, ladder: Sequence[tuple[str, str]] = D.COMMENT_LADDER) -> Column:
    """Label of the first pattern that matches, else NULL."""
    pairs = [(text.rlike(ignore_case(p)), F.lit(label)) for p, label in ladder]
    return _case(pairs, F.lit(None).cast("string"))


def label_map(value: Column, *, mapping: Mapping[str, str] = D.STATE_EVENTS) -> Column:
    return lookup(mapping, value)


def keyword_array(
    text: Column, fallback: Column | None = None, *, patterns: Sequence[tuple[str, str]] = D.SKILL_PATTERNS
) -> Column:
    """Names whose pattern occurs, in list order; the fallback text is used when none do."""

    def found(t: Column) -> Column:
        t = F.coalesce(t, F.lit(""))
        return F.array_compact(F.array(*[F.when(t.rlike(ignore_case(p)), F.lit(n)) for n, p in patterns]))

    first = found(text)
    return first if fallback is None else F.when(F.size(first) > 0, first).otherwise(found(fallback))


def substring_map_first(text: Column, *, pairs: Sequence[tuple[str, str]] = D.ROLE_PHRASES) -> Column:
    def first(v: Column) -> Column:
        return _case([(v["low"].contains(k), F.lit(x)) for k, x in pairs], F.lit(None).cast("string"))

    return let({"low": F.lower(strip(text))}, first)


def priority_class(
    text: Column, *, classes: Sequence[tuple[Sequence[str], int]], default: int
) -> Column:
    def ranked(v: Column) -> Column:
        return _case([(contains_any(v["low"], names), F.lit(rank)) for names, rank in classes], F.lit(default))

    return let({"low": F.lower(F.coalesce(text, F.lit("")))}, ranked)


def source_priority(source: Column) -> Column:
    return priority_class(source, classes=D.SOURCE_PRIORITY, default=D.SOURCE_PRIORITY_DEFAULT)


def role_priority(title: Column) -> Column:
    return priority_class(title, classes=D.ROLE_PRIORITY, default=D.ROLE_PRIORITY_DEFAULT)


def score_tier(score: Column, *, tiers: Sequence[tuple[float, str]] = D.SCORE_TIERS, default: str = D.SCORE_TIER_DEFAULT) -> Column:
    value = F.coalesce(score, F.lit(0.0))
    return _case([(value >= F.lit(floor), F.lit(label)) for floor, label in tiers], F.lit(default))


def title_bonus(
    title: Column,
    *,
    patterns: Sequence[str] = D.BONUS_PATTERNS,
    pattern_bonus: float = D.PATTERN_BONUS,
    substrings: Sequence[tuple[str, float]] = D.SUBSTRING_BONUSES,
) -> Column:
    low = F.lower(strip(F.coalesce(title, F.lit("None"))))
    total = F.when(any_pattern(low, patterns), F.lit(pattern_bonus)).otherwise(F.lit(0.0))
    for needle, bonus in substrings:
        total = total + F.when(low.contains(needle), F.lit(bonus)).otherwise(F.lit(0.0))
    return total


def blurb(
    title: Column,
    company: Column,
    description: Column,
    *,
    matched: Column,
    tier: Column,
    skills: Sequence[tuple[str, str]] = D.SKILL_PATTERNS,
    phrases: Sequence[tuple[str, str]] = D.ROLE_PHRASES,
    founding: str = D.FOUNDING_PATTERN,
) -> Column:
    """Two or three sentences on why a row is of interest. ``matched`` and ``tier`` come
    from a join with the reference list."""
    title = strip(F.coalesce(title, F.lit("")))
    company = strip(F.coalesce(company, F.lit("")))
    tier_text = F.when(F.coalesce(tier, F.lit("")) != "", F.concat(F.lit(" ("), tier, F.lit(" reference company)")))
    fit = F.when(
        matched, F.concat(F.lit("is a"), F.coalesce(tier_text, F.lit(" (reference company)")), F.lit(" match"))
    ).otherwise(F.lit("aligns with the target profile"))
    stage = F.when(
        title.rlike(ignore_case(founding)), F.lit("and this is a founding/early-stage role")
    ).otherwise(F.lit("where technical and commercial instincts are assets"))
    opening = F.concat(F.concat_ws(" ", F.concat(title, F.lit(" at "), company), fit, stage), F.lit("."))
    mapping = F.concat(F.coalesce(substring_map_first(title, pairs=phrases), F.lit(D.ROLE_PHRASE_DEFAULT)), F.lit("."))
    names = keyword_array(description, F.concat_ws(" ", title, company), patterns=skills)
    overlap = F.when(
        F.size(names) > 0, F.concat(F.lit("Direct stack overlap: "), F.array_join(names, ", "), F.lit("."))
    )
    return F.concat_ws(" ", opening, mapping, overlap)


def card_title(title: Column, company: Column) -> Column:
    empty = F.lit("")
    return F.concat(strip(F.coalesce(title, empty)), F.lit(" @ "), strip(F.coalesce(company, empty)))


def card_key(title: Column, company: Column) -> Column:
    return F.lower(strip(card_title(title, company)))


def card_body(blurb_text: Column, score: Column, source: Column, location: Column, is_remote: Column, url: Column) -> Column:
    """Multi-line card text."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{label}:** "), F.coalesce(value.cast("string"), F.lit("")))

    remote = F.when(F.coalesce(is_remote, F.lit(False)), "yes").otherwise("no")
    return F.concat_ws(
        "\n",
        F.lit("**💡 Why Interesting**"), F.lit(""), blurb_text, F.lit(""), F.lit("---"),
        line("Score", score), line("Source", source), line("Location", location),
        line("Remote", remote), F.lit(""), line("URL", url), F.lit(""),
        F.lit("_Auto-pushed from the ranked list_"),
    )


def media_sniff(content: Column) -> Column:
    """MIME type by magic bytes."""
    head = F.hex(F.substring(content, 1, 12))
    pairs = [(F.left(head, F.lit(2 * n)) == magic, F.lit(mime)) for magic, n, mime in D.IMAGE_MAGIC]
    webp = (F.left(head, F.lit(8)) == "52494646") & (F.substring(head, 17, 8) == "57454250")
    return _case([*pairs, (webp, F.lit("image/webp"))], F.lit(D.IMAGE_DEFAULT))


def json_build(fields: Mapping[str, Column], *, keep_nulls: bool = False) -> Column:
    """JSON object text; keys with NULL values are left out unless ``keep_nulls``."""
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), options)


def json_decode(text: Column) -> Column:
    """VARIANT of a JSON text, NULL when it cannot be decoded."""
    return F.try_parse_json(text)
