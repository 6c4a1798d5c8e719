"""Text, URL and markup expressions. All are built-in expressions (JVM side, code-generated)."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.entities import unescape

# every character that counts as white space when a text is stripped
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _accent_pairs() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is one ASCII letter plus marks."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        decomposed = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in decomposed if unicodedata.category(c) != "Mn").lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_pairs()


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of ``key`` in a literal map, NULL when absent."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def strip(text: Column) -> Column:
    """Drop leading and trailing white space (any Unicode white space)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def strip_accents(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(plain)


def norm_base(text: Column) -> Column:
    """Lower case, no accents, only ``a-z 0-9 -``, single spaces."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(text)), r"[^a-z0-9\-]+", " "))


def norm_title(text: Column, *, mapping: Mapping[str, str] = D.TITLE_SYNONYMS) -> Column:
    words = F.split(norm_base(text), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(lookup(mapping, w), w)), " ")


def norm_company(
    name: Column,
    *,
    suffixes: Sequence[str] = D.COMPANY_SUFFIXES,
    aliases: Mapping[str, str] = D.COMPANY_ALIASES,
) -> Column:
    """Base form without one trailing legal suffix; aliases are tried before and after."""
    base = norm_base(name)
    bare = F.regexp_replace(base, r"\s+(?:" + "|".join(suffixes) + r")$", "")
    if not aliases:
        return bare
    return F.coalesce(lookup(aliases, base), lookup(aliases, bare), bare)


def norm_location(text: Column, *, mapping: Mapping[str, str] = D.LOCATION_ALIASES) -> Column:
    base = norm_base(text)
    return F.coalesce(lookup(mapping, base), base)


def canonical_key(title: Column, company: Column, location: Column) -> Column:
    """``title|company|location`` of the three normal forms; NULL parts are empty."""
    empty = F.lit("")
    return F.concat_ws(
        "|",
        norm_title(F.coalesce(title, empty)),
        norm_company(F.coalesce(company, empty)),
        norm_location(F.coalesce(location, empty)),
    )


def norm_name_simple(name: Column, *, collapse: bool = True) -> Column:
    text = F.lower(strip(name))
    return F.regexp_replace(text, r"\s+", " ") if collapse else text


def norm_url(url: Column) -> Column:
    text = F.lower(strip(url))
    shorter = F.left(text, F.char_length(text) - 1)
    return F.when(text.endswith("/"), shorter).otherwise(text)


def url_key(url: Column) -> Column:
    """md5 of the lower-cased URL without one trailing slash."""
    return F.md5(norm_url(url))


def url_synth(url: Column, source: Column, source_id: Column, key: Column) -> Column:
    """The URL itself, or a stable URN for rows that have none."""
    ident = F.coalesce(F.nullif(source_id, F.lit("")), F.left(F.sha1(key), F.lit(12)))
    urn = F.concat(F.lit(f"{D.URN_PREFIX}:"), source, F.lit(":"), ident)
    return F.when(strip(F.coalesce(url, F.lit(""))) == "", urn).otherwise(url)


def remote_flag(location: Column, title: Column | None = None, *, variant: str = "location") -> Column:
    """Remote heuristics.

    ``location``: word in the location, NULL stays NULL. ``location_or_title``: word in
    either, else NULL. ``substring``: plain containment in either, else NULL. ``phrases``:
    a fixed phrase set in free text, true or false.
    """
    if variant == "location":
        return location.rlike(D.REMOTE_WORD)
    if variant == "phrases":
        return F.coalesce(location, F.lit("")).rlike(D.REMOTE_PHRASES)
    texts = [F.coalesce(t, F.lit("")) for t in (location, title) if t is not None]
    if variant == "location_or_title":
        hits = [t.rlike(D.REMOTE_WORD) for t in texts]
    elif variant == "substring":
        hits = [F.lower(t).contains("remote") for t in texts]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    hit = hits[0]
    for other in hits[1:]:
        hit = hit | other
    return F.when(hit, F.lit(True))


def job_type_map(commitment: Column) -> Column:
    text = F.lower(commitment)
    return (
        F.when(commitment.isNull() | (commitment == ""), F.lit(None).cast("string"))
        .when(text.contains("part"), "part_time")
        .when(text.contains("contract") | text.contains("intern"), "contract")
        .otherwise("full_time")
    )


def ts_coerce(value: Column, *, kind: str = "text") -> Column:
    """``timestamp`` | ``epoch`` (seconds, NaN → NULL) | ``text`` (unparsable → NULL) → UTC time."""
    if kind == "timestamp":
        return value.cast("timestamp_ntz")
    if kind == "epoch":
        seconds = value.try_cast("double")
        moment = F.timestamp_micros((F.when(~F.isnan(seconds), seconds) * F.lit(1e6)).cast("bigint"))
    elif kind == "text":
        moment = F.try_to_timestamp(value)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return F.convert_timezone(None, F.lit("UTC"), moment.cast("timestamp_ntz"))


def html_unescape(text: Column, *, full: bool = True) -> Column:
    """Resolve character references: the whole standard table with numeric and unterminated
    references, or the common ones only."""
    if full:
        return unescape(text)
    for name, char in D.HTML_ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_strip(html: Column, *, mode: str = "comment", full_entities: bool = True) -> Column:
    """Markup to text. ``comment``: unescape, paragraphs become lines. ``post``: block tags
    become lines, references stay."""
    if mode == "comment":
        text = F.regexp_replace(html_unescape(html, full=full_entities), "<p>", "\n")
        return strip(F.regexp_replace(text, "<[^>]+>", ""))
    if mode == "post":
        text = F.regexp_replace(html, r"(?i)<br\s*/?>|<p[^>]*>|</p>|<li[^>]*>", "\n")
        return F.regexp_replace(text, "<[^>]+>", "")
    raise ValueError(f"unknown mode {mode!r}")


LINK_PATTERNS = {"a": r'<a\s+href="([^"]+)"', "img": r'(?i)<img[^>]+src="([^"]+)"'}


def html_links(html: Column, *, tag: str = "a", pattern: str | None = None, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(html, F.lit(pattern or LINK_PATTERNS[tag]), F.lit(1))
    return found if limit is None else F.slice(found, 1, limit)


def url_domain_stem(website: Column) -> Column:
    """Second-level label of the host; the scheme is optional."""
    host = F.lower(F.regexp_extract(website, r"^(?:[^:/?#]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    return F.nullif(
        F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(F.get(labels, F.lit(0))),
        F.lit(""),
    )


def slug_candidates(name: Column, website: Column) -> Column:
    """Ordered distinct slugs: collapsed, hyphenated, first word, domain stem."""
    text = F.lower(strip(F.coalesce(name, F.lit(""))))
    collapsed = F.regexp_replace(text, "[^a-z0-9]+", "")
    hyphens = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9-]+", "-"), "-+", "-")
    first = F.regexp_replace(F.get(F.split(text, r"\s+"), F.lit(0)), "[^a-z0-9]+", "")
    parts = F.array(collapsed, F.trim(hyphens, F.lit("-")), first, url_domain_stem(website))
    return F.array_distinct(F.filter(parts, lambda s: s.isNotNull() & (s != "")))


def url_numeric_id(url: Column, *, pattern: str = D.JOB_ID_PATTERN) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)


def place_to_text(place: Column) -> Column:
    """VARIANT holding a text, a place object or a list of them → ``locality, region, country``."""

    def one(v: Column) -> Column:
        def text(path: str) -> Column:
            return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))

        address = F.concat_ws(
            ", ",
            *[text(f"$.address.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")],
        )
        has_address = F.schema_of_variant(F.try_variant_get(v, "$.address", "variant")).startswith("OBJECT")
        return (
            F.when(F.schema_of_variant(v) == "STRING", text("$"))
            .when(has_address, F.nullif(address, F.lit("")))
            .otherwise(text("$.name"))
        )

    first = F.try_variant_get(place, "$[0]", "variant")
    return F.when(F.schema_of_variant(place).startswith("ARRAY"), one(first)).otherwise(one(place))


def text_blob(
    title: Column,
    company: Column,
    location: Column,
    description: Column,
    *,
    description_chars: int | None = None,
) -> Column:
    """One lower-case text per row; NULL reads ``none``. ``description_chars=None`` keeps all."""
    none = F.lit("None")
    body = F.coalesce(description, none)
    if description_chars is not None:
        body = F.substring(body, 1, description_chars)
    parts = [F.coalesce(c, none) for c in (title, company, location)]
    return F.lower(F.concat_ws(" ", *parts, body))
