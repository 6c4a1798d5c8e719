"""Postings in landed HTML pages: structured data first, link cards as fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.labels import json_build, let
from confluo.functions.text import place_to_text, remote_flag, strip, url_numeric_id
from confluo.operators.dedup import first_by
from confluo.sources.boards import _filled, _kind, _list, canonical

_BLOCK = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
# The text looked at around a link, and the length from which a word is no name.
_BEFORE, _AFTER, _SHORT = 50, 600, 60

#: Links whose lengths are summed one after the other, and characters of a piece of a page.
_RUN, _PIECE = 256, 4096
_BLOCK_STEP = 1_000_000  # entries that a block of structured data has at most, for positions


def _row(rows: DataFrame, keep: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    ident = values["source_id"]
    return canonical(
        rows,
        {
            "source": F.lit("wellfound"),
            **values,
            "title": F.coalesce(values["title"], F.lit("Unknown")),
            "company": F.coalesce(values["company"], F.lit("Unknown")),
            "metadata": json_build({"wellfound_job_id": ident}, keep_nulls=True),
        },
        keep=keep,
    )


def _structured(html: Column) -> Column:
    """``array<struct<pos, p>>``: the job postings among a page's structured data, in order."""

    def entries(json: Column, block: Column) -> Column:
        doc = F.try_parse_json(strip(json))
        found = F.when(_kind(doc, "$").startswith("ARRAY"), _list(doc, "$")).otherwise(F.array(doc))
        return F.transform(
            F.coalesce(found, F.array().cast("array<variant>")), lambda p, i: F.struct((block.cast("bigint") * _BLOCK_STEP + i).alias("pos"), p.alias("p"))
        )

    all_ = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1)), entries))
    return F.filter(all_, lambda e: F.coalesce(F.try_variant_get(e["p"], '$["@type"]', "string") == "JobPosting", F.lit(False)))


def _posting_values(p: Column) -> dict[str, Column]:
    url = F.coalesce(_filled(p, "$.url"), F.lit(""))
    title = _filled(p, "$.title")
    location = place_to_text(F.try_variant_get(p, "$.jobLocation", "variant"))
    home = F.upper(F.coalesce(_filled(p, "$.jobLocationType"), F.lit(""))) == "TELECOMMUTE"
    return {
        "source_id": url_numeric_id(url),
        "url": url,
        "title": title,
        "company": F.coalesce(_filled(p, "$.hiringOrganization.name"), _filled(p, "$.hiringOrganization")),
        "location": location,
        "description": _filled(p, "$.description"),
        "is_remote": F.when(home, F.lit(True)).otherwise(remote_flag(location, title, variant="location_or_title")),
        "job_type": F.lower(_filled(p, "$.employmentType")),
    }


def src_html_jsonld(pages: DataFrame) -> DataFrame:
    """Input ``page_id, html``. Blocks that do not parse are skipped; a block may hold one
    object or a list. Adds ``page_id, pos``."""
    rows = pages.select("page_id", F.inline(_structured(F.col("html"))))
    return _row(rows, ("page_id", "pos"), _posting_values(F.col("p")))


def _starts(lengths: Column) -> Column:
    """Where each of ``array<struct<gap, link>>`` lengths' links starts: running sums of runs,
    then of the runs' totals, so the work is in proportion to the number of links."""

    def run(k: Column) -> Column:
        return F.aggregate(
            F.slice(lengths, k * _RUN + 1, F.lit(_RUN)),
            F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")),
            lambda acc, s: F.struct(
                (acc["end"] + s["gap"] + s["link"]).alias("end"), F.concat(acc["at"], F.array(acc["end"] + s["gap"])).alias("at")
            ),
        )

    def placed(v: Column) -> Column:
        before = F.aggregate(
            v["runs"],
            F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at")),
            lambda acc, r: F.struct((acc["sum"] + r["end"]).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at")),
            lambda acc: acc["at"],
        )
        return F.flatten(F.zip_with(v["runs"], before, lambda r, base: F.transform(r["at"], lambda x: x + base)))

    count = F.ceil(F.size(lengths) / _RUN).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return let({"runs": F.transform(numbers, run)}, placed)


def link_windows(html: Column, pattern: str) -> Column:
    """Per link the match, and the text window around it, as an array of structs.

    Offsets come from the pieces between matches, and windows are cut out of short pieces of
    the page, so a page is scanned a fixed number of times whatever its number of links.
    """
    links = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    gaps = F.split(html, pattern, -1)
    lengths = F.zip_with(
        links, F.slice(gaps, F.lit(1), F.size(links)), lambda a, g: F.struct(F.char_length(g).alias("gap"), F.char_length(a).alias("link"))
    )
    pieces = F.regexp_extract_all(html, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def windows(v: Column) -> Column:
        def window(link: Column, at: Column) -> Column:
            first = F.greatest(at - _BEFORE, F.lit(0))
            last = at + F.char_length(link) + _AFTER
            piece = F.floor(first / _PIECE).cast("int")
            near = F.array_join(F.slice(v["pieces"], piece + 1, F.floor(last / _PIECE).cast("int") - piece + 1), "")
            return F.struct(link.alias("link"), F.substring(near, first - piece * _PIECE + 1, last - first).alias("window"))

        return F.zip_with(v["links"], _starts(v["lengths"]), window)

    return let({"links": links, "lengths": lengths, "pieces": pieces}, windows)


def _card_values(link: Column, window: Column, *, pattern: str, base_url: str) -> dict[str, Column]:
    """Company and location are the 2nd and 3rd word of the window."""
    path = F.regexp_extract(link, pattern, 1)
    at = F.instr(window, F.concat(F.lit('href="'), path, F.lit('"')))
    tail = F.substring(window, at + F.char_length(path) + 7, F.char_length(window))
    inner = F.regexp_extract(tail, r"(?s)^[^>]*>(.*?)</a>", 1)
    title = F.nullif(strip(F.regexp_replace(F.regexp_replace(inner, "<[^>]+>", ""), r"\s+", " ")), F.lit(""))
    clean = strip(F.regexp_replace(F.regexp_replace(window, "<[^>]+>", " "), r"\s+", " "))
    words = F.filter(F.split(clean, " "), lambda w: w != "")

    def word(i: int) -> Column:
        w = F.get(words, F.lit(i))
        return F.when((F.size(words) > 2) & (F.char_length(w) < _SHORT), w)

    return {"url": F.concat(F.lit(base_url), path), "title": title, "company": word(1), "location": word(2)}


def _cards(rows: DataFrame, keep: tuple[str, ...], *, pattern: str, base_url: str) -> DataFrame:
    """Adds what a card says, once per row, as ``u, t, co, lo``."""
    said = _card_values(F.col("link"), F.col("window"), pattern=pattern, base_url=base_url)
    return rows.select(*keep, said["url"].alias("u"), said["title"].alias("t"), said["company"].alias("co"), said["location"].alias("lo"))


def _said(id_pattern: str) -> dict[str, Column]:
    return {
        "source_id": url_numeric_id(F.col("u"), pattern=id_pattern),
        "url": F.col("u"),
        "title": F.col("t"),
        "company": F.col("co"),
        "location": F.col("lo"),
        "is_remote": remote_flag(F.col("lo"), F.col("t"), variant="location_or_title"),
    }


def src_html_link_cards(
    pages: DataFrame, *, pattern: str = D.JOB_LINK_PATTERN, base_url: str = D.CARD_BASE_URL, id_pattern: str = D.JOB_ID_PATTERN
) -> DataFrame:
    """One row per link that matches; company and location are the 2nd and 3rd word of the
    window. Adds ``page_id, pos``."""
    found = pages.select("page_id", F.posexplode(link_windows(F.col("html"), pattern)).alias("pos", "c")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "c.link", "c.window"
    )
    rows = _cards(found, ("page_id", "pos"), pattern=pattern, base_url=base_url)
    return _row(rows, ("page_id", "pos"), _said(id_pattern))


def src_html_first_nonempty(
    pages: DataFrame, *, pattern: str = D.JOB_LINK_PATTERN, base_url: str = D.CARD_BASE_URL, id_pattern: str = D.JOB_ID_PATTERN
) -> DataFrame:
    """Structured data where a page has any, else its link cards; first row per URL over
    all pages in page order. Each page is read once and decides for itself."""
    html = F.col("html")

    def either(v: Column) -> Column:
        kind = "array<struct<pos:bigint,p:variant,link:string,window:string>>"
        postings = F.transform(
            v["ld"], lambda e: F.struct(e["pos"].alias("pos"), e["p"].alias("p"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("window"))
        )
        cards = F.transform(
            link_windows(v["html"], pattern),
            lambda c, i: F.struct(i.cast("bigint").alias("pos"), F.lit(None).cast("variant").alias("p"), c["link"].alias("link"), c["window"].alias("window")),
        )
        return F.when(F.size(v["ld"]) > 0, postings.cast(kind)).otherwise(cards.cast(kind))

    found = pages.select("page_id", F.inline(let({"ld": _structured(html), "html": html}, either)))
    rows = _cards(found, ("page_id", "pos", "p"), pattern=pattern, base_url=base_url)
    posting, card = _posting_values(F.col("p")), _said(id_pattern)
    values = {c: F.when(F.col("p").isNotNull(), v).otherwise(card.get(c, F.lit(None))) for c, v in posting.items()}
    first = _row(rows, ("page_id", "pos"), values).filter(F.col("url") != "")
    return first_by(first, keys=["url"], order=[F.col("page_id"), F.col("pos")])
