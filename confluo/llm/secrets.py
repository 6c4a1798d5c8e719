"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings (DataFrame functions only).

Positions without a UDF: the pieces between matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so running sums of their lengths are the match offsets.

Entropy: a candidate is a long run of one character class. A fold slides a window over it and
keeps the count of each character in the window; a step adds the entering and takes away the
leaving character, and corrects the sum of c·log2(c) by these two counts alone. The span from
the first to the last window at or above the class's threshold is reported, unless the candidate
holds an allow-listed text or meets a pattern match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import let, whole_text

# Fixed patterns (values of the contract), in report order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
MINIMUM = {"assign": 6, "access": 20, "hex": 24}
#: A text without a match of this has no passing match of its kind.
PRESENT = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one class, and the entropy (bits per character) a window of them must reach."""

    kind: str
    candidate: str
    alphabet: str
    threshold: float


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{20,}", DIGITS + "abcdef", 3.0),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", LOWER.upper() + LOWER + DIGITS + "+/_=-", 3.8),
)
WINDOW = 20
#: Texts that mark a candidate as harmless, compared in lower case.
ALLOWED = ("example", "sample", "placeholder", "changeme", "dummy", "xxxx", "0123456789abcdef", "abcdefghijklmnop", "1234567890")
KINDS = (*BASE, *(c.kind for c in CLASSES))
MASK = "<SECRET>"

_BLOCK = 512


def running_ends(lengths: Column) -> Column:
    """Running sums of an array of ints, in linear time: sums within blocks, shifted by sums of blocks."""

    def sums(values: Column, start: Column) -> Column:
        grown = F.aggregate(
            values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return F.slice(grown, F.lit(2), F.size(values))

    def blocks(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(_BLOCK))
        parts = F.transform(starts, lambda b: F.slice(values, b, F.lit(_BLOCK)))
        return let(parts, lambda p: let(
            F.concat(F.array(F.lit(0)), sums(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)), F.lit(0))),
            lambda offsets: F.flatten(F.zip_with(p, F.slice(offsets, F.lit(1), F.size(p)), sums)),
        ))

    return F.when(F.size(lengths) > 0, blocks(lengths)).otherwise(F.array().cast("array<int>"))


def matches_with_place(text: Column, pattern: str) -> Column:
    """array<struct<match, start>> of leftmost non-overlapping matches; code points, from 0."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return let(F.struct(found.alias("m"), between.alias("g")), lambda x: let(
        running_ends(F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: F.length(g) + F.length(m))),
        lambda ends: F.zip_with(x["m"], ends, lambda m, e: F.struct(m.alias("match"), (e - F.length(m)).alias("start"))),
    ))


def passes(kind: str, match: Column) -> Column:
    value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
    return F.length(value) >= MINIMUM[kind]


def _span(order: int, kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))


_SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one fixed pattern; failing matches are dropped without a retry."""
    kept = F.filter(matches_with_place(text, PATTERNS[kind]), lambda m: passes(kind, m["match"]))
    spans = F.transform(kept, lambda m: _span(BASE.index(kind), kind, m["start"], m["start"] + F.length(m["match"])))
    return F.when(text.rlike(PRESENT[kind]), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def hot_range(candidate: Column, cls: CharacterClass, window: int = WINDOW) -> Column:
    """struct<first, last>: from 0, the end exclusive; of windows at or above the threshold; null without one."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    text = F.lower(candidate) if cls.alphabet == cls.alphabet.lower() else candidate
    codes = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(cls.alphabet)) - 1)
    start = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def slide(codes: Column) -> Column:
        def step(acc: Column, at: Column) -> Column:
            enter = F.get(codes, at)
            leave = F.when(at >= window, F.get(codes, at - window)).otherwise(F.lit(-1))

            def moved(x: Column) -> Column:
                return F.struct(
                    F.when(x["enter"] == x["leave"], acc["counts"]).otherwise(
                        F.transform(acc["counts"], lambda c, i: c + (i == x["enter"]).cast("int") - (i == x["leave"]).cast("int"))
                    ).alias("counts"),
                    x["sum"].alias("sum"),
                    F.coalesce(acc["first"], F.when(x["hot"], at - window + 1)).alias("first"),
                    F.when(x["hot"], at + 1).otherwise(acc["last"]).alias("last"),
                )

            c_in, c_out = F.get(acc["counts"], enter), F.get(acc["counts"], leave)
            change = F.when(enter == leave, F.lit(0.0)).otherwise(
                F.get(table, c_in + 1) - F.get(table, c_in)
                + F.when(leave >= 0, F.get(table, c_out - 1) - F.get(table, c_out)).otherwise(F.lit(0.0))
            )
            total = acc["sum"] + change
            high = (at >= window - 1) & (F.lit(math.log2(window)) - total / window >= cls.threshold - 1e-9)
            return let(F.struct(enter.alias("enter"), leave.alias("leave"), total.alias("sum"), high.alias("hot")), moved)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)

    out = let(codes, slide)
    return let(out, lambda o: F.when(o["last"].isNotNull(), F.struct(o["first"].alias("first"), o["last"].alias("last"))))


def harmless(candidate: Column, cls: CharacterClass) -> Column:
    """Allow-listed texts; runs of letters only, or without letters, which are words and numbers."""
    low = F.lower(candidate)
    listed = F.lit(False)
    for text in ALLOWED:
        listed = listed | F.contains(low, F.lit(text))
    return listed | ~candidate.rlike("[0-9]") | ~candidate.rlike("[A-Za-z]")


def entropy_spans(text: Column, cls: CharacterClass) -> Column:
    """Spans of high-entropy candidates of one class, allow-listed ones left out."""
    order = KINDS.index(cls.kind)
    places = F.filter(matches_with_place(text, cls.candidate), lambda m: ~harmless(m["match"], cls))
    ranges = F.transform(places, lambda m: F.struct(m["start"].alias("start"), hot_range(m["match"], cls).alias("hot")))
    spans = F.transform(
        F.filter(ranges, lambda r: r["hot"].isNotNull()),
        lambda r: _span(order, cls.kind, r["start"] + r["hot"]["first"], r["start"] + r["hot"]["last"]),
    )
    return F.when(text.rlike(cls.candidate), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _apart(spans: Column, taken: Column) -> Column:
    """Spans that meet none of ``taken``."""
    return F.when(
        F.size(spans) > 0,
        F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))),
    ).otherwise(spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of (start, order, end, kind) by start, then kind."""
    whole = whole_text(text)
    rows = docs.withColumn("__base", F.array_sort(F.flatten(F.array(*[base_spans(whole, k) for k in BASE]))))
    rows = rows.withColumn("__more", F.array().cast(_SPANS))
    for cls in CLASSES:
        found = _apart(entropy_spans(whole, cls), F.concat("__base", "__more"))
        rows = rows.withColumn("__more", F.concat("__more", found))
    return rows.withColumn("__spans", F.array_sort(F.concat("__base", "__more"))).drop("__more")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, ends exclusive; a span of a pattern is its whole match. Null and
    empty texts have no span: base_sha256 is that of the empty string and spans is empty.
    Repeated rows give repeated results; extra columns are ignored.
    """
    rows = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(spans_text(F.col("__base")), 256).alias("base_sha256"),
        spans_text(F.col("__spans")).alias("spans"),
    )


def _masked(text: Column, pattern: str, hit) -> Column:
    """The text with matches that ``hit`` replaced by the mask, put together from pieces and matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    glue = F.zip_with(between, found, lambda g, m: F.concat(g, F.when(m.isNull(), "").when(hit(m), MASK).otherwise(m)))
    return F.array_join(glue, "")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by the mask and ``n_chars`` counted anew where text changed.

    Kinds are masked one after the other; a candidate with a hot window is masked whole.
    Texts without a span, null ones included, stay as they are.
    """
    columns = docs.columns
    rows = scan(docs)
    text = F.col("text")
    for kind in BASE:
        text = _masked(text, PATTERNS[kind], lambda m, kind=kind: passes(kind, m))
    for cls in CLASSES:
        text = _masked(text, cls.candidate, lambda m, cls=cls: ~harmless(m, cls) & hot_range(m, cls).isNotNull())
    rows = rows.withColumn("__clean", F.when(F.size("__spans") > 0, text).otherwise(F.col("text")))
    replaced = {"text": F.col("__clean")}
    if "n_chars" in columns:
        replaced["n_chars"] = F.when(F.size("__spans") > 0, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(replaced).select(*columns)
