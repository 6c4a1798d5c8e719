"""Document fingerprints of closed syncmers (DataFrame functions only).

A text is a sequence of units: words, and of a run of more than ``UNIT`` code points without a
blank (text of a script without blanks, long encoded lines) all pieces of ``PIECE`` code points,
one from each code point on, so that no unit depends on where the run began. Each k-mer of
units is looked at on its own: it is an anchor if the smallest hash of its inner s-mers lies at
its first or last place. The choice needs no neighbours, so equal passages give equal anchors
wherever they stand, and two anchors are at most ``K - S`` units apart in any text.

A fingerprint lists the anchors in text order: eight hex digits each, being 1, the distance to
the anchor before (one digit, 0 where it is 16 or more or there is none) and 24 bits of the
k-mer's hash. The likeness of two texts is the Jaccard similarity of two kinds of evidence taken
together: their anchors, and their pairs of successive anchors with the distance between them,
which hold only where both texts keep the same order and spacing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import let, whole_text
from confluo.session import materialize

K, S, UNIT, PIECE = 5, 2, 16, 8
#: Code points that one group of neighbouring documents aims at, and the most groups.
GROUP_CHARS, MOST_GROUPS = 8_000_000, 4096
_BLOCK = 64
_WORD = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{UNIT}}}(?![^\x20\x09-\x0D])"
#: The unit is the group that looks ahead; then a word is passed as a whole, of a long run one code point.
_UNITS = rf"(?=({_WORD}|[^\x20\x09-\x0D]{{{PIECE}}}))(?:{_WORD}|[^\x20\x09-\x0D])"


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """struct<at: array<int>, key: array<bigint>>: unit index and hash of each anchor.

    A text of fewer than k units but one at least has one anchor, all its units.
    """
    units = F.transform(F.regexp_extract_all(text, F.lit(_UNITS), F.lit(1)), lambda u: F.xxhash64(u))
    m = k - s  # the inner s-mers of the k-mer at i start at i … i + m

    def inner(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)])
        )

    def chosen(h: Column) -> Column:
        return let(inner(h), lambda g: F.filter(
            F.sequence(F.lit(0), F.size(h) - k),
            lambda i: F.least(F.get(g, i), F.get(g, i + m)) <= F.least(*[F.get(g, i + j) for j in range(1, m)]),
        ))

    def keyed(h: Column) -> Column:
        return let(chosen(h), lambda at: F.struct(
            at.alias("at"), F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])).alias("key")
        ))

    none = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<bigint>").alias("key"))
    return let(units, lambda h: F.when(F.size(h) >= k, keyed(h)).when(
        F.size(h) > 0, F.struct(F.array(F.lit(0)).alias("at"), F.array(F.xxhash64(h)).alias("key"))
    ).otherwise(none))


def _gaps(at: Column) -> Column:
    """Distance of each anchor to the one before; 0 for the first."""
    return F.zip_with(at, F.concat(F.slice(at, F.lit(1), F.lit(1)), at), lambda a, b: F.coalesce(a - b, F.lit(0)))


def fingerprint(found: Column) -> Column:
    def text(f: Column) -> Column:
        digits = F.zip_with(
            F.slice(_gaps(f["at"]), F.lit(1), F.size(f["at"])), f["key"],
            lambda d, h: F.hex(F.lit(1 << 28) + F.when(d < 16, d).otherwise(0).cast("bigint") * (1 << 24) + h.bitwiseAND(F.lit((1 << 24) - 1))),
        )
        return F.lower(F.array_join(digits, ""))

    return let(found, text)


def evidence(found: Column) -> Column:
    """Distinct anchors, and distinct (anchor, distance, next anchor)."""
    def pairs(f: Column) -> Column:
        return F.when(F.size(f["key"]) > 1, F.transform(
            F.sequence(F.lit(0), F.size(f["key"]) - 2),
            lambda i: F.xxhash64(F.get(f["key"], i), F.get(f["key"], i + 1), F.get(f["at"], i + 1) - F.get(f["at"], i)),
        )).otherwise(F.array().cast("array<bigint>"))

    return let(found, lambda f: F.array_distinct(F.concat(f["key"], pairs(f))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of evidence; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def _group(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key: looked up in blocks, then within one. Null: -1."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    blocks = [bounds[i : i + _BLOCK] for i in range(0, len(bounds), _BLOCK)]
    heads, cells = F.array(*[F.lit(b[0]) for b in blocks]), F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda x: x <= key)) - 1
    return F.when(key.isNull(), -1).otherwise(let(block, lambda i: F.when(i < 0, 0).otherwise(
        i * _BLOCK + F.size(F.filter(F.get(cells, i), lambda x: x <= key))
    )))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document by descending doc_id; after the last, the first.

    Null ids come last; rows of one id are ordered by their text. Ids are cut into ranges of
    about equal numbers of rows, each range is ordered on its own, and the first row of each is
    handed to the range before it, so one shuffle moves the texts and no task sees them all.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    size = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    if not size[1]:
        return rows.withColumn("next_text", F.col("text"))
    n = max(1, min(MOST_GROUPS, -(-(size[0] or 0) // GROUP_CHARS)))
    steps = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx("doc_id", steps, max(10_000, 20 * n))).first()[0] if steps else None
    grouped = rows.withColumn("group", _group(F.col("doc_id"), sorted(set(cuts or []))))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text").desc()]

    # The first row of each group: its key without the text, then the text of those few keys.
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    firsts = grouped.groupBy("group").agg(F.max(key).alias("key")).orderBy(F.desc("group")).collect()  # at most MOST_GROUPS + 1
    taker = {firsts[i]["group"]: firsts[i - 1]["group"] for i in range(len(firsts))}
    wanted = docs.sparkSession.createDataFrame(
        [(f["group"], taker[f["group"]], f["key"]["doc_id"], f["key"]["hash"]) for f in firsts], "of int, taker int, first_id long, first_hash long"
    )
    heads = grouped.join(
        F.broadcast(wanted),
        (F.col("group") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash")),
    )
    heads = materialize(heads.groupBy("taker").agg(F.max("text").alias("head")), "group-heads")
    ordered = Window.partitionBy("group").orderBy(*order)
    led = grouped.withColumn("following", F.lead("text").over(ordered))
    return led.join(heads, led["group"] == heads["taker"], "left").select("doc_id", "text", F.coalesce("following", "head").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness.

    The edited text has its last floor(n/3) code points replaced by the first as many (or all)
    of the next document. Null texts are empty; an empty text has an empty fingerprint, and two
    empty texts are alike (1). A single document is its own next. Repeated rows follow each
    other. Extra columns are ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(docs).withColumn(
        "edited", F.when(third > 0, F.concat(F.left("text", n - third), F.left("next_text", third))).otherwise(F.col("text"))
    )
    found = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        anchors(F.col("text")).alias("own"), anchors(F.col("edited")).alias("other"), anchors(F.col("next_text")).alias("next"),
    )
    near = lambda a, b: let(F.struct(evidence(F.col(a)).alias("a"), evidence(F.col(b)).alias("b")), lambda x: likeness(x["a"], x["b"]))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        near("own", "other").alias("near_edited"), near("own", "next").alias("near_next"),
    )
