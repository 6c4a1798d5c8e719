"""Exact similarity join of keys within blocks, without scoring all pairs of a block.

Blocks of few pairs are bounded page by page (``functions/bounds.py``), and so are large ones
where an index would make about as many rows as there are pairs; the rest is about other large
blocks. For a floor above 90 a pair can only reach it through one of two routes, and each route has
an exact signature that becomes an equi-join:

* **edit route** (plain, sorted-token and shared-token ratios). With ``δ = 1 − floor/100``
  at most ``δ(|a|+|b|)`` insertions and deletions separate the two texts. Over per-token
  padded trigrams one deletion removes at most 3 grams and one insertion at most 2, so at
  most ``D = ⌊6δn/(1+δ)⌋`` grams of a text of length ``n`` are missing from its partner.
  Sorting grams in any fixed order, the first ``D+1`` grams of both texts must share one
  (prefix filtering, Vernica/Carey/Li 2010). The order puts rare grams first; lengths are
  bucketed so that only texts of close length meet.
* **containment route** (shared tokens against one side). All tokens of ``a``, up to a few
  characters, occur in ``b``: the rarest tokens of ``a`` must include one of ``b``.

Pairs further apart in length than a factor 1.5 score 90 at most and need no candidates.
Candidates are a superset; every one is scored, and no partner is dropped or capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.functions.bounds import best_matches, pairs_above
from confluo.functions.labels import let
from confluo.functions.similarity import LENGTH_FACTOR, TOKEN_SCALE, wratio_from
from confluo.session import materialize, own_exchange

_OPEN, _CLOSE = "\u0002", "\u0003"


def _pieces(words: Column) -> Column:
    """Trigrams of each padded word, sorted."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(_OPEN), w, F.lit(_CLOSE))
        return F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_sort(F.flatten(F.transform(words, of_word)))


def _block_pieces(block: Column) -> Column:
    """Trigrams every key of the block shares because they spell the block's name."""
    padded = F.replace(F.concat(F.lit("|"), block, F.lit("|")), F.lit(" "), F.lit(f"{_CLOSE} {_OPEN}"))
    return F.flatten(
        F.transform(
            F.split(padded, " "),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.greatest(F.char_length(w) - 2, F.lit(1))),
                lambda i: F.substring(w, i, F.lit(3)),
            ),
        )
    )


def _grams(words: Column, block: Column) -> Column:
    """``(last, g, o)`` per trigram: ``o`` numbers repeats, so that a multiset becomes a set;
    ``last`` marks grams of the block's name, which go to the end of the order."""

    def numbered(v: Column) -> Column:
        return F.transform(
            v["pieces"],
            lambda g, i: F.struct(
                F.array_contains(v["shared"], g).alias("last"),
                g.alias("g"),
                (i + 1 - F.array_position(v["pieces"], g)).cast("int").alias("o"),
            ),
        )

    return let({"pieces": _pieces(words), "shared": _block_pieces(block)}, numbered)


# pairs must share this many grams of their (equally longer) prefixes
_SHARED = 4


def _edit_prefixes(keys: DataFrame, delta: float) -> DataFrame:
    """``(id, block, fresh, v, n, b, need, h)``: the rarest grams of each key. Texts, grams and
    join keys travel as 64-bit hashes: a collision can only add a candidate, which the scorer
    then rejects."""
    tokens = F.col("tokens")
    plain = F.struct(F.lit(0).alias("v"), tokens.alias("w"))
    single = F.struct(F.lit(1).alias("v"), F.array_distinct(tokens).alias("w"))
    # a key with a repeated token is also indexed by its token set
    repeated = F.size(F.array_distinct(tokens)) < F.size(tokens)
    texts = keys.select(
        "id", "block", "key", "fresh", F.inline(F.when(repeated, F.array(plain, single)).otherwise(F.array(plain)))
    )
    n = F.when(F.col("v") == 0, F.char_length("key")).otherwise(F.char_length(F.array_join("w", " ")))
    grams = materialize(
        texts.select("id", "block", "fresh", "v", n.alias("n"), F.inline(_grams(F.col("w"), F.col("block")))), "grams"
    )
    # gram counts over all keys: normal-form keys have at most 40**3 distinct grams, and the
    # written table tells the optimizer whether it may be broadcast
    counts = materialize(grams.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "gram-counts")
    missing = F.floor(F.lit(6 * delta / (1 + delta)) * F.col("n") + F.lit(1e-9))
    # texts within the edit bound differ in length by at most this factor
    step = math.log((1 + delta) / (1 - delta)) * (1 + 1e-9)
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int").alias("b")
    return materialize(
        grams.join(counts, "g")
        .groupBy("id", "block", "fresh", "v", "n")
        .agg(F.array_sort(F.collect_list(F.struct("last", "c", "g", "o"))).alias("rs"))
        .select(
            "id", "block", "fresh", "v", "n", bucket, F.size("rs").alias("total"), missing.alias("missing"),
            F.explode(F.slice("rs", F.lit(1), (missing + _SHARED).cast("int"))).alias("r"),
        )
        .select(
            "id", "block", "fresh", "v", "n", "b",
            # a short prefix cannot be asked for the full number of shared grams
            F.least(F.lit(_SHARED), F.greatest(F.col("total") - F.col("missing"), F.lit(1))).cast("int").alias("need"),
            F.xxhash64("block", "r.g", "r.o").alias("h"),
        ),
        "prefix",
    )


def _edit_sides(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides that meet by ``h``: fresh keys, and all keys of a length bucket beside theirs."""
    left = prefix.filter("fresh").select("id", "block", "v", "n", "need", F.xxhash64("h", "b").alias("h"))
    right = prefix.select(
        F.col("id").alias("other"), F.col("block").alias("at"), F.col("fresh").alias("both"), F.col("v").alias("u"), F.col("n").alias("m"), F.col("need").alias("want"),
        F.explode(
            F.array(*[F.xxhash64("h", (F.col("b") + k).cast("int")) for k in (-1, 0, 1)])
        ).alias("h"),
    )
    return left, right


def _edit_candidates(prefix: DataFrame, delta: float) -> DataFrame:
    """Candidate ``(id, other)``."""
    left, right = _edit_sides(prefix)
    close = F.abs(F.col("n") - F.col("m")) <= F.lit(delta) * (F.col("n") + F.col("m")) + F.lit(1e-9)
    pairs = left.drop("block").join(right.drop("at"), "h").filter(((F.col("id") < F.col("other")) | (~F.col("both") & (F.col("id") != F.col("other")))) & close)
    shared = pairs.groupBy("id", "other", "v", "u").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.least("need", "want")).alias("need")
    )
    return shared.filter(F.col("k") >= F.col("need")).select(
        F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")
    )


def _containment_sides(keys: DataFrame, tau: float) -> tuple[DataFrame, DataFrame]:
    """The two sides that meet by ``h``: the rarest tokens of each key, and all tokens of all keys."""
    words = keys.select(
        "id", "block", "fresh", F.char_length("key").alias("n"), F.array_distinct("tokens").alias("ws")
    ).withColumn("d", F.char_length(F.array_join("ws", " ")))
    exploded = words.select("id", F.explode("ws").alias("w"), "block").select(
        "id", F.xxhash64("block", "w").alias("h")
    )
    counts = exploded.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    # longest remainder of a that still reaches the floor, and the tokens it can hold
    spare = F.greatest(
        F.floor((F.lit(tau) * (2 * F.col("d") - 1) - 1) / F.lit(1 + tau) + F.lit(1e-9)), F.lit(0)
    )
    allowed = F.floor((spare + 1) / 2)
    rare = (
        exploded.join(counts, "h")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("rs"))
        .join(words, "id")
        .select("id", "block", "fresh", "n", "ws", "d", F.explode(F.slice("rs", F.lit(1), (allowed + 1).cast("int"))).alias("r"))
        .select("id", "block", "fresh", "n", "ws", "d", F.col("r.h").alias("h"))
    )
    right = words.select(
        F.col("id").alias("other"), F.col("fresh").alias("both"), F.col("n").alias("m"), F.col("ws").alias("vs"), "block", F.explode("ws").alias("w")
    ).select("other", F.col("block").alias("at"), "both", "m", "vs", F.xxhash64("block", "w").alias("h"))
    return rare, right


def _containment_candidates(keys: DataFrame, tau: float) -> DataFrame:
    """Candidate ``(id, other)`` whose tokens all but contain one another."""
    rare, right = _containment_sides(keys, tau)
    rest = F.char_length(F.array_join(F.array_except("ws", "vs"), " "))

    def inside(v: Column) -> Column:
        shared = v["d"] - v["rest"] - F.when(v["rest"] > 0, 1).otherwise(0)
        return (v["rest"] == 0) | ((v["rest"] + 1) <= F.lit(tau) * (2 * shared + 1 + v["rest"]) + F.lit(1e-9))

    near = F.greatest("n", "m") < F.lit(LENGTH_FACTOR) * F.least("n", "m")
    pairs = rare.drop("block").join(right.drop("at"), "h").filter((F.col("fresh") | F.col("both")) & (F.col("id") != F.col("other")) & near)
    pairs = pairs.filter(let({"d": F.col("d"), "rest": rest}, inside))
    return pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))


def _routes(floor: float) -> tuple[float, float | None]:
    """Parts of a text in which the edit and the containment route may differ."""
    return 1 - floor / 100, 1 - floor / (100 * TOKEN_SCALE) if floor <= 100 * TOKEN_SCALE else None


def _meets(base: DataFrame, prefix: DataFrame, floor: float) -> DataFrame:
    """``(block, meets)``: rows that the index's joins would make in each block."""
    sides = [_edit_sides(prefix)]
    tau = _routes(floor)[1]
    if tau is not None:
        sides.append(_containment_sides(base, tau))
    found = None
    for left, right in sides:
        many = right.groupBy(F.col("at").alias("block"), "h").agg(F.count(F.lit(1)).alias("r"))
        met = left.groupBy("block", "h").agg(F.count(F.lit(1)).alias("l")).join(many, ["block", "h"]).select("block", (F.col("l") * F.col("r")).alias("m"))
        found = met if found is None else found.unionByName(met)
    return found.groupBy("block").agg(F.sum("m").alias("meets"))


def _indexed_pairs(base: DataFrame, prefix: DataFrame, floor: float) -> DataFrame:
    """Pairs of ``base(id, block, key, fresh, tokens)`` by the two routes, scored."""
    delta, tau = _routes(floor)
    candidates = _edit_candidates(prefix, delta)
    if tau is not None:
        candidates = candidates.unionByName(_containment_candidates(base, tau))
    texts = base.select("id", "block", "key")
    paired = (
        candidates.distinct()
        .join(texts.select("id", F.col("block").alias("b1"), F.col("key").alias("k1")), "id")
        .join(texts.select(F.col("id").alias("other"), F.col("block").alias("b2"), F.col("key").alias("k2")), "other")
        .filter((F.col("b1") == F.col("b2")) & (F.col("k1") != F.col("k2")))
        .select(F.col("b1").alias("block"), F.least("k1", "k2").alias("key"), F.greatest("k1", "k2").alias("other"))
        .repartition(_parts(base), "key", "other")  # small rows, much work in each
    )
    scored = paired.withColumn("score", wratio_from(F.col("key"), F.col("other"), floor))
    return scored.filter(F.col("score") >= F.lit(floor)).distinct()


def _paged_pairs(keys: DataFrame, floor: float, *, page: int, parts: int) -> DataFrame:
    """Pairs of ``keys(block, key, fresh)`` from pages that meet once, scored where bounds allow."""
    pages = _pages(keys, ["fresh", "key"], page=page).select("block", "page", F.col("rows.key").alias("keys"), F.col("rows.fresh").alias("fresh"))
    other = pages.select("block", F.col("page").alias("with"), F.col("keys").alias("names"), F.col("fresh").alias("new"))
    met = pages.join(other, "block").filter("page <= with")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, one, two, left, fresh, right, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [
                    (min(left[i], right[j]), max(left[i], right[j]), s)
                    for i, j, s in pairs_above(left, right, floor)
                    if (fresh[i] or new[j]) and (one != two or i < j)
                ]
                k, o, s = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(found), pa.string()), pa.array(k, pa.string()), pa.array(o, pa.string()), pa.array(s, pa.float64())],
                    names=["block", "key", "other", "score"],
                )

    columns = met.select("block", "page", "with", "keys", "fresh", "names", "new").repartition(parts)
    return columns.mapInArrow(compare, "block string, key string, other string, score double")


def _parts(df: DataFrame) -> int:
    """A fixed number of partitions, for few and small rows with much work in each."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Pairs of a block up to which its pages are compared without a look at the index.
PAGED_PAIRS = 16_000_000
#: Pairs that are bounded page by page in the time of one row of the index's joins.
PAIRS_A_MEET = 8
#: Pairs that one task bounds.
TASK_PAIRS = 100_000_000


def similar_keys(keys: DataFrame, *, floor: float = D.REVIEW_AT, paged: int = PAGED_PAIRS, dense: float = PAIRS_A_MEET) -> DataFrame:
    """All pairs ``(block, key, other, score)`` with ``key < other`` and score ≥ floor.

    Input: distinct ``(block, key)``; with a third column ``fresh``, pairs of two keys that are
    not fresh are left out and never scored. ``floor`` must be above 90, below which the
    scorer's window branch would have to compare texts of any length.

    A block of few pairs costs less to bound page by page than to index: there one pass of
    matrix operations bounds all scores. In blocks of more than ``paged`` pairs the rows are
    counted that the index's joins would make. Where keys are put together from few words, each
    gram is frequent and these come near the pairs; the index is used where it makes less than
    one row for ``dense`` pairs. Both ways are exact.
    """
    if not 90.0 < floor <= 100.0:
        raise ValueError("floor must be in (90, 100]")
    fresh = F.col("fresh") if "fresh" in keys.columns else F.lit(True)
    rows = materialize(keys.filter("key <> '' AND block IS NOT NULL").select("block", "key", fresh.alias("fresh")), "keys")
    pairs = F.count(F.lit(1)) * F.count_if("fresh")
    sizes = materialize(rows.groupBy("block").agg(pairs.alias("pairs")).filter("pairs > 0"), "block-pairs")
    by_page = sizes.filter(F.col("pairs") <= paged)
    large = sizes.filter(F.col("pairs") > paged)
    found = None
    if not large.isEmpty():
        tokens = F.filter(F.split("key", r"\s+"), lambda w: w != "")
        base = rows.join(own_exchange(large), "block", "left_semi").select(
            F.xxhash64("block", "key").alias("id"), "block", "key", "fresh", tokens.alias("tokens")
        )
        base = materialize(base, "indexed-keys")
        prefix = _edit_prefixes(base, _routes(floor)[0])
        way = materialize(
            large.join(_meets(base, prefix, floor), "block", "left").withColumn("crowded", F.coalesce(F.col("meets") * dense > F.col("pairs"), F.lit(False))), "ways"
        )
        by_page = by_page.unionByName(way.filter("crowded").select("block", "pairs"))
        sparse = way.filter("not crowded").select("block")
        if not sparse.isEmpty():
            mine = own_exchange(sparse)
            found = _indexed_pairs(base.join(mine, "block", "left_semi"), prefix.join(mine, "block", "left_semi"), floor)
    few = rows.join(own_exchange(by_page.select("block")), "block", "left_semi")
    total = by_page.agg(F.sum(F.col("pairs").cast("double"))).first()[0] or 0.0
    paged_pairs = _paged_pairs(few, floor, page=PAGE, parts=max(_parts(keys), math.ceil(total / TASK_PAIRS)))
    return paged_pairs if found is None else paged_pairs.unionByName(found)


def fresh_keys(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct ``(block, key, fresh)``: incoming keys, and stored ones of the same blocks."""
    same = stored.select("block", "key").join(incoming.select("block").distinct(), "block", "left_semi")
    both = incoming.select("block", "key", F.lit(True).alias("fresh")).unionByName(same.withColumn("fresh", F.lit(False)))
    return both.groupBy("block", "key").agg(F.bool_or("fresh").alias("fresh"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair; the pairs are made once."""
    ways = F.array(F.struct("block", "key", "other", "score"), F.struct("block", F.col("other").alias("key"), F.col("key").alias("other"), "score"))
    return pairs.select(F.inline(ways))


#: Keys of one page. Pages of a block meet pairwise; a page is one row.
PAGE = 512


def _pages(keys: DataFrame, columns: list[str], *, page: int) -> DataFrame:
    """``(block, pages, page, rows)``: the keys of each block dealt over pages of about ``page``."""
    pages = keys.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / page).alias("pages"))
    dealt = keys.join(own_exchange(pages), "block").withColumn("page", F.pmod(F.xxhash64("key"), F.col("pages")))
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return dealt.groupBy("block", "pages", "page").agg(rows.alias("rows"))


def best_of_block(keys: DataFrame, names: DataFrame, *, page: int = PAGE) -> DataFrame:
    """``(block, key, id, other, score)``: the best name of the block for every key, at any score.

    ``keys`` are distinct ``(block, key)``, ``names`` distinct ``(block, key)`` with an ``id``; equal
    scores go to the smallest id. Keys of blocks without a name are absent.

    Both sides are dealt over pages, and each page of keys meets each page of names of its block
    once, as a row of its own: a block that a third of all rows have is spread over all tasks.
    Within a pair of pages bounds of all scores come from a few matrix operations, and a key is
    scored from its highest bound down until no bound reaches the best score found.
    """
    stored = _pages(names.filter("key is not null and block is not null"), ["id", "key"], page=page)
    asked = _pages(keys.filter("key is not null and block is not null").select("block", "key"), ["key"], page=page)
    dealt = asked.select("block", F.col("rows.key").alias("keys")).join(own_exchange(stored.select("block", "pages").distinct()), "block")
    pairs = dealt.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1))).join(
        stored.select("block", "page", F.col("rows.id").alias("ids"), F.col("rows.key").alias("names")), ["block", "page"]
    )
    kinds = {f.name: f.dataType.simpleString() for f in names.schema}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, left, ids, right in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "ids", "names")), strict=True):
                found = list(best_matches(left, right))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(found), pa.string()),
                        pa.array([left[i] for i, _, _ in found], pa.string()),
                        pa.array([ids[j] for _, j, _ in found], batch.schema.field("ids").type.value_type),
                        pa.array([right[j] for _, j, _ in found], pa.string()),
                        pa.array([s for _, _, s in found], pa.float64()),
                    ],
                    names=["block", "key", "id", "other", "score"],
                )

    columns = pairs.select("block", "keys", "ids", "names").repartition(_parts(keys))
    scored = columns.mapInArrow(search, f"block string, key string, id {kinds['id']}, other string, score double")
    best = F.min_by(F.struct("id", "other", "score"), F.struct(-F.col("score"), F.col("id"))).alias("m")
    return scored.groupBy("block", "key").agg(best).select("block", "key", "m.*")


def fuzzy_best_match(
    incoming: DataFrame,
    stored: DataFrame,
    *,
    floor: float = D.REVIEW_AT,
    block: str = "company_normalized",
    key: str = "canonical_key",
    row: str = "arrival",
) -> DataFrame:
    """Best stored row of the incoming row's block, whatever it scores: ``match_id, match_key, score``.

    Equal scores go to the smallest stored id; without a candidate all three are NULL.
    ``below_floor`` marks matches under ``floor``, which resolution takes for no match.
    """
    fresh = incoming.select(F.col(block).alias("block"), F.col(key).alias("key")).distinct()
    have = (
        stored.filter(F.col(key).isNotNull() & F.col(block).isNotNull())
        .groupBy(F.col(block).alias("block"), F.col(key).alias("key"))
        .agg(F.min("id").alias("id"))
    )
    best = best_of_block(fresh, have)
    joined = incoming.select(row, F.col(block).alias("block"), F.col(key).alias("key")).join(own_exchange(best), ["block", "key"], "left")
    return joined.select(
        row,
        F.col("id").alias("match_id"),
        F.col("other").alias("match_key"),
        "score",
        F.coalesce(F.col("score") < F.lit(floor), F.lit(False)).alias("below_floor"),
    )
