"""Vector code compression: product codes from an exact, limb-split matrix product.

Vectors become integers and are cut into equal parts; every part is replaced by the number of
the nearest of a few codebook entries. The nearest entry needs |x|^2 - 2 x.y + |y|^2 exactly,
or ties and the floors of the means would depend on rounding. So integers are broken into
limbs, limbs are multiplied as float64 matrices whose products stay below 2^53 (BLAS, exact),
and the products are put together again in int64; the first smallest distance wins.

Vectors never move: every round is a pass over the written integers in which each task sums
its share per (part, entry, position). The sums meet in a grouped aggregate of codebook size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import arrow_batches
from confluo.session import materialize, own_exchange

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6

#: Bits of a limb. A product of two limbs summed over d positions needs 2 * 12 + log2(d) bits.
LIMB_BITS = 12
EXACT_BITS = 53

#: Integers that one Arrow batch hands to Python, about.
BATCH_CELLS = 2_000_000


# --- exact products -----------------------------------------------------------------


def limbs(x: np.ndarray, bits: int = LIMB_BITS) -> list[np.ndarray]:
    """``x`` = sum of limb[i] * 2^(bits i) as float64; all but the last are in [0, 2^bits)."""
    out = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray, bits: int = LIMB_BITS) -> np.ndarray:
    """a @ b.T of int64 matrices, exact as long as the result fits int64."""
    if 2 * bits + math.ceil(math.log2(max(1, a.shape[1]))) > EXACT_BITS:
        raise ValueError(f"{a.shape[1]} positions are too many for limbs of {bits} bits")
    total = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            total += (x @ y.T).astype(np.int64) * np.int64(1 << bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, its squared distance) per row."""
    far = (book * book).sum(axis=1) - 2 * exact_dot(x, book)
    best = far.argmin(axis=1)
    return best, (x * x).sum(axis=1) + far[np.arange(len(x)), best]


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) codes and distances for whole vectors; ``books`` is (parts, entries, positions)."""
    found = [nearest(part, book) for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)]
    return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)


def largest(width: int) -> int:
    """The largest magnitude of a component for which the error of a whole vector fits int64."""
    return int(math.isqrt((1 << 62) // width) // 2)


# --- Spark ---------------------------------------------------------------------------


def usable(vector: Column, parts: int) -> Column:
    """The vector is there, can be cut into ``parts``, and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.coalesce(fine, F.lit(False))


def integers(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int] | None:
    """(vec_id, label, x: integers) of the vectors that can be coded, written; and their width."""
    rows = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding"), parts))
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", F.size("embedding").alias("width"))).alias("f")).first()["f"]
    if first is None:
        return None
    edge = float(largest(first.width))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), x.cast("double") * scale))).cast("int"))
    rows = rows.where(F.size("embedding") == first.width).select("vec_id", "label", whole.alias("x"))
    return materialize(rows, "vector-integers"), first.width


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """(parts, entries, 1 + positions) as Python integers: how many parts each entry has, and their sums."""
    parts, entries, positions = books.shape

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + positions), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * positions)
            codes, _ = assign(x, books)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                total[p, :, 0] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p, :, 1:], codes[:, p], part)
        at = np.nonzero(total[:, :, 0].repeat(1 + positions).reshape(total.shape))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(i, pa.int32()) for i in at], pa.array(total[at], pa.int64())], names=["part", "entry", "at", "total"]
        )

    cells = rows.select("x").mapInArrow(share, "part int, entry int, at int, total long")
    out = np.zeros((parts, entries, 1 + positions), object)
    for r in cells.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.part, r.entry, r.at] = int(r.total)
    return out


def train(rows: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, positions) codebooks; they start as the parts of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = _sums(rows, books)
        for p, e in zip(*np.nonzero(sums[:, :, 0]), strict=True):
            books[p, e] = [s // sums[p, e, 0] for s in sums[p, e, 1:]]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part, and the squared distance over all parts."""
    parts, _, positions = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(_matrix(batch.column("x"), parts * positions), books)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(axis=1), pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([book[i] for i, book in zip(bytes.fromhex(code), books, strict=True)])


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """One row per vector that can be coded: vec_id, code, error, label_error, codebooks_sha256.

    Left out are null vectors, vectors with null or non-finite components, and vectors that
    can't be cut like the one of the smallest id (empty, or of another length). Components
    become floor(scale * x); beyond ``largest(width)`` (2^27 for 64 components, |x| = 32,768)
    they are held at that bound, so that errors fit a long. With fewer vectors than entries the
    codebooks are as short. Equal ids (nulls last) start in the order of their vectors; repeated
    rows count as often as they occur. ``label_error`` sums over equal labels, null labels
    together (a sum beyond a long is held at the largest long). Extra columns are ignored; an
    empty table gives an empty result.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits per part: 256 entries at most")
    spark = vectors.sparkSession
    found = integers(vectors, parts, scale)
    if found is None:
        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    rows, width = found
    with arrow_batches(spark, max(1, BATCH_CELLS // width)):
        books = train(rows, width, parts=parts, entries=entries, rounds=rounds)
        coded = materialize(encode(rows, books), "vector-codes")
    # One row per label and task is moved; a label that a third of all vectors have is split in the join.
    most = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(most.cast("long").alias("label_error"))
    return coded.join(own_exchange(totals), F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same as DuckDB SQL, with one assignment and one codebook per round."""
    steps = [
        f"""kept AS (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS place,
                   [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x, len(embedding) // {parts} AS d
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        )""",
        f"piece AS (SELECT vec_id, label, place, part, x[part * d + 1 : (part + 1) * d] AS x FROM kept, range({parts}) r(part))",
        f"book0 AS (SELECT part, place AS entry, x AS y FROM piece WHERE place < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""best{i} AS MATERIALIZED (
                SELECT place, part, any_value(label) AS label, any_value(vec_id) AS vec_id, any_value(x) AS x,
                       min(list_sum([(x[j] - y[j]) * (x[j] - y[j]) FOR j IN range(1, len(x) + 1)]) * {entries} + entry) AS found
                FROM piece JOIN book{i} USING (part) GROUP BY place, part
            )"""
        )
        if i < rounds:
            steps.append(
                f"""mean{i} AS (
                    SELECT part, found % {entries} AS entry, j, sum(x[j]) AS total, count(*) AS n
                    FROM best{i}, (SELECT unnest(range(1, len(x) + 1)) AS j FROM (SELECT x FROM piece LIMIT 1)) GROUP BY part, entry, j
                ),
                book{i + 1} AS MATERIALIZED (
                    SELECT b.part, b.entry, coalesce(m.y, b.y) AS y
                    FROM book{i} b LEFT JOIN (
                        SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY j) AS y FROM mean{i} GROUP BY part, entry
                    ) m USING (part, entry)
                )"""
            )
    last = f"best{rounds}"
    steps.append(
        f"""coded AS (
            SELECT place, any_value(vec_id) AS vec_id, any_value(label) AS label, CAST(sum(found // {entries}) AS BIGINT) AS error,
                   string_agg(printf('%02x', CAST(found % {entries} AS INTEGER)), '' ORDER BY part) AS code
            FROM {last} GROUP BY place
        )"""
    )
    return f"""
    WITH {", ".join(steps)}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
    FROM coded
    """
