"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

The features approximate a Gaussian kernel over document statistics. Every partition sums its
share of the normal equations; the sums meet in a grouped aggregate over the matrix cells, so
what reaches the driver is one matrix of the chosen rank, whatever the corpus. Scores are
calibrated by pooling adjacent violators over a fixed histogram of held-back labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import fold, whole_text
from confluo.session import materialize

RANK = 160  # random features
RIDGE = 1e-3  # times the number of rows
BINS = 400  # of the calibration histogram
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SEED = 9

#: Byte classes of ASCII; bytes from 128 on are parts of other letters.
_CLASS = np.zeros(256, np.int64)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:!?'\"()-" else 6
_CLASS[128:] = 7

STATISTICS = (
    "log_chars log_words word_mean word_std distinct_words top_word lower upper digit blank "
    "mark symbol other_letter line_mean distinct_lines symbol_words byte_entropy ends"
).split()


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; null and empty texts give fixed values."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(float)
    share = np.bincount(_CLASS, weights=hist, minlength=8) / max(1, len(raw))
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    distinct = set(words)
    lines = text.split("\n")
    p = hist[hist > 0] / max(1, len(raw))
    return np.array(
        [
            np.log1p(len(text)), np.log1p(n), min(40.0, lengths.mean()), min(40.0, lengths.std()), len(distinct) / max(1, n),
            words.count(words[n // 2]) / n if n else 0.0, *share[1:8], np.log1p(len(text) / len(lines)),
            len(set(lines)) / len(lines), hist[list(b"#$%*&@")].sum() / max(1, n), float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
            hist[list(b".!?")].sum() / max(1, n),
        ]
    )


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) per row, from the whole texts."""

    @F.pandas_udf("array<double>")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return docs.select("doc_id", measure(whole_text()).alias("stats"))


@dataclass(frozen=True)
class Model:
    """``rank`` × statistics and some vectors; its size doesn't depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.turns + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([z, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def pool_adjacent_violators(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing levels closest to ones / counts."""
    blocks: list[list[float]] = []
    for y, n in zip(ones, counts, strict=True):
        blocks.append([y, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), y / n) for y, n, k in blocks]) if blocks else np.empty(0)


def fit(stats: DataFrame, labels: DataFrame, *, rank: int = RANK, ridge: float = RIDGE, bins: int = BINS) -> Model | None:
    """Learn from labelled rows outside the held-out fold; None if there are none.

    ``stats`` has (doc_id, stats); null labels and null ids are left out. One fifth of the
    labelled rows, chosen by their id, calibrates; the rest fits.
    """
    known = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = materialize(stats.join(known, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5))), "quality-rows")
    n_stats = len(STATISTICS)
    sums = rows.agg(
        F.count("*"),
        *[F.avg(F.col("stats")[i]) for i in range(n_stats)],
        *[F.stddev_pop(F.col("stats")[i]) for i in range(n_stats)],
    ).first()
    if not sums[0]:
        return None
    random = np.random.default_rng(SEED)
    mean, spread = np.array(sums[1 : n_stats + 1]), np.array(sums[n_stats + 1 :])
    width = rank + n_stats + 1
    model = Model(
        mean, np.where(spread > 1e-9, spread, 1.0), random.normal(size=(n_stats, rank)) / np.sqrt(n_stats),
        random.uniform(0, 2 * np.pi, rank), np.zeros(width), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    upper = np.triu_indices(width)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = np.zeros((width, width)), np.zeros(width), 0
        for part in parts:
            z = model.features(np.stack(part["stats"].to_numpy()))
            a += z.T @ z
            b += z.T @ part["y"].to_numpy()
            n += len(part)
        if n:
            cells = np.concatenate([a[upper], b, [float(n)]])
            yield pd.DataFrame({"cell": np.arange(len(cells)), "value": cells})

    def solve(some: DataFrame) -> np.ndarray | None:
        summed = some.select("stats", "y").mapInPandas(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        cells = summed.toPandas().sort_values("cell")["value"].to_numpy()  # width² / 2 numbers
        if not len(cells):
            return None
        a = np.zeros((width, width))
        a[upper] = cells[: len(upper[0])]
        a = a + np.triu(a, 1).T
        return np.linalg.solve(a + ridge * cells[-1] * np.eye(width), cells[len(upper[0]) : -1])

    weights = solve(rows.where("part != 0"))
    if weights is None:
        weights = solve(rows)
    model = Model(model.mean, model.scale, model.turns, model.shift, weights, model.knots, model.levels)

    @F.pandas_udf("int")
    def bin_of(values: pd.Series) -> pd.Series:
        raw = model.raw(np.stack(values.to_numpy())) if len(values) else np.empty(0)
        return pd.Series(np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype("int32"))

    held = rows.where("part = 0").groupBy(bin_of("stats").alias("bin")).agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    table = held.toPandas().sort_values("bin")  # at most `bins` rows
    if not len(table):
        return model
    levels = pool_adjacent_violators(table["ones"].to_numpy(), table["n"].to_numpy())
    knots = (table["bin"].to_numpy() + 0.5) / bins * 2 - 0.5
    return Model(model.mean, model.scale, model.turns, model.shift, weights, knots, levels)


def score_column(model: Model | None):
    """Score of a column of statistics; 0.5 without a model."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        if model is None or not len(values):
            return pd.Series(np.full(len(values), 0.5))
        return pd.Series(model.score(np.stack(values.to_numpy())))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    Null texts score as empty ones. Without any usable label every score is 0.5 and nothing
    is predicted good. Rows repeated with their id each get the same score; labels given
    twice count twice. Extra columns are ignored.
    """
    stats = materialize(statistics_table(docs), "statistics")
    score = score_column(fit(stats, labels))
    scored = stats.select("doc_id", score("stats").alias("score"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, with all their columns.

    The model is fitted first; then each text is scored where it lies, so no text moves.
    Without any usable label nothing is rejected.
    """
    model = fit(statistics_table(docs), labels)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.score(np.stack([statistics(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return docs.where(score(whole_text()) >= threshold)
