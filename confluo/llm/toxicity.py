"""Toxicity: noisy-channel deobfuscation by Viterbi, then a score of the restored text.

A writer means a word and a channel disguises it: letters become look-alike signs, are set
apart by blanks or marks, or repeated. Every disguised string is a lattice: each sign can be
itself or one of the letters it stands for, a run of a letter one or two of it, a mark or blank
within a word a word boundary or nothing. The best path under a character language model
(four symbols, counted over all documents) and the channel's costs is what was meant. A string
with one path only is that path, so most words cost a dictionary lookup.

The score is a noisy-or over the words of the restored text. A word's probability is the lower
end of a confidence interval of the share of toxic texts among those that have it, counted over
*different* texts: near copies (equal minwise shingle) are one. So the words of one copied
text, or of few texts, carry little weight, and a leak stands for all else.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import arrow_batches, fold, numbered, whole_text
from confluo.session import materialize

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

#: Labelled rows that the lexicon is learned from, about; chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Words of the lexicon at most, the most telling ones.
LEXICON = 4_000
#: Normal quantile of the interval, and the least lower end of a word of the lexicon.
Z, LEAST = 2.5, 0.3
#: Words of a shingle by which near copies are recognised.
SHINGLE = 3

#: Symbols of the language model: a boundary (no letter), a to z, any other letter.
BOUNDARY, OTHER, SYMBOLS = 0, 27, 28
ORDER = 4
GRAMS = SYMBOLS**ORDER
#: Weight of the shorter context in a longer one, in occurrences.
BACKOFF = 2.0

# The letters that a sign can stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}

# Costs of the channel, in nats.
SUBSTITUTED = 0.7  # a sign for a letter
LITERAL = 5.0  # a look-alike between letters that means itself
DOUBLED = 4.5  # two letters written for one
DRAWN_OUT = 0.5  # three or more letters written for one or two
SEPARATED = 2.0  # a mark within a word
SPELLED = 1.0, 3.0  # a boundary among letters set apart one by one: by blanks, by marks

BATCH_ROWS = 200
#: Code points of text that the counting takes at once, and strings a task remembers.
STEP = 1 << 20
MEMORY = 200_000

_PLAIN = re.compile(r"[^\w@$€£¥]*[^\W\d_]*[^\w@$€£¥]*")
_TWICE = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[a-z]+")


# --- the language model ----------------------------------------------------------------


@cache
def symbol_table() -> np.ndarray:
    """The symbol of each code point below 0x20000; accents and letter variants fold to a-z."""
    table = np.zeros(0x20000, np.uint8)
    for point in range(len(table)):
        c = chr(point)
        if not c.isalpha():
            continue
        base = unicodedata.normalize("NFKD", c)[0].lower()
        table[point] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return table


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = symbol_table()
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], OTHER).astype(np.uint8)


def gram_counts(texts: list[str], counts: np.ndarray) -> None:
    """Add the grams of whole texts, boundaries in a row being one; any length, a step at a time."""
    whole = "\n".join(["", *texts, ""])
    carry = np.zeros(1, np.int64)  # the last symbols of what came before
    for at in range(0, len(whole), STEP):
        s = np.concatenate([carry, symbols(whole[at : at + STEP]).astype(np.int64)])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != BOUNDARY) | (s[:-1] != BOUNDARY)
        s = s[keep]
        if len(s) >= ORDER:
            gram = s[: len(s) - ORDER + 1].copy()
            for i in range(1, ORDER):
                gram = gram * SYMBOLS + s[i : len(s) - ORDER + 1 + i]
            counts += np.bincount(gram, minlength=GRAMS)
        carry = s[max(0, len(s) - ORDER + 1) :]


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P(symbol | three symbols) for every gram, shorter contexts filling in."""
    n = counts.astype(np.float64).reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        seen = n.sum(axis=tuple(range(ORDER - order)))
        p = (seen + BACKOFF * p) / (seen.sum(axis=-1, keepdims=True) + BACKOFF)
    return np.log(p).astype(np.float32).ravel()


def language_model(docs: DataFrame) -> np.ndarray:
    """The model from all texts: a table of fixed size (28^4), however many documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(GRAMS, np.int64)
        for batch in batches:
            gram_counts(batch.column(0).to_pylist(), counts)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], names=["gram", "n"])

    grams = docs.select(whole_text().alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(GRAMS)
    for r in grams.collect():  # 614,656 rows at most
        counts[r.gram] = r.n
    return log_probabilities(counts)


# --- lattices and their best paths --------------------------------------------------------


@cache
def letter(c: str) -> tuple[int, str]:
    """(symbol, what is written for it) of a character."""
    point = ord(c)
    s = int(symbol_table()[point]) if point < len(symbol_table()) else OTHER
    return s, chr(96 + s) if BOUNDARY < s < OTHER else c


Arc = tuple[tuple[int, ...], str, float]  # symbols, text, cost


def lattice(string: str) -> list[list[Arc]]:
    """For each run of a character, what it can mean. Marks at the ends mean themselves."""
    runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"(.)\1*", string, re.DOTALL)]
    inner = [i for i, (c, _) in enumerate(runs) if c.isalnum() or c in LOOK_ALIKES]
    first, last = (inner[0], inner[-1]) if inner else (0, -1)
    # Letters set apart one by one: the marks are the disguise, so a true boundary costs.
    spelled = len(inner) > 2 and inner == list(range(first, last + 1, 2))
    out: list[list[Arc]] = []
    for i, (c, n) in enumerate(runs):
        s, shown = letter(c)
        if s == OTHER:
            out.append([((OTHER,) * min(n, ORDER), c * n, 0.0)])
        elif s:
            one, two = ((s,), shown), ((s, s), shown * 2)
            out.append([(*one, 0.0)] if n == 1 else [(*two, 0.0), (*one, DOUBLED)] if n == 2 else [(*one, DRAWN_OUT), (*two, DRAWN_OUT)])
        elif c in LOOK_ALIKES:
            edge = not c.isalnum() and i in (first, last)
            arcs: list[Arc] = [((BOUNDARY,), c * n, 0.0 if edge else LITERAL)]
            for x in LOOK_ALIKES[c]:
                k = ord(x) - 96
                arcs.append(((k,), x, SUBSTITUTED + (DOUBLED if n > 1 else 0.0)))
                if n > 1:
                    arcs.append(((k, k), x * 2, SUBSTITUTED))
            out.append(arcs)
        elif first < i < last:
            out.append([((BOUNDARY,), c * n, SPELLED[c != " "] if spelled else 0.0), ((), "", 0.0 if spelled else SEPARATED)])
        else:
            out.append([((BOUNDARY,), c * n, 0.0)])
    return out


def best_path(units: list[list[Arc]], logp) -> str:
    """The text of the cheapest path. A state is the last three symbols; ties go to the first."""
    size = SYMBOLS ** (ORDER - 1)
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for arcs in [*units, [((BOUNDARY,), "", 0.0)]]:
        reached: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, back) in states.items():
            for emitted, shown, cost in arcs:
                at, total = state, score - cost
                for s in emitted:
                    if s or at % SYMBOLS:  # boundaries in a row are one
                        gram = at * SYMBOLS + s
                        total += logp[gram]
                        at = gram % size
                if at not in reached or total > reached[at][0]:
                    reached[at] = (total, (back, shown))
        states = reached
    _, back = max(states.values(), key=lambda x: x[0])
    out = []
    while back is not None:
        back, shown = back
        out.append(shown)
    return "".join(reversed(out))


@dataclass
class Restorer:
    """Restores strings and texts under a language model; remembers the words of strings it has seen."""

    logp: array
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, table: np.ndarray) -> Restorer:
        return cls(array("f", table.astype(np.float32).tobytes()))

    def string(self, string: str) -> str:
        """What a lower-case string without blanks (or spelled out with blanks) means."""
        if not _LETTER.search(string):
            return string
        if _PLAIN.fullmatch(string) and not _TWICE.search(string):
            return string if string.isascii() else "".join([letter(c)[1] for c in string])
        return best_path(lattice(string), self.logp)

    def strings(self, text: str) -> list[str]:
        """The strings of a whole text; three or more single characters in a row are one string."""
        found = text.lower().split()
        single = bytes([len(t) == 1 for t in found])
        if b"\1\1\1" not in single:
            return found
        out, at = [], 0
        for m in re.finditer(b"\1{3,}", single):
            out += found[at : m.start()]
            out.append(" ".join(found[m.start() : m.end()]))
            at = m.end()
        return out + found[at:]

    def text(self, text: str | None) -> str:
        """The restored text, strings joined by a blank; null and empty texts give none."""
        return " ".join([self.string(s) for s in self.strings(text or "")])

    def words(self, text: str | None, only: frozenset[str] | None = None) -> set[str]:
        """The words of the restored text; of those in ``only``, if given (the same at each call)."""
        found: set[str] = set()
        memory = self.memory
        for s in set(self.strings(text or "")):
            known = memory.get(s)
            if known is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                known = tuple(_WORD.findall(self.string(s)))
                if only is not None:
                    known = tuple(w for w in known if w in only)
                memory[s] = known
            if known:
                found.update(known)
        return found


def restored_texts(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, restored) for every document."""

    @F.pandas_udf("string")
    def restore(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer.of(table)
        for texts in parts:
            yield texts.map(restorer.text)

    return docs.select("doc_id", restore(whole_text()).alias("restored"))


# --- the lexicon ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """Words with the probability by which each makes a text toxic, and that of any text."""

    leak: float = 0.0
    words: dict[str, float] = field(default_factory=dict)

    def score(self, words: set[str]) -> float:
        clean = 1.0 - self.leak
        for w in sorted(words & self.words.keys()):
            clean *= 1.0 - self.words[w]
        return 1.0 - clean


def lower_end(ones: Column, n: Column, z: float = Z) -> Column:
    """Lower end of Wilson's interval for the share ones / n."""
    p, w = ones / n, F.lit(z * z)
    return (p + w / (2 * n) - z * F.sqrt(p * (1 - p) / n + w / (4 * n * n))) / (1 + w / n)


def sketch(text: str) -> int:
    """The smallest hash of the text's shingles: near copies mostly agree in it."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + SHINGLE]).encode()) for i in range(max(1, len(words) - SHINGLE + 1))), default=0)


def learn(docs: DataFrame, labels: DataFrame, table: np.ndarray, *, train_rows: int = TRAIN_ROWS, lexicon: int = LEXICON) -> Lexicon:
    """Learn from labelled rows outside the held-out fold.

    Null labels and ids are left out; of several labels of an id the majority counts (toxic on a
    tie). About ``train_rows`` labelled ids, chosen by a hash of the id, are learned from; of
    texts with one sketch the first by id, with the label that most of them have.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = materialize(known.groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("y")), "toxic-labels")
    share = min(1.0, train_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer.of(table)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [sorted(restorer.words(t)) for t in texts]
            near = pa.array([sketch(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("y"), near, pa.array(found, pa.list_(pa.string()))], names=["y", "near", "words"])

    # The chosen labels are rows of 12 bytes, ``train_rows`` of them: no text is shuffled.
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known), "doc_id").select("y", "text")
    rows = numbered(sample.mapInArrow(words, "y int, near long, words array<string>"), "toxic-words", "row")
    different = rows.groupBy("near").agg((F.avg("y") >= 0.5).cast("int").alias("y"), F.min("row").alias("row"))
    rows = materialize(rows.select("row", "words").join(different.select("row", "y"), "row"), "toxic-texts")
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    weight = lower_end(F.col("ones"), F.col("n"))
    telling = counts.where("ones > 0").select("word", weight.alias("weight")).where(F.col("weight") >= LEAST)
    chosen = {r.word: r.weight for r in telling.orderBy(F.col("weight").desc(), "word").limit(lexicon).collect()}
    rest = rows.where(~F.arrays_overlap("words", F.array(*map(F.lit, chosen)))) if chosen else rows
    n, ones = rest.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    return Lexicon(ones / (n + 1), chosen)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``, from whole texts.

    Null and empty texts have no words and score the leak, as any text without a word of the
    lexicon does; without a labelled row all scores are 0. Repeated rows are scored each, equal
    texts alike. Very long texts are scored whole; time grows with their length. Extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_ROWS):
        table = language_model(docs)
        lexicon = learn(docs, labels, table)
        rows = docs.select("doc_id", whole_text().alias("text"))
        id_type = rows.schema["doc_id"].dataType.simpleString()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer, only = Restorer.of(table), frozenset(lexicon.words)
            for batch in batches:
                scores = [lexicon.score(restorer.words(t, only)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        scored = rows.mapInArrow(score, f"doc_id {id_type}, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
