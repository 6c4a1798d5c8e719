"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text answers how long a piece of a document also
occurs in that text. Parsing a document greedily into longest matches gives its phrases; the
language that needs the fewest phrases, each priced at log2 of the labelled length, wins.

The automaton is turned into a table next[state, character class], with a mark where a phrase
begins, so a batch of texts is parsed in lock step by numpy: one table look-up per character and
language. A text longer than ``LANE`` is parsed as several lanes, all of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import fold

#: Labelled text per language, and of all languages together, in code points: the bound of
#: the sample that the automata are built from. Which rows, is decided by a hash of id and text.
TEXT_PER_LANGUAGE, TEXT_IN_ALL = 40_000, 400_000
#: Rows per language that the sample is taken from, and how many texts share the bound at least.
ROWS, TEXTS = 400, 40
FOLDS, HELD_OUT = 3, 1
LANE = 1024
BATCH = 4_000_000  # code points parsed at once
LETTERS = 62  # most frequent letters that get a class of their own; then other letters, and blanks
UNKNOWN = "und"
_MARK = np.int32(1 << 30)


def pieces(lengths: list[int], bound: int) -> list[int]:
    """How much of each text is learned, at most ``bound`` code points in all.

    The first texts give at most a ``TEXTS``-th of the bound each; where all of them leave room,
    longer ones give more, all up to the same length.
    """
    some, most, room = [], max(200, bound // TEXTS), bound
    for n in lengths:
        if room <= 0:
            break
        some.append(n)
        room -= min(n, most)
    if room > 0:
        room = bound
        for k, n in enumerate(sorted(some)):
            most = max(most, room // (len(some) - k))
            room -= min(n, most)
            if n > most:
                break
    out, room = [], bound
    for n in some:
        out.append(min(n, most, room))
        room -= out[-1]
    return out


def labelled_texts(docs: DataFrame, per_language: int = TEXT_PER_LANGUAGE, in_all: int = TEXT_IN_ALL) -> dict[str, str]:
    """Text by language from rows outside the held-out fold, at most ``per_language`` code points each.

    Per language the ``ROWS`` different rows of the smallest hashes are looked at, so a language
    with any labelled text is learned, and from several texts where it has them.
    """
    rows = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True))
    )
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text")).where("length(text) > 0")
    places = rows.groupBy("lang", "place").agg(F.max(F.length("text")).alias("n"))
    # The limit on the rank is taken in an eighth of a language's rows, then in what that leaves;
    # either is taken within each task before the exchange.
    eighth = F.pmod(F.xxhash64("place"), F.lit(8))
    for keys in (["lang", "eighth"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        places = places.withColumn("eighth", eighth).withColumn("nth", nth).where(F.col("nth") <= ROWS).select("lang", "place", "n")
    first = places.collect()  # ROWS per language at most
    if not first:
        return {}
    by_lang: dict[str, list] = {}
    for f in sorted(first, key=lambda f: (f["lang"], f["place"])):
        by_lang.setdefault(f["lang"], []).append(f)
    bound = max(1000, min(per_language, in_all // len(by_lang)))
    wanted = [(lang, f["place"], n) for lang, held in by_lang.items() for f, n in zip(held, pieces([f["n"] for f in held], bound), strict=False)]
    table = docs.sparkSession.createDataFrame(wanted, "lang string, place long, most int")
    drawn = rows.join(F.broadcast(table), ["lang", "place"]).select("lang", "place", F.substring("text", F.lit(1), F.col("most")).alias("text"))
    out: dict[str, list[str]] = {lang: [] for lang in by_lang}
    # Repeated rows have one place and are learned once.
    for r in sorted(drawn.groupBy("lang", "place").agg(F.min("text").alias("text")).toLocalIterator(), key=lambda r: (r["lang"], r["place"])):
        out[r["lang"]].append(r["text"])
    return {lang: "\n".join(texts) for lang, texts in sorted(out.items())}


def alphabet(texts: dict[str, str]) -> np.ndarray:
    """Class of each code point: 0 blank, 1 other letter, then the most frequent letters."""
    table = np.zeros(0x110000, np.uint8)
    letters = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
    for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]):
        table[ord(c)] = i + 2
    return table


def classes(text: str, table: np.ndarray) -> np.ndarray:
    """Classes of the lower-cased text; runs of blanks are one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = table[points]
    rare = np.flatnonzero((out == 0) & (points > 127))
    if len(rare):
        seen, where = np.unique(points[rare], return_inverse=True)
        out[rare] = np.array([chr(c).isalpha() for c in seen], np.uint8)[where]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def suffix_automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """next[state * width + class]: the following state times width; marked where a phrase begins.

    Online construction: at most two states per symbol. A missing transition begins a phrase
    with its class. At the root, where a text begins and which a class without any match leads
    to, every class does.
    """
    trans: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p != -1:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and trans[p].get(c) == q:
                    trans[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    root = np.zeros(width, np.int32)
    for c, s in trans[0].items():
        root[c] = s * width
    table = np.tile(root | _MARK, (len(trans), 1))
    for s, follow in enumerate(trans):
        for c, to in follow.items() if s else ():
            table[s, c] = to * width
    return table.reshape(-1)


class Parser:
    """The automata of all languages and the batch parse."""

    def __init__(self, texts: dict[str, str]):
        self.langs = list(texts)
        self.table = alphabet(texts)
        self.width = LETTERS + 2
        coded = [classes(t, self.table) for t in texts.values()]
        self.automata = [suffix_automaton(c, self.width) for c in coded]
        self.price = np.array([np.log2(max(2, len(c))) for c in coded])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language."""
        starts = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), LANE)]
        total = np.zeros((len(texts), len(self.langs)))
        if not starts:
            return total
        lanes = sorted((min(LANE, len(texts[i]) - at), i, at) for i, at in starts)[::-1]
        sizes = np.array([n for n, _, _ in lanes])
        grid = np.zeros((sizes[0], len(lanes)), np.int32)
        for k, (n, i, at) in enumerate(lanes):
            grid[:n, k] = texts[i][at : at + n]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than the step
        owner = np.array([i for _, i, _ in lanes])
        for j, automaton in enumerate(self.automata):
            state, begun = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int32)
            for step, k in enumerate(active):
                to = automaton[state[:k] + grid[step, :k]]
                begun[:k] += to >> 30
                np.bitwise_and(to, _MARK - 1, out=state[:k])
            total[:, j] = np.bincount(owner, weights=begun, minlength=len(texts))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        todo: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            bits = self.phrases([c for _, c in todo]) * self.price
            odds = np.exp2(np.maximum(-60.0, bits.min(axis=1, keepdims=True) - bits))
            best = bits.argmin(axis=1)
            for (i, _), b, p in zip(todo, best, 1 / odds.sum(axis=1), strict=True):
                langs[i], scores[i] = self.langs[b], float(p)
            todo.clear()

        for i, text in enumerate(texts):
            if text and (coded := classes(text, self.table)).any():
                todo.append((i, coded))
                size += len(coded)
                if size >= BATCH:
                    flush()
                    size = 0
        flush()
        return langs, scores


_PARSERS: dict[int, Parser] = {}


def parser_of(texts: dict[str, str]) -> Parser:
    """One parser per Python worker; the broadcast texts are small, the tables are built here."""
    key = hash(tuple(texts.items()))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]


def identify_languages(docs: DataFrame) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score.

    ``score`` is the share of the winner when each language's code length in bits is turned
    into a likelihood. Ties go to the first language by name. A text that is null or has no
    letter, and every text if no language could be learned, is ``und`` with score 0. Letters
    that no labelled text has end a phrase in every language alike.
    """
    texts = docs.sparkSession.sparkContext.broadcast(labelled_texts(docs))

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = parser_of(texts.value)
        for part in parts:
            langs, scores = parser.predict(part.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.select(
        "doc_id", (F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(0)) == HELD_OUT).alias("held_out"), predict("text").alias("got")
    ).select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))
