"""Words of the public word tokenizer, and their ids.

Encoding a text is: cut special tokens out, normalise what lies between, split it into words,
encode each word by itself. All but the last step are done here the way the tokenizer file says,
so each distinct word has to be encoded only once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from tokenizers import Tokenizer

#: Where the tokenizer files are: a module with ``path(name)``.
VOCABULARY = "word_bpe_49k.json"

#: The file's split pattern, for texts of code points below 256 only, in lower case.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa00-9a-zªµºß-öø-ÿ²³¹¼½¾]+")


def _latin(text: str) -> bool:
    """Whether all code points are below 256."""
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Splits texts into words and encodes words, as the tokenizer of the file does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.stand_in = str.maketrans({b: c for b, c in byte_letters().items()})
        self.real = {c: b for b, c in byte_letters().items()}

    def words(self, text: str) -> list[str]:
        """Words in order; special tokens come out as themselves."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if _latin(text):
            return _LATIN.findall(text.lower())
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        real = self.real
        return [bytes([real[c] for c in word]).decode("utf-8") for word, _ in split]

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        stand_in = word.encode("utf-8").decode("latin-1").translate(self.stand_in)
        return [t.id for t in self.tokenizer.model.tokenize(stand_in)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    return WordEncoder(path)


class CachedIds:
    """Ids of a text as bytes, with a bounded memory of words already encoded."""

    def __init__(self, path: str, width: int, most: int = 400_000):
        self.encoder, self.width, self.most = encoder(path), width, most
        self.known: dict[str, bytes] = {}

    def __missing(self, word: str) -> bytes:
        if len(self.known) >= self.most:
            self.known.clear()
        out = self.known[word] = b"".join(i.to_bytes(self.width, "little") for i in self.encoder.ids(word))
        return out

    def encode(self, text: str) -> bytes:
        known, missing = self.known.get, self.__missing
        return b"".join([known(w) or missing(w) for w in self.encoder.words(text)])


def batches(texts: Iterator[str], size: int) -> Iterator[list[str]]:
    """Lists of texts of about ``size`` code points."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
