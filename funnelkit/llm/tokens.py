"""Whole-text encoding with the ``tokenizers`` library, one word at a time.

Both public vocabularies split a text into pieces before any merge is looked up, and no
piece crosses the step from a visible character to a blank.  The ids of a text are therefore
the ids of its blank-separated words, joined.  ``WordEncoder`` asks the library once for each
word it has not met and keeps the answer as little-endian unsigned 16-bit ids, so a text costs
one dictionary lookup a word.  Whatever does not have the plain form "words parted by one
space or one newline" goes through the library as a whole, so the ids always equal
``Tokenizer.encode(text, add_special_tokens=False).ids``.

A Latin word with ASCII signs behind it ("word,", "word!!") is the word and one piece of signs; only short ones are
kept as words of their own, since long ones hardly come again.

The cache holds at most ``CACHE_WORDS`` words of at most ``CACHE_LETTERS`` characters and starts afresh when it is
full; longer words are encoded each time.
"""

from __future__ import annotations

import os
import sys
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_WORDS = 800_000
CACHE_LETTERS = 64
#: Longest word with signs behind it that is kept.
SHORT = 6
#: ASCII signs that form one piece behind letters; an apostrophe may belong to the word, and < may begin a special token.
SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


class _Whole(Exception):
    """The text has to be encoded in one call."""


def _latin(word: str) -> bool:
    """Only letters of the Latin-1 range, for which case and normal form are plain."""
    return word.isalpha() and max(word) < "Ā"


def _byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordEncoder(dict):
    """Words to packed ids; a missing word is encoded and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = dict(enumerate(_byte_letters()))
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits; this vocabulary has more")
        self._signs: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array("H", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _ids(self, text: str) -> bytes:
        return self._pack(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, word: str) -> bytes:
        """Ids of one piece, its bytes written as the model sees them."""
        return self._pack([t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._letters))])

    def _signed(self, key: str) -> bytes | None:
        """Ids of a Latin word with signs behind it, else None."""
        stem = key.rstrip(SIGNS)
        if len(stem) == len(key) or not _latin(stem):
            return None
        signs = key[len(stem):]
        piece = self._signs.get(signs)
        if piece is None:
            piece = self._merged(signs)
            if len(signs) <= SHORT and len(self._signs) < CACHE_WORDS:
                self._signs[signs] = piece
        value = self[stem] + piece
        return self._keep(key, value) if len(key) <= SHORT else value

    def _keep(self, key: str, value: bytes) -> bytes:
        if len(key) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value

    def encode(self, text: str) -> bytes:
        raise NotImplementedError


class SpacedEncoder(WordEncoder):
    """For vocabularies whose words carry the blank before them (byte_bpe_50k).

    Keys: ``word`` stands for " word", ``\\nword`` for a word that begins a line.
    """

    def __missing__(self, key: str) -> bytes:
        if key.isalpha() and key.isascii():
            return self._keep(key, self._pack([t.id for t in self._model.tokenize(self._blank + key)]))
        value = self._signed(key)
        if value is not None:
            return value
        first = key[:1] == "\n"
        word = key[1:] if first else key
        if len(word.split()) != 1 or "<|" in word or word != word.strip():
            raise _Whole
        return self._keep(key, self._line_break + self._word(word, "") if first else self._word(word, " "))

    def _word(self, word: str, blank: str) -> bytes:
        if _latin(word):
            return self._merged(blank + word)
        stem = "" if blank else word.rstrip(SIGNS)
        if stem != word and _latin(stem):  # at the start of a line
            return self._merged(stem) + self._merged(word[len(stem):])
        return self._ids(blank + word)

    def __init__(self, path: str):
        super().__init__(path)
        self._blank = self._letters[0x20]
        self._line_break = self._ids("\n")

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not text:
            return b""
        try:
            words = ("\n" + text).replace("\n", " \n").split(" ")
            words[0] = None
            return b"".join(map(self.__getitem__, words[1:]))[len(self._line_break):]
        except _Whole:
            return self._ids(text)


class BareEncoder(WordEncoder):
    """For vocabularies that drop blanks and case (word_bpe_49k)."""

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            return self._keep(word, self._pack([t.id for t in self._model.tokenize(word.lower())]))
        value = self._signed(word)
        if value is not None:
            return value
        if "<|" in word:
            raise _Whole
        if not word:
            value = b""
        elif _latin(word):
            lower = word.lower()
            value = self._merged(lower) if lower == word else self[lower]
        else:
            value = self._ids(word)
        return self._keep(word, value)

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        try:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        except _Whole:
            return self._ids(text)


_encoders: dict[tuple[type, str], WordEncoder] = {}


def encoder(kind: type[WordEncoder], path: str) -> WordEncoder:
    """The encoder of this Python process for a vocabulary file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
