"""How a tokenizer of the installed library cuts a text into words before it merges anything."""

from __future__ import annotations

import re
from functools import lru_cache

import regex
from tokenizers import Tokenizer as Library

#: The tokenizer's own file, as installed; any file of the same kind may be named instead.
VOCABULARY = "word_bpe_49k.json"
#: Words and chunks that a worker remembers before it forgets the older half.
REMEMBERED = 300_000

# The tokenizer's white space, and how it splits lower-case ASCII.
_BLANKS = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = regex.compile(r"[\x1c-\x1f]")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: Below it normalisation leaves every character as it is, and letters and case are settled.
_SETTLED = "\u0300"
_STOPS = frozenset(".,;:!?")


def file_of(name: str) -> str:
    """A file name alone is looked up among the installed vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def library(name: str) -> Library:
    """The library's own tokenizer, without truncation and padding."""
    made = Library.from_file(file_of(name))
    made.no_truncation()
    made.no_padding()
    return made


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Remembered(dict):
    """Results by key in two generations: when the younger is full it becomes the older, and what is used moves back.

    ``made`` counts what had to be made anew.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.made = make, {}, 0

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            self.made += 1
        if len(key) < 64:
            self[key] = found
        return found


class Chunks(Remembered):
    """Results of chunks; one with a word seen for the first time is not kept, as most such chunks do not come again."""

    def __init__(self, make, of: Remembered):
        super().__init__(make)
        self.of = of

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            before = self.of.made
            found = self.make(key)
            if self.of.made != before:
                return found
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = found
        return found


def chunks(text: str) -> list[str]:
    """A text cut at its white space, which no word of the tokenizer crosses."""
    return [c for c in _BLANKS.split(text) if c] if _ODD.search(text) else text.split()


class Splitter:
    """Cuts a chunk without blanks into special tokens (their ids) and words (in byte letters)."""

    def __init__(self, name: str):
        held = library(name)
        self.special = {token.content: i for i, token in held.get_added_tokens_decoder().items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._normalizer, self._cutter = held.normalizer, held.pre_tokenizer
        self._letters = dict(enumerate(byte_letters()))

    def _shown(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self._letters)

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii():
            found = _ASCII.findall(chunk.lower())
            return found if chunk.isprintable() else list(map(self._shown, found))
        # The library's own tables tell letters, numbers and case, whatever Unicode they are of.
        return [word for word, _ in self._cutter.pre_tokenize_str(self._normalizer.normalize_str(chunk))]

    def split(self, chunk: str) -> list[int | str]:
        stop = chunk[-1] in _STOPS
        word = chunk[:-1] if stop else chunk
        if word.isalpha():
            if word.isascii():
                return [word.lower(), chunk[-1]] if stop else [word.lower()]
            if max(word) < _SETTLED and word.lower().isalpha():
                shown = self._shown(word.lower())
                return [shown, chunk[-1]] if stop else [shown]
        if self._special is None or not self._special.search(chunk):
            return self._words(chunk)
        found: list[int | str] = []
        for part in self._special.split(chunk):
            if part:
                found.extend([self.special[part]] if part in self.special else self._words(part))
        return found
