"""Byte-pair encoding by a token automaton, and decoding by its arc labels."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhand.llm import words
from tallyhand.llm.words import VOCABULARY

#: Transitions that a worker keeps before it forgets them all.
KEPT_TRANSITIONS = 1_000_000

_END = "</w>"


class Automaton:
    """A deterministic automaton over tokens: its paths are the tokenizations that the merges make.

    It begins as one state with an arc to itself for each base symbol. The merges are compiled
    one after the other. The gadget of ``u v -> w`` splits the state behind u: the arc v is cut
    there, and wherever u could be followed by v a new arc w leads past both, to where v led.
    So a state is known by the token last read, and what a gadget does is one cut and one
    inheritance: the state behind w is the one behind v as it was. ``cut``, ``left``, ``right``
    and ``born`` hold these for all gadgets; the transition table is filled from them the first
    time a transition is asked for. States and arcs are token ids.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = {i: t for t, i in vocabulary.items()}
        self.size = max(self.labels, default=0) + 1
        self.left, self.right, self.born = {}, {}, [-1] * self.size
        self.cut: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        #: Arcs by their symbols: each branch maps a symbol on, "" to a token inside a word and None to one that ends it.
        self.arcs: dict = {}
        for token, i in vocabulary.items():
            ends = token.endswith(_END) and token != _END
            branch = self.arcs
            for symbol in token[: -len(_END)] if ends else token:
                branch = branch.setdefault(symbol, {})
            branch[None if ends else ""] = i
        for at, (u, v) in enumerate(merges):
            self._gadget(vocabulary[u], vocabulary[v], vocabulary[u + v], at)
        #: The first state has an arc for each base symbol, and for each token whose gadget found a place.
        self.starts = [False] * self.size
        for i in sorted(self.labels, key=self.born.__getitem__):
            self.starts[i] = self.born[i] < 0 or self.starts[self.left[i]] and self._open(self.left[i], self.right[i], self.born[i])

    def _gadget(self, u: int, v: int, w: int, at: int) -> None:
        self.cut.setdefault(u * self.size + v, at)
        if self.born[w] < 0:
            self.left[w], self.right[w], self.born[w] = u, v, at

    def _open(self, state: int, arc: int, at: int) -> bool:
        """Whether the state had the arc before gadget ``at``."""
        return self.cut.get(state * self.size + arc, at) >= at and self._first(state, arc)

    def _first(self, state: int, arc: int) -> bool:
        """Whether the arc was there when state and arc first both were."""
        key = state * self.size + arc
        known = self.table.get(key)
        if known is None:
            at = self.born[arc]
            if at > self.born[state]:
                known = self._open(self.left[arc], self.right[arc], at) and self._open(state, self.left[arc], at + 1)
            elif (at := self.born[state]) >= 0:
                known = self._open(self.right[state], self.left[arc] if arc == state else arc, at)
            else:
                known = True
            self.table[key] = known
        return known

    def tokens(self, symbols: str) -> list[int]:
        """The one path that spells a word, whose last token is one that ends a word.

        Of all tokens that end at a place exactly one continues the path to where it begins, so
        the automaton goes from place to place with one state for each.
        """
        n, size, cut, table = len(symbols), self.size, self.cut, self.table
        if len(table) > KEPT_TRANSITIONS:
            table.clear()
        state: list[int] = [-1] * (n + 1)
        came = [0] * (n + 1)
        for start in range(n):
            here = state[start]
            branch, end = self.arcs, start
            while end < n:
                branch = branch.get(symbols[end])
                if branch is None:
                    break
                end += 1
                token = branch.get(None if end == n else "")
                if token is None:
                    continue
                if start == 0:
                    goes = self.starts[token]
                else:
                    key = here * size + token
                    goes = key not in cut and (table[key] if key in table else self._first(here, token))
                if goes:
                    state[end], came[end] = token, start
        path, end = [], n
        while end:
            path.append(state[end])
            end = came[end]
        return path[::-1]


class Tokenizer:
    """Encodes texts by the automaton, and remembers words and the chunks between blanks."""

    def __init__(self, file: str):
        with open(words.file_of(file), encoding="utf-8") as f:
            held = json.load(f)
        self.automaton = Automaton(held["model"]["vocab"], [tuple(m) for m in held["model"]["merges"]])
        self._splitter = words.Splitter(file)
        self.automaton.labels |= {i: t for t, i in self._splitter.special.items()}
        self._words = words.Remembered(self._word)
        self._chunks = words.Chunks(self._chunk, self._words)

    def _shown(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def _word(self, word: str) -> tuple[str, str]:
        return self._shown(self.automaton.tokens(word))

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """The ids and the labels of a text without blanks, each joined by spaces."""
        found = [self._shown([part]) if isinstance(part, int) else self._words[part] for part in self._splitter.split(chunk)]
        return found[0] if len(found) == 1 else (" ".join([f[0] for f in found]), " ".join([f[1] for f in found]))

    def shown(self, text: str) -> tuple[str, str]:
        """The ids of a whole text and the labels of its arcs, each joined by spaces."""
        found = list(map(self._chunks.__getitem__, words.chunks(text)))
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.shown(text)[0].split()))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, parted by spaces: this tokenizer names no decoder of its own."""
        return " ".join([self.automaton.labels[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(file: str) -> Tokenizer:
    """One tokenizer for each worker."""
    return Tokenizer(file)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encoded(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (the token ids of the whole text) for each document; null counts as empty."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = tokenizer(file)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [made.encode(t) for t in part["text"]]})

    return _named(docs).mapInPandas(encode, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def _named(docs: DataFrame) -> DataFrame:
    """Ids as text: pandas would turn long ones beside a null into floats."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def digests(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document.

    A null text counts as empty and has no tokens; rows repeat as they come; an empty table
    gives no rows; other columns are ignored. A task holds one batch of texts and one text's ids.
    """

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = tokenizer(file)
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                ids, labels = made.shown(text)
                rows.append((doc_id, ids.count(" ") + 1 if ids else 0, _sha256(ids), _sha256(labels)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    found = _named(docs).mapInPandas(encode, "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
