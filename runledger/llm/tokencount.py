"""Counts of greedy word pieces, by an automaton that reads each character once.

The vocabulary is a trie.  A state whose string is a token fails to the state after that
token; any other state follows its parent's failure links until the next character fits.
Each link carries the number of tokens that it pops (linear maximum matching), so a word's
piece count is the sum of the numbers on the links taken, and no piece is ever built.
Many words advance together, one character per numpy step; each distinct word of a task is
counted once while it is remembered.

The count of a word is that of longest-match-first splitting.  A word that cannot be split
is one unknown token.  Words are runs of letters, single digits, or runs of other visible
characters, each with the word mark before it.  Nulls and texts without words count 0; every row is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tries import ROOT, DoubleArray, double_array, flatten
from .unigram import MARK, Vocabulary

#: Code after the 256 bytes that leads to the tokens inside a word.
INNER = 256
#: Distinct words remembered per task.
CACHE = 400_000
PIECE_CHARS = 2_000_000

_WORD = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+|[^\W]")


def piece_vocabulary(vocabulary: Vocabulary) -> list[tuple[bytes, bool]]:
    """Tokens as (bytes, may it only follow others).  Pieces with a word mark begin words, all
    others continue them; single bytes continue too, so that no word is unknown."""
    tokens = [(piece, not piece.startswith(MARK)) for piece in vocabulary.pieces.values()]
    return tokens + [(bytes([b]), True) for b in vocabulary.byte_ids]


class Automaton:
    """States, failure links and popped counts; ``-1`` links nowhere."""

    def __init__(self, tokens: list[tuple[bytes, bool]]):
        """``tokens``: (bytes, may it only follow others); the latter hang below a root of their own."""
        keys = [((INNER, *token) if inside else token, i) for i, (token, inside) in enumerate(tokens) if token]
        self.trie: DoubleArray = double_array([((INNER,), len(tokens)), *keys], INNER + 1)
        t, n = self.trie, len(self.trie.base)
        self.again = int(t.base[ROOT] + INNER)
        fail, popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        # Breadth first, so that shorter strings are done when a longer one asks for them.
        for state, parent, code in zip(t.order[1:].tolist(), t.parent[1:].tolist(), t.code[1:].tolist(), strict=True):
            if state == self.again:
                continue
            if t.value[state] >= 0:
                fail[state], popped[state] = self.again, 1
                continue
            link, count = int(fail[parent]), int(popped[parent])
            while link >= 0:
                cell = int(t.base[link]) + code
                if cell < n and t.check[cell] == link:
                    fail[state], popped[state] = cell, count
                    break
                count += int(popped[link])
                link = int(fail[link])
        self.fail, self.popped = fail, popped

    def count(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, and whether it is unknown."""
        codes, bounds = flatten(words)
        lengths = np.diff(bounds)
        state, total = np.full(len(words), ROOT, np.int32), np.zeros(len(words), np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        sizes = -lengths[by_length]
        for j in range(int(lengths.max(initial=0))):
            live = by_length[: np.searchsorted(sizes, -j, "left")]
            live = live[state[live] >= 0]
            if not len(live):
                continue
            code = codes[bounds[live] + j]
            while len(live):
                cells, there = self.trie.step(state[live], code)
                state[live[there]] = cells[there]
                live, code = live[~there], code[~there]
                total[live] += self.popped[state[live]]
                state[live] = self.fail[state[live]]
                alive = state[live] >= 0
                live, code = live[alive], code[alive]
        live = np.flatnonzero((state >= 0) & (state != self.again) & (lengths > 0))
        while len(live):
            total[live] += self.popped[state[live]]
            state[live] = self.fail[state[live]]
            live = live[(state[live] >= 0) & (state[live] != self.again)]
        unknown = state < 0
        total[unknown] = 1
        return total, unknown


class Counter:
    """An automaton and the counts of the words it has met; one per task."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.known: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        fresh = list({w for w in words if w not in self.known})
        if fresh:
            if len(self.known) + len(fresh) > CACHE:
                self.known.clear()
                fresh = list(set(words))
            total, unknown = self.automaton.count([MARK + w.encode() for w in fresh])
            self.known.update(zip(fresh, np.where(unknown, -total, total).tolist(), strict=True))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Per text: words, tokens, unknown words."""
        out, waiting, size = [], [], 0
        for t in [*texts, None]:
            waiting.append(_WORD.findall(t) if t else [])
            size += len(t or "")
            if size > PIECE_CHARS or len(out) + len(waiting) == len(texts) + 1:
                self._learn([w for words in waiting for w in words])
                get = self.known.__getitem__
                for words in waiting:
                    counts = np.fromiter(map(get, words), np.int64, len(words))
                    out.append((len(words), int(np.abs(counts).sum()), int((counts < 0).sum())))
                waiting, size = [], 0
        return np.array(out[:-1], np.int64).reshape(-1, 3)


def count_tokens(docs: DataFrame, automaton: Automaton, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_words``, ``n_tokens`` and ``n_unknown`` (which replace columns of those
    names); one pass, no shuffle."""
    added = ["n_words", "n_tokens", "n_unknown"]
    rest = [c for c in docs.columns if c not in (text, *added)]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for name in added:
        schema = schema.add(name, "long")
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            found = counter.texts(batch.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in found.T)], [*rest, *added])

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(run, schema)
