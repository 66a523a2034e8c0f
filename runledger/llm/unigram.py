"""SentencePiece encoding by unigram Viterbi, and decoding.

A text is encoded as the sequence of pieces with the highest sum of log scores.  Spaces
become the word mark and one mark is put in front.  No piece has a mark after another
character, so the best sequence of a text is that of its words one by one, and each
distinct word of a task is solved once while it is remembered.  Many words are solved
together: numpy walks a double-array trie from every character of all words at once, then
takes the best path position by position.

A character without a piece scores below every piece and is written as its UTF-8 bytes
(byte fallback).  Decoding joins pieces and bytes, turns marks into spaces and drops the
first one.  A text that itself contains the mark character decodes with a space there.

The scores are the file's for a unigram model.  A file of merges has ranks instead; they
are turned into the log shares of Zipf's law.  Nulls and empty texts have no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tries import ROOT, DoubleArray, double_array, flatten

MARK_CHAR = "▁"
MARK = MARK_CHAR.encode()
#: A character without a piece scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Distinct words remembered per task.
CACHE = 500_000
PIECE_CHARS = 2_000_000

_RUNS = re.compile(r" *[^ ]+| +")


@dataclass
class Vocabulary:
    """Pieces (id -> UTF-8 bytes) with log scores, and the ids of the 256 byte pieces by byte."""

    pieces: dict[int, bytes]
    scores: dict[int, float]
    byte_ids: dict[int, int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a piece model; unknown, control and unused entries are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, raw, byte_ids = {}, {}, {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
            pieces[i], raw[i] = model.id_to_piece(i).encode(), model.get_score(i)
    broken = [p for p in pieces.values() if MARK in p.lstrip(MARK_CHAR.encode()) and p.decode().lstrip(MARK_CHAR).count(MARK_CHAR)]
    if broken or len(byte_ids) != 256:
        raise ValueError("the model needs all byte pieces, and no word mark inside a piece")
    ranks = sorted(raw.values(), reverse=True)
    if all(float(s).is_integer() for s in ranks[: len(ranks) // 2]):
        place = {i: r for r, i in enumerate(sorted(raw, key=lambda i: (-raw[i], i)))}
        total = float(np.sum(1.0 / np.arange(1, len(raw) + 1)))
        raw = {i: -float(np.log((r + 1) * total)) for i, r in place.items()}
    return Vocabulary(pieces, raw, byte_ids)


class Segmenter:
    """The trie and score tables of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        ids = list(vocabulary.pieces)
        self.trie: DoubleArray = double_array((vocabulary.pieces[i], k) for k, i in enumerate(ids))
        self.ids = np.array(ids, np.int32)
        self.scores = np.array([vocabulary.scores[i] for i in ids], np.float32)
        self.unknown = np.float32(self.scores.min() - UNKNOWN_PENALTY)
        self.byte_ids = np.array([vocabulary.byte_ids[b] for b in range(256)], np.int32)

    def _matches(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece found at a character: start byte, end byte, piece (-1: the character as bytes)."""
        lead = np.flatnonzero((codes & 0xC0) != 0x80)
        after = np.append(lead[1:], len(codes))
        limit = np.repeat(bounds[1:], np.diff(bounds))
        single = np.zeros(len(lead), bool)
        found = []
        live, at = np.arange(len(lead)), lead.copy()
        state = np.full(len(lead), ROOT, np.int32)
        while len(live):
            state, there = self.trie.step(state, codes[at])
            live, at, state = live[there], at[there] + 1, state[there]
            hit = self.trie.value[state] >= 0
            found.append((lead[live[hit]], at[hit], self.trie.value[state[hit]]))
            single[live[hit]] |= at[hit] == after[live[hit]]
            more = at < limit[lead[live]] if len(live) else np.zeros(0, bool)
            live, at, state = live[more], at[more], state[more]
        lone = np.flatnonzero(~single)
        found.append((lead[lone], after[lone], np.full(len(lone), -1, np.int32)))
        start, end, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        return start, end, piece

    def segment(self, words: list[bytes]) -> list[bytes]:
        """The best piece ids of each non-empty word, as little-endian int32."""
        codes, bounds = flatten(words)
        owner = np.repeat(np.arange(len(words)), np.diff(bounds))
        start, end, piece = self._matches(codes, bounds)
        place = start - bounds[owner[start]]
        order = np.lexsort((end, start, place))
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        score = np.where(piece < 0, self.unknown, self.scores[piece]).astype(np.float32)
        # One node before each byte and one after the word's last byte.
        origin, target = start + owner[start], end + owner[start]
        best = np.full(len(codes) + len(words), -np.inf, np.float32)
        back = np.full(len(best), -1, np.int64)
        best[bounds[:-1] + np.arange(len(words))] = 0
        edges = np.searchsorted(place, np.arange(int(place.max(initial=-1)) + 2))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            # Matches of one place end at different nodes, so no two write to the same one.
            reached = best[origin[a:b]] + score[a:b]
            better = np.flatnonzero(reached > best[target[a:b]]) + a
            best[target[better]] = reached[better - a]
            back[target[better]] = better
        node = bounds[1:] + np.arange(len(words))
        stop = bounds[:-1] + np.arange(len(words))
        live = np.arange(len(words))
        steps = []
        while len(live):
            taken = back[node[live]]
            steps.append((live, taken))
            node[live] = origin[taken]
            live = live[node[live] > stop[live]]
        who = np.concatenate([s[0] for s in steps])
        taken = np.concatenate([s[1] for s in steps])
        order = np.lexsort((start[taken], who))
        who, taken = who[order], taken[order]
        lone = piece[taken] < 0
        width = np.where(lone, end[taken] - start[taken], 1)
        first = np.concatenate([[0], np.cumsum(width)])
        offset = np.arange(first[-1]) - np.repeat(first[:-1], width)
        spread = np.repeat(taken, width)
        ids = np.where(
            np.repeat(lone, width),
            self.byte_ids[codes[np.minimum(start[spread] + offset, len(codes) - 1)]],
            self.ids[np.maximum(piece[spread], 0)],
        ).astype("<i4")
        sizes = np.bincount(who, weights=width, minlength=len(words)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)]) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _words(text: str) -> list[str]:
    """The words of a text with the space before each, and longer runs of spaces with the word after them."""
    if "  " in text or text.startswith(" ") or text.endswith(" "):
        return _RUNS.findall(" " + text)
    return [" " + w for w in text.split(" ")]


class Coder:
    """Encodes and decodes texts; remembers words.  One per task."""

    def __init__(self, vocabulary: Vocabulary, segmenter: Segmenter):
        self.segmenter = segmenter
        self.known: dict[str, bytes] = {}
        self.spelled = [b""] * (max([*vocabulary.pieces, *vocabulary.byte_ids.values()]) + 1)
        for i, p in vocabulary.pieces.items():
            self.spelled[i] = p.replace(MARK, b" ")
        for b, i in vocabulary.byte_ids.items():
            self.spelled[i] = bytes([b])

    def _learn(self, groups: list[list[str]]) -> None:
        fresh = {w for words in groups for w in words}.difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = {w for words in groups for w in words}
        if fresh:
            fresh = list(fresh)
            ids = self.segmenter.segment([w.replace(" ", MARK_CHAR).encode() for w in fresh])
            self.known.update(zip(fresh, ids, strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Piece ids of each text."""
        for group in _grouped(texts):
            words = [_words(t) if t else [] for t in group]
            self._learn(words)
            get = self.known.__getitem__
            for w in words:
                yield np.frombuffer(b"".join(map(get, w)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        spell = self.spelled
        return b"".join([spell[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def _grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > PIECE_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: bool = True, column: str = "piece_ids"
) -> DataFrame:
    """``docs`` with its text, plus ``n_pieces``, ``ids_crc32``, ``round_trip`` (the ids decode to the text)
    and, if ``ids``, the piece ids (null for a null text); they replace columns of those names.  One
    pass, no shuffle."""
    import zlib

    rest = [c for c in docs.columns if c not in (text, "n_pieces", "ids_crc32", "round_trip", column)]
    schema = docs.select(*[F.col(f"`{c}`") for c in [*rest, text]]).schema
    schema = schema.add("n_pieces", "long").add("ids_crc32", "long").add("round_trip", "boolean")
    if ids:
        schema = schema.add(column, T.ArrayType(T.IntegerType()))
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, Segmenter(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            start = 0
            for group in _grouped(batch.column(len(rest)).to_pylist()):
                encoded = list(coder.encode(group))
                figures = [
                    pa.array([len(e) for e in encoded], pa.int64()),
                    pa.array([zlib.crc32(e.tobytes()) for e in encoded], pa.int64()),
                    pa.array([coder.decode(e) == (t or "") for e, t in zip(encoded, group, strict=True)]),
                ]
                if ids:
                    rows = [None if t is None else e for e, t in zip(encoded, group, strict=True)]
                    figures.append(pa.array(rows, pa.list_(pa.int32())))
                part = batch.slice(start, len(group))
                start += len(group)
                yield pa.RecordBatch.from_arrays([*part.columns, *figures], names)

    return docs.select(*[F.col(f"`{c}`") for c in [*rest, text]]).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, column: str = "piece_ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its piece ids in ``text`` (null for null ids)."""
    rest = [c for c in encoded.columns if c not in (column, text)]
    schema = encoded.select(*[F.col(f"`{c}`") for c in rest]).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary, None)
        for batch in batches:
            ids = batch.column(len(rest))
            texts = [None if row is None else coder.decode(np.array(row, np.int32)) for row in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*rest, text])

    return encoded.select(*[F.col(f"`{c}`") for c in [*rest, column]]).mapInArrow(run, schema)
