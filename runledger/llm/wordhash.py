"""Words, lines and shingles of whole Arrow batches as numpy arrays.

Texts stay the UTF-8 bytes that Arrow delivers.  Word boundaries are byte classes, and a
word is identified by a 64-bit hash of its bytes (two different words of one comparison
share a hash with a probability of about 2**-60).  Nothing loops over words in Python, and
a batch is worked off in pieces of a few megabytes, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2_000_000

_RNG = np.random.default_rng(20_240_601)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPREAD = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``: anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text: digits, a-z, non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Piece:
    """Some texts of a batch, end to end: ``data`` holds their bytes, text i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of an Arrow column in pieces of about ``limit`` bytes; null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        end = min(end, n)
        yield Piece(start, data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
        start = end


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per byte or item) between consecutive bounds, as int64."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Words:
    """Words in text order: byte ranges, hashes, and for text i the words bounds[i]:bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def _segment_hashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each segment that begins at ``starts`` and ends where the next one begins."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, n))
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    place = np.arange(starts[0], n) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(values[starts[0] :] * powers[place], starts - starts[0]))


def words(piece: Piece, word_bytes: np.ndarray, lower: bool) -> Words:
    """Maximal runs of ``word_bytes``; runs end where their text ends."""
    data = _LOWER[piece.data] if lower else piece.data
    n = len(data)
    inside = word_bytes[data]
    first = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        edges = piece.bounds[:-1][piece.bounds[:-1] < n]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = piece.bounds[1:][piece.bounds[1:] > 0] - 1
        last[ends] = inside[ends]
    else:
        last = first
    starts = np.flatnonzero(first)
    hashes = _segment_hashes(np.where(inside, _BYTE_VALUES[data], np.uint64(0)), starts, n)
    return Words(starts, np.flatnonzero(last) + 1, hashes, np.searchsorted(starts, piece.bounds))


def prefix_hashes(piece: Piece, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` lower-cased bytes from each start; other than the hash of any word."""
    total = np.full(len(starts), size, np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += _BYTE_VALUES[_LOWER[piece.data[starts + k]]] * power
            power *= _BASE
    return mix(total ^ _SPREAD[15])


def line_hashes(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines split at \\n: start bytes, hashes of all their bytes, and the text each belongs to."""
    n = len(piece.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    feeds = piece.data == 10
    first = np.zeros(n, bool)
    first[1:] = feeds[:-1]
    first[piece.bounds[:-1][piece.bounds[:-1] < n]] = True
    starts = np.flatnonzero(first)
    values = np.where(feeds, np.uint64(0), _BYTE_VALUES[piece.data])
    return starts, _segment_hashes(values, starts, n), np.searchsorted(piece.bounds, starts, "right") - 1


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one text, and the index of its first word."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * _SPREAD[k]
    left = np.repeat(bounds[1:], np.diff(bounds))  # where the text of each word ends
    at = np.flatnonzero(np.arange(n - size + 1) + size <= left[: n - size + 1])
    return mix(total[at] + np.uint64(size)), at


def sequence_hashes(hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of all words of each of the given non-empty texts, as one shingle."""
    out = np.zeros(len(rows), np.uint64)
    for i, r in enumerate(rows):
        part = hashes[bounds[r] : bounds[r + 1]]
        out[i] = (part * _SPREAD[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out)


def distinct_shingles(piece: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in lower case: (text, hash), ordered by both.

    A text of fewer words, but at least one, has one shingle of all its words."""
    found = words(piece, NOT_SPACE, lower=True)
    hashes, at = shingles(found.hashes, found.bounds, size)
    owner = found.text_of()[at]
    counts = found.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hashes = np.concatenate([hashes, sequence_hashes(found.hashes, found.bounds, short)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new]
