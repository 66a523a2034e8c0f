"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

Every text is encoded by a byte-level tokenizer (A, on a space and the text) and by a piece
tokenizer (B, on the text, before which it puts a space itself), whole and with the strings of
special tokens as plain text.  The byte offsets where tokens end form one ascending list each.
Both are intersected by galloping: the shorter list of a document drives, and each of its ends
is sought in the longer one from the place of the last find on, first by doubling steps and
then by halving the stretch that the last step passed over.  A batch's lists are cut into lanes
that gallop side by side.  Consecutive common ends delimit a group; the differences of their
ranks say how many tokens of A and of B it holds, and each of the former is linked with each
of the latter.

A pair of ids counts once for every document that links it.  Documents keep their distinct
pairs with multiplicities, pairs are counted over all documents, and the counts come back:
those of the ``FREQUENT`` pairs in most documents are sent to all tasks (at most 16 bytes
each, however large the corpus), and those of all others are joined by pair.  A pair that is
joined is in fewer documents than ``FREQUENT`` others, so no key of that join is hot.

Texts that are null or empty, or that a tokenizer does not give back byte by byte (the piece
tokenizer may normalise), have no tokens: zeros and empty groups.  Repeated rows and keys are
documents of their own and come back each; a null key stays null.  Of other columns none is
returned, whatever their names.  An empty table gives an empty one.  A group of many tokens is
never expanded into its pairs: distinct ids are multiplied with their counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import cut
from . import wordhash as H

#: So many pairs, those of most documents, are sent to every task.
FREQUENT = 400_000
PIECE_BYTES = 400_000
#: Ends of one document that one lane works off.
LANE = 64
#: Groups of more links than this are multiplied by distinct ids.
WIDE = 256
#: A and B ids share a 64-bit key.
SHIFT = 32

# The pattern that the byte-level tokenizer cuts words by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that overflows the backtracking of that pattern's look-ahead.
_LONG_SPACE = re.compile(r"\s{2000}")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others, in order, for those from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Vocabulary:
    """Bytes of every id, end to end."""

    def fill(self, entries: list[bytes]) -> None:
        self.lengths = np.array([len(e) for e in entries], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        text = [str(i) for i in range(len(entries))]
        self.digits = np.array([len(t) for t in text], np.int8)
        self.decimal = np.frombuffer("".join(t.ljust(10) for t in text).encode(), np.uint8).reshape(-1, 10)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.lengths[ids].astype(np.int64)
        return self.bytes[_ranges(self.starts[ids], size)]


class ByteLevel(_Vocabulary):
    """Byte-level BPE from a tokenizer file.  Words are merged by rank in native code; texts with very long
    white space go to the tokenizers library, whose pattern matcher has no such limit."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        entries = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            entries[i] = token
        self.fill(entries)
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if not _LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids


class Pieces(_Vocabulary):
    """A piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.fill([self._bytes(self.model.id_to_piece(i), self.model.is_byte(i)) for i in ids])

    @staticmethod
    def _bytes(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start, ..., start + size - 1, one range after the other."""
    size = size.astype(np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def gallop(ends: np.ndarray, cursor: np.ndarray, target: np.ndarray) -> np.ndarray:
    """First places from ``cursor`` on whose value is not below ``target``; each exists."""
    low, high = cursor.copy(), cursor.copy()
    step = np.ones(len(cursor), np.int64)
    going = np.flatnonzero(ends[high] < target)
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step[going], len(ends) - 1)
        step[going] *= 2
        going = going[ends[high[going]] < target[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        below = ends[middle] < target[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


def common_ends(short: np.ndarray, bounds: np.ndarray, long: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``short``, in ``long``) of equal values.  Document d drives with short[bounds[d]:bounds[d + 1]]
    and is sought from long[first[d]] on; its last end is in both lists."""
    size = np.diff(bounds)
    lanes = -(-size // LANE)
    doc = np.repeat(np.arange(len(size)), lanes)
    at = bounds[doc] + LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(at + LANE, bounds[doc + 1])
    cursor = first[doc].astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        target = short[at]
        cursor = gallop(long, cursor, target)
        hit = long[cursor] == target
        found.append((at[hit], cursor[hit]))
        at = at + 1
        live = at < stop
        if not live.all():
            at, stop, cursor = at[live], stop[live], cursor[live]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(int(sizes.sum()), np.int32)
    at = 0
    for x in lists:
        out[at : at + len(x)] = x
        at += len(x)
    return out, np.concatenate([[0], np.cumsum(sizes)])


class _Aligned:
    """The groups of some texts that both tokenizers give back: tokens, group sizes and bounds per text."""

    def __init__(self, texts: list[str], a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        raw = [t.encode() for t in texts]
        self.ids_a, bounds_a = _flat(a.encode(texts))
        self.ids_b, bounds_b = _flat(b.encode(texts))
        want = np.frombuffer(b"".join(b" " + r for r in raw), np.uint8)
        size = np.array([len(r) + 1 for r in raw], np.int64)
        self.ok = np.ones(len(texts), bool)
        for vocabulary, ids, bounds in ((a, self.ids_a, bounds_a), (b, self.ids_b, bounds_b)):
            self.ok &= self._same(vocabulary, ids, bounds, want, size)
        self.ids_a, bounds_a = self._only(self.ids_a, bounds_a)
        self.ids_b, bounds_b = self._only(self.ids_b, bounds_b)
        self.bounds_a, self.bounds_b = bounds_a, bounds_b
        ends_a = np.cumsum(a.lengths[self.ids_a], dtype=np.int64)
        ends_b = np.cumsum(b.lengths[self.ids_b], dtype=np.int64)
        # All kept texts lie end to end in both lists, so their offsets agree.
        a_drives = np.diff(bounds_a) <= np.diff(bounds_b)
        at_a, at_b = self._driven(a_drives, ends_a, bounds_a, ends_b, bounds_b)
        more_b, more_a = self._driven(~a_drives, ends_b, bounds_b, ends_a, bounds_a)
        at_a, at_b = np.concatenate([at_a, more_a]), np.concatenate([at_b, more_b])
        order = np.argsort(at_a, kind="stable")
        at_a, at_b = at_a[order], at_b[order]
        self.first_a, self.n_a = np.append(0, at_a[:-1] + 1)[: len(at_a)], np.diff(np.append(-1, at_a))
        self.first_b, self.n_b = np.append(0, at_b[:-1] + 1)[: len(at_b)], np.diff(np.append(-1, at_b))
        self.bounds = np.searchsorted(at_a, bounds_a)
        self.doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @staticmethod
    def _same(vocabulary: _Vocabulary, ids: np.ndarray, bounds: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which texts' tokens join to their bytes."""
        got = vocabulary.joined(ids)
        has = np.diff(np.append(0, np.cumsum(vocabulary.lengths[ids], dtype=np.int64))[bounds])
        good = has == size
        if good.all():
            differ = got != want
            per_text = np.add.reduceat(differ, np.cumsum(size) - size) if len(size) else np.zeros(0, np.int64)
            return per_text == 0
        mine, theirs = np.cumsum(size) - size, np.cumsum(has) - has
        for i in np.flatnonzero(good):
            good[i] = np.array_equal(got[theirs[i] : theirs[i] + size[i]], want[mine[i] : mine[i] + size[i]])
        return good

    def _only(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.ok.all():
            return ids, bounds
        size = np.diff(bounds)
        return ids[np.repeat(self.ok, size)], np.concatenate([[0], np.cumsum(size[self.ok])])

    @staticmethod
    def _driven(which, short, bounds, long, first):
        rows = np.flatnonzero(which)
        size = np.diff(bounds)[rows]
        place = _ranges(bounds[rows], size)
        i, j = common_ends(short[place], np.concatenate([[0], np.cumsum(size)]), long, first[rows])
        return place[i], j

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked (text, key of both ids) with their number of links."""
        links = self.n_a * self.n_b
        small = np.flatnonzero(links <= WIDE)
        size = links[small]
        group = np.repeat(small, size)
        inside = _ranges(np.zeros(len(small), np.int64), size)
        i = self.ids_a[self.first_a[group] + inside // self.n_b[group]].astype(np.int64)
        j = self.ids_b[self.first_b[group] + inside % self.n_b[group]]
        docs, keys, counts = [self.doc[group]], [(i << SHIFT) | j], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(links > WIDE):
            x, nx = np.unique(self.ids_a[self.first_a[g] : self.first_a[g] + self.n_a[g]], return_counts=True)
            y, ny = np.unique(self.ids_b[self.first_b[g] : self.first_b[g] + self.n_b[g]], return_counts=True)
            keys.append(((x.astype(np.int64)[:, None] << SHIFT) | y[None, :]).ravel())
            counts.append((nx[:, None] * ny[None, :]).ravel())
            docs.append(np.full(len(keys[-1]), self.doc[g]))
        doc, key, n = np.concatenate(docs), np.concatenate(keys), np.concatenate(counts)
        order = np.lexsort((key, doc))
        doc, key, n = doc[order], key[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return doc[at], key[at], np.add.reduceat(n, at) if len(at) else n

    def written(self) -> list[bytes]:
        """Each text's groups as decimal ids: ``a1,a2|b1;a3|b2,b3``."""
        size = self.n_a + self.n_b
        start = np.cumsum(size) - size
        n = int(size.sum())
        of_a = _ranges(start, self.n_a)
        of_b = _ranges(start + self.n_a, self.n_b)
        mark = np.full(n, ord(","), np.uint8)
        mark[start + self.n_a - 1] = ord("|")
        mark[start + size - 1] = ord(";")
        digits = np.zeros(n, np.int64)
        digits[of_a], digits[of_b] = self.a.digits[self.ids_a], self.b.digits[self.ids_b]
        place = np.cumsum(digits + 1) - digits - 1
        out = np.zeros(int((digits + 1).sum()), np.uint8)
        for vocabulary, ids, items in ((self.a, self.ids_a, of_a), (self.b, self.ids_b, of_b)):
            at, length = place[items], digits[items]
            for k in range(int(length.max(initial=0))):
                longer = length > k
                out[at[longer] + k] = vocabulary.decimal[ids[longer], k]
        out[place + digits] = mark
        # A text's last separator is left out.
        item = np.append(start, n)[self.bounds]
        edges = np.append(place, len(out))[item]
        whole = out.tobytes()
        return [whole[s : max(s, e - 1)] for s, e in zip(edges[:-1], edges[1:], strict=True)]


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """One row per document: its key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and, if asked
    for, ``groups`` as text; its distinct pairs are ``pair_a``, ``pair_b`` and ``pair_links`` (lists).
    ``a`` and ``b`` are the files of the two tokenizers; every executor reads them itself."""
    schema = docs.select(F.col(f"`{key}`").alias(key)).schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")
    if groups:
        schema = schema.add("groups", "string")
    for name in ("pair_a", "pair_b", "pair_links"):
        schema = schema.add(name, T.ArrayType(T.IntegerType() if name != "pair_links" else T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.pieces(batch.column(1), PIECE_BYTES):
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([part.column(0), *_columns(part.column(1).to_pylist(), *_tokenizers(a, b), groups)], schema.names)

    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`")).mapInArrow(run, schema)


def _columns(texts: list[str | None], a: ByteLevel, b: Pieces, groups: bool) -> list[pa.Array]:
    n = len(texts)
    rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
    found = _Aligned([texts[i] for i in rows], a, b)
    rows = rows[found.ok]
    links = np.add.reduceat(np.append(found.n_a * found.n_b, 0), found.bounds[:-1]) if len(rows) else np.zeros(0, np.int64)
    figures = [np.diff(found.bounds_a), np.diff(found.bounds_b), np.diff(found.bounds), links]
    out = []
    for values in figures:
        whole = np.zeros(n, np.int64)
        whole[rows] = values
        out.append(pa.array(whole))
    written = [b""] * n
    for i, w in zip(rows.tolist(), found.written(), strict=True):
        written[i] = w
    out.append(pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written], pa.string()))
    if groups:
        out.append(pa.array([w.decode() for w in written], pa.string()))
    doc, key, count = found.pairs()
    cuts = pa.array(np.searchsorted(rows[doc], np.arange(n + 1)).astype(np.int32))
    for values in ((key >> SHIFT).astype(np.int32), (key & ((1 << SHIFT) - 1)).astype(np.int32), count.astype(np.int64)):
        out.append(pa.ListArray.from_arrays(cuts, pa.array(values)))
    return out


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair_a, pair_b, n_docs, best): in how many documents each pair is linked, and is that the highest of its A id?"""
    each = aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b")).alias("p")).select("p.pair_a", "p.pair_b")
    counts = cut(each.groupBy("pair_a", "pair_b").agg(F.count(F.lit(1)).alias("n_docs")))
    highest = counts.groupBy("pair_a").agg(F.max("n_docs").alias("_highest"))
    return cut(counts.join(highest, "pair_a").select("pair_a", "pair_b", "n_docs", (F.col("n_docs") == F.col("_highest")).alias("best")))


def with_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (a written table) without its pairs, plus ``n_best`` (links whose pair is the best of its A id)
    and ``count_sum`` (over links)."""
    spark = aligned.sparkSession
    top = counts.orderBy(F.desc("n_docs"), "pair_a", "pair_b").limit(frequent).toArrow()
    keys = (top["pair_a"].to_numpy().astype(np.int64) << SHIFT) | top["pair_b"].to_numpy()
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], top["n_docs"].to_numpy()[order], top["best"].to_numpy()[order]))
    kept = [c for c in aligned.columns if not c.startswith("pair_")]
    schema = aligned.select(*kept).schema.add("_best", "long").add("_sum", "long")
    schema = schema.add("_pairs", T.ArrayType(T.LongType())).add("_links", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts_, best = known.value
        for batch in batches:
            n = batch.num_rows
            pair_a, pair_b, links = batch.columns[-3:]
            size = np.diff(np.asarray(pair_a.offsets))
            doc = np.repeat(np.arange(n), size)
            key = (pair_a.flatten().to_numpy().astype(np.int64) << SHIFT) | pair_b.flatten().to_numpy()
            times = links.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            total, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, doc[hit], times[hit] * counts_[at[hit]])
            good = hit.copy()
            good[hit] = best[at[hit]]
            np.add.at(n_best, doc[good], times[good])
            cuts = pa.array(np.searchsorted(doc[~hit], np.arange(n + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(cuts, pa.array(x[~hit])) for x in (key, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(n_best), pa.array(total), *rest], schema.names)

    lists = ["pair_a", "pair_b", "pair_links"]
    summed = cut(aligned.select(*kept, *lists).mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    others = summed.select("_row", F.explode(F.arrays_zip("_pairs", "_links")).alias("p")).select(
        "_row", F.shiftright("p._pairs", SHIFT).cast("int").alias("pair_a"), F.col("p._pairs").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("pair_b"),
        F.col("p._links").alias("k"),
    )
    more = others.join(counts, ["pair_a", "pair_b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("_more_best"), F.sum(F.col("k") * F.col("n_docs")).alias("_more_sum")
    )
    zero = F.lit(0).cast("long")
    return summed.join(more, "_row", "left").select(
        *kept, (F.col("_best") + F.coalesce("_more_best", zero)).alias("n_best"), (F.col("_sum") + F.coalesce("_more_sum", zero)).alias("count_sum")
    )


def linked(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """``align`` with the corpus-wide figures of ``with_counts``."""
    aligned = cut(align(docs, a, b, key, text, groups))
    return with_counts(aligned, pair_counts(aligned), frequent)
