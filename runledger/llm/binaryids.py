"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank of frequency over all documents, so that the most frequent
need one byte.  A rank takes one to four bytes; the lengths of four ranks share a control
byte, and control bytes are kept apart from the data bytes.  Decoding is a numpy table
look-up: the control bytes give all lengths at once, the lengths give all places, and the
ranks are gathered.

One file holds consecutive documents in ascending order of their key::

    magic "RLT1", n_docs u32, n_tokens u64, n_controls u64, n_data u64, ids before it u64
    keys  i64 x n_docs, null flags u8 x n_docs, counts u32 x n_docs, control bytes, data bytes

and ``ranks.bin`` holds the magic and the ids by rank, as u32.  Each file is written under a name of its
own and then renamed, so that a repeated task leaves one whole file.

Documents are range-partitioned by key and row number, so a key with many rows is dealt over
several tasks and stays in order, and each is encoded once.  Ranks are counted over all ids.
The end id closes each document; null and empty texts have only that.  Rows that repeat a
key are kept one by one.  Keys are integers; rows with a null key come first and read back
with a null key.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import checkpoint_dir, cut

MAGIC = b"RLT1"
HEADER = "<4sIQQQQ"
#: Rows of one file: text bytes as read, about.
FILE_BYTES = 32 << 20
#: Distinct words remembered per Python worker.
CACHE = 700_000
PIECE_CHARS = 1_000_000

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    n = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = n
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control, v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= n[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` values of control and data bytes."""
    lengths = _LENGTHS[control].reshape(-1)[:count].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder:
    """The tokenizers library with a memory of words.

    A text is cut before each space that stands between visible characters, where the
    tokenizer's own pattern always cuts, so the pieces' ids are those of the whole text.  Any
    other white space than that and single line ends, or the name of a special token, sends
    the whole text to the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Special tokens that a cut at spaces would break.
        self.spaced = [s for s in self.special if " " in s]
        self.feed = self._whole(["\n"])[0]
        #: Ids of words at the start of a text, and of words after a space (with that space).
        self.first: dict[str, bytes | bool] = {}
        self.after: dict[str, bytes | bool] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _learn(self, known: dict[str, bytes | bool], words: set[str], lead: str) -> None:
        """Encode new words.  Those without line ends go in one call, one to a line; the line ends
        part their ids again.  A word that cannot stand for itself is marked False."""
        plain, lined = [], []
        for w in words:
            if not all(p.split() == [p] for p in w.split("\n")) or any(s in w for s in self.special):
                known[w] = False
            elif "\n" in w:
                lined.append(w)
            else:
                plain.append(w)
        if plain:
            pieces = [lead + w for w in plain]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            feed = np.frombuffer(self.feed, "<u4")
            cuts = np.flatnonzero(ids == feed[0])
            if len(feed) == 1 and len(cuts) == len(plain) - 1:
                raw, starts, ends = ids.tobytes(), np.append(0, cuts + 1) * 4, np.append(cuts, len(ids)) * 4
                known.update((w, raw[a:b]) for w, a, b in zip(plain, starts.tolist(), ends.tolist(), strict=True))
            else:
                lined += plain
        known.update(zip(lined, self._whole([lead + w for w in lined]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        if len(self.first) + len(self.after) > CACHE:
            self.first.clear()
            self.after.clear()
        first, after = self.first.get, self.after.get
        split = [t.split(" ") for t in texts]
        found = [[first(words[0]), *map(after, words[1:])] for words in split]
        unknown = [i for i, ids in enumerate(found) if None in ids]
        if unknown:
            self._learn(self.first, {split[i][0] for i in unknown if found[i][0] is None}, "")
            self._learn(self.after, {w for i in unknown for w in split[i][1:] if after(w) is None}, " ")
            for i in unknown:
                found[i] = [first(split[i][0]), *map(after, split[i][1:])]
        whole = [i for i, ids in enumerate(found) if False in ids or any(s in texts[i] for s in self.spaced)]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            found[i] = [ids]
        return [b"".join(ids) for ids in found]


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The encoder of this Python worker: later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _grouped(texts: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size > PIECE_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_table(docs: DataFrame, tokenizer: str, key: str, text: str, end_id: int) -> DataFrame:
    """(part, before, _id, ids) in order of part and key: ids as little-endian bytes (u16 if all ids
    fit, u32 otherwise) and the ids of the part before this document.  Written once."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    rows = rows.repartitionByRange(int(size // FILE_BYTES) + 1, "_id", "_row").sortWithinPartitions("_id", "_row")
    width = _width(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = encoder_for(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            start = 0
            for group in _grouped(batch.column(1)):
                ids = [np.frombuffer(i + end, "<u4").astype(width) for i in encoder.encode(group)]
                counts = np.array([len(i) for i in ids])
                befores = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part)), pa.array(befores), batch.column(0).slice(start, len(group)),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                    ],
                    ["part", "before", "_id", "ids"],
                )
                start += len(group)

    encoded = rows.select("_id", "_text").mapInArrow(run, "part long, before long, _id long, ids binary")
    path = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    encoded.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(encoded.schema).parquet(path)


def _width(tokenizer: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def _ranking(encoded: DataFrame, width: str) -> np.ndarray:
    """The ids that occur, most frequent first (ties by id); as many rows as the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                n = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(start, 1000).to_pylist()), width))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def _put(folder: str, name: str, body: bytes) -> None:
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(body)
    system.move(own, f"{root}/{name}")


def write_ids(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode ``docs`` and write the files into ``folder`` (a shared one); returns one row per file."""
    width = _width(tokenizer, end_id)
    encoded = encode_table(docs, tokenizer, key, text, end_id)
    ranking = _ranking(encoded, width)
    rank_of = np.zeros(int(ranking.max(initial=0)) + 1, np.uint32)
    rank_of[ranking] = np.arange(len(ranking))
    _put(folder, "ranks.bin", MAGIC + ranking.astype("<u4").tobytes())
    # One number per part of about FILE_BYTES of text.
    ends = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.max(F.col("before") + F.octet_length("ids") / int(width[2])).cast("long").alias("n")).collect()}
    bases, total = {}, 0
    for part in sorted(ends):
        bases[part] = total
        total += ends[part]
    shared = docs.sparkSession.sparkContext.broadcast((rank_of, bases))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, base = shared.value
        for batch in batches:
            parts, before = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = batch.column(2)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                lists = [np.frombuffer(x.as_py(), width) for x in batch.column(3).slice(a, b - a)]
                counts = np.array([len(x) for x in lists], "<u4")
                control, data = pack(ranks[np.concatenate(lists)])
                first = base[int(parts[a])] + int(before[a])
                head = struct.pack(HEADER, MAGIC, b - a, int(counts.sum()), len(control), len(data), first)
                own = keys.slice(a, b - a)
                nulls = np.array(own.is_null().to_numpy(zero_copy_only=False), np.uint8)
                body = [head, own.fill_null(0).to_numpy().astype("<i8").tobytes(), nulls.tobytes(), counts.tobytes(), control.tobytes(), data.tobytes()]
                name = f"part-{int(parts[a]):08d}-{int(before[a]):014d}.ids"
                _put(folder, name, b"".join(body))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b - a]), pa.array([int(counts.sum())])], ["file", "n_docs", "n_tokens"])

    return cut(encoded.mapInArrow(write, "file string, n_docs long, n_tokens long"))


def read_ids(spark: SparkSession, folder: str, ids: bool = True, column: str = "doc_id") -> DataFrame:
    """Every document of the files: key, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, its ids."""
    table = spark.read.format("binaryFile").load(f"{folder}/ranks.bin").select("content").first()
    ranking = np.frombuffer(bytes(table[0]), "<u4", offset=len(MAGIC))
    shared = spark.sparkContext.broadcast(ranking)
    schema = f"`{column}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield _documents(content.as_py(), shared.value, ids, column)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    return files.select("content").mapInArrow(run, schema)


def _documents(body: bytes, ranking: np.ndarray, with_ids: bool, column: str) -> pa.RecordBatch:
    magic, n_docs, n_tokens, n_control, n_data, first = struct.unpack_from(HEADER, body)
    if magic != MAGIC:
        raise ValueError("not a token id file")
    at = struct.calcsize(HEADER)
    fields = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("u1", n_control), ("u1", n_data)):
        fields.append(np.frombuffer(body, kind, n, at))
        at += fields[-1].nbytes
    keys, nulls, counts, control, data = fields
    ids = ranking[unpack(control, data, n_tokens)]
    cuts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = [
        pa.array(keys, mask=nulls == 1), pa.array(first + cuts[:-1]), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64()),
    ]
    names = [column, "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int64))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)
