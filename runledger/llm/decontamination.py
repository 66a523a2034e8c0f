"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (one shorter window if it has fewer).  A
window is a set of word shingles with places.  Shingles are ordered by how often they occur
in all documents; as containment must be complete, the rarest shingle of a window is a
sufficient prefix: a document without it cannot contain the window, and windows whose
rarest shingle occurs nowhere are dropped.  Each occurrence of a prefix shingle in a
document is joined with the windows that have it, the place of the shingle gives the place
of the window (positional bound), which must lie within the text (length bound), and the
words there are compared with the window's (exact verification).

Documents are read twice: once for the counts and once for the occurrences.  A fixed-size
filter of the benchmark's shingles keeps unrelated shingles out of the shuffle; it may let
some through but loses none.

Null and empty texts have no words; items without words or with a null key have no windows.
Rows that repeat a key are judged one by one.  Words are told apart by hashes until the
verification, which compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import cut
from . import wordhash as H
from .bitmaps import bitmap, maybe

WINDOW = 13
SHINGLE = 3


def _word_list(piece: H.Piece, w: H.Words, start: int, end: int) -> str:
    lowered = H.lowered(piece.data[w.starts[start] : w.ends[end - 1]]).tobytes()
    base = int(w.starts[start])
    return b" ".join(lowered[int(a) - base : int(b) - base] for a, b in zip(w.starts[start:end], w.ends[start:end], strict=True)).decode()


def windows(items: DataFrame, item: str, text: str, size: int = WINDOW) -> DataFrame:
    """(item, words, length, shingles in order) of every window; the benchmark's rows only."""
    schema = items.select(F.col(item).alias("item")).schema.add("words", "string").add("length", "integer")
    schema = schema.add("shingles", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.pieces(batch.column(1)):
                w = H.words(piece, H.ALNUM, lower=True)
                rows: list[list] = [[], [], [], []]
                for i in range(len(piece)):
                    first, last = int(w.bounds[i]), int(w.bounds[i + 1])
                    length = min(size, last - first)
                    if not length:
                        continue
                    s = min(SHINGLE, length)
                    keys = H.shingles(w.hashes[first:last], np.array([0, last - first]), s)[0].view(np.int64)
                    for k in range(last - first - length + 1):
                        for column, value in zip(rows, (piece.first + i, _word_list(piece, w, first + k, first + k + length), length, keys[k : k + length - s + 1].tolist()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.list_(pa.int64()))],
                    schema.names,
                )

    known = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), text)
    return known.mapInArrow(run, schema)


def _document_counts(docs: DataFrame, text: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """How many documents each of the benchmark's shingles occurs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.pieces(batch.column(0)):
                w = H.words(piece, H.ALNUM, lower=True)
                seen = []
                for s in sizes:
                    keys, at = H.shingles(w.hashes, w.bounds, s)
                    hit = maybe(bits, keys)
                    pairs = np.stack([w.text_of()[at[hit]], keys[hit].view(np.int64)])
                    seen.append(np.unique(pairs, axis=1)[1])
                values, counts = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    return docs.select(text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, key: str, text: str, bits: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """One row per document: key, row number, words, and the prefix shingles found with the words around."""
    hit_type = T.StructType.fromDDL("hits array<struct<shingle:bigint,place:bigint,lead:int,around:string>>")[0]
    schema = docs.select(F.col(key).alias("_id")).schema.add("row", "long").add("n_words", "long").add(hit_type)
    arrow_hit = pa.list_(pa.struct([("shingle", pa.int64()), ("place", pa.int64()), ("lead", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.pieces(batch.column(2)):
                w = H.words(piece, H.ALNUM, lower=True)
                owner = w.text_of()
                hits: list[list[dict]] = [[] for _ in range(len(piece))]
                for s in sizes:
                    keys, at = H.shingles(w.hashes, w.bounds, s)
                    found = maybe(bits, keys)
                    for k, i in zip(keys[found].view(np.int64).tolist(), at[found].tolist(), strict=True):
                        t = int(owner[i])
                        first, last = int(w.bounds[t]), int(w.bounds[t + 1])
                        start = max(first, i - window + 1)
                        around = _word_list(piece, w, start, min(last, i + window))
                        hits[t].append({"shingle": k, "place": i - first, "lead": i - start, "around": around})
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(w.counts().astype(np.int64)), pa.array(hits, arrow_hit)], schema.names
                )

    rows = docs.select(F.col(key).alias("_id"), F.monotonically_increasing_id().alias("row"), text)
    return rows.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per document: key, ``n_words``, ``n_hit`` (words inside windows), ``n_items`` and the sorted ``items``."""
    wanted = cut(windows(items, item, item_text, window))
    sizes = sorted(r[0] for r in wanted.select(F.least("length", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE rows
    shingles = wanted.select(F.explode("shingles").alias("shingle")).distinct()
    counts = cut(_document_counts(docs, text, bitmap(shingles, "shingle"), sizes).join(shingles, "shingle")) if sizes else None
    if counts is None:
        none = F.lit(0).cast("long")
        plain = _occurrences(docs, key, text, np.zeros(1 << 17, np.uint32), [], window)
        return plain.select(F.col("_id").alias(key), "n_words", none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("items"))
    # The rarest shingle of each window, by documents that hold it; none of them may be missing.
    ranked = wanted.select("item", "words", "length", F.posexplode("shingles").alias("offset", "shingle")).join(counts, "shingle", "left")
    prefixes = cut(
        ranked.groupBy("item", "words", "length")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("p"))
        .filter("p.n > 0").select("item", "words", "length", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset"))
    )
    found = cut(_occurrences(docs, key, text, bitmap(prefixes.select("shingle").distinct(), "shingle"), sizes, window))
    hits = found.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(prefixes, "shingle")
    there = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("length")), " ")
    hits = hits.filter("lead >= offset").filter(there == F.col("words")).select(
        "row", "item", (F.col("place") - F.col("offset")).alias("start"), (F.col("place") - F.col("offset") + F.col("length")).alias("end")
    )
    hits = cut(hits.distinct())
    # Words covered by a union of ranges: what each range adds beyond all that begin before it.
    spans = hits.groupBy("row", "start").agg(F.max("end").alias("end"))
    reach = F.max("end").over(_before("row", "start"))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reach, "start")))
    covered = spans.select("row", added.alias("added")).groupBy("row").agg(F.sum("added").alias("n_hit"))
    named = hits.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (
        found.select("_id", "row", "n_words").join(covered.join(named, "row"), "row", "left")
        .select(
            F.col("_id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("n_items", F.when(F.col("n_items") < 0, 0).otherwise(F.col("n_items")))
    )


def _before(part: str, order: str) -> WindowSpec:
    return Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def contaminated():
    """The rule: any hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
