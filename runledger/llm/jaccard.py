"""N-gram Jaccard join: components of documents whose shingle sets are similar.

A document's set holds its distinct runs of ``SIZE`` lower-cased words.  Documents with equal
sets are one class; classes link when 100 * intersection >= ``PERCENT`` * union.

1. Frequent shingles are found by counts over all documents; every set is ordered rare
   first (unlisted shingles before listed ones, ties by hash).
2. Prefix filter: two linked sets share a shingle among the first n - ceil(t n) + 1 of the
   larger and the first n - ceil(2t / (1 + t) n) + 1 of the smaller set.  Only those are
   joined, on the shingle, so no set meets all others.
3. A pair is a candidate only if sizes (length filter) and the places of the shared shingle
   (positional filter) still allow the overlap that it needs.
4. Each candidate pair is bounded by its shingles counted per range of hashes (suffix
   filter), and then verified once by the exact intersection from both texts.

The prefixes are read twice: first to find the shingles that two sets share, then, behind a
filter of those (at most 16 MB; it lets others through as it fills, but loses none), to join.

A group of sets with the same prefix shingle is not expanded into all its pairs.  First
every member is compared with one hub of its group only.  Components of the links found so
far are taken, and groups within one component are settled.  In the others, members get
random colours and only pairs of one colour and different components are formed; every
round has a quarter of the colours, and components grow in between.  The last round has one
colour: all pairs that are still across components.  The components are exact after it, as
a pair inside one component adds nothing.

Shingles and sets are told apart by 64-bit hashes (a false equality has a probability of
about 2**-60 per pair compared).  Null texts, empty texts and texts without words have an
empty set and are linked with nothing; a text of fewer words has one shingle of all its
words.  Repeated rows and texts fall into one class.  Rows with the same key get the same
component as their links demand; a null key is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import cut
from . import wordhash as H
from .bitmaps import bitmap, bits_for, maybe
from .components import components

SIZE = 5
PERCENT = 75
#: So many of the most frequent shingles are ordered last; a bound on what is broadcast, not on results.
FREQUENT = 100_000
RANGE_BITS = 6
RANGES = 1 << RANGE_BITS
#: A round looks at about so many pairs per row.
PAIRS_PER_ROW = 8


def _ceil_div(a, b):
    return -(-a // b)


def overlap_needed(x, y, percent: int):
    """Smallest intersection i with 100 i >= percent (x + y - i)."""
    return _ceil_div(percent * (x + y), 100 + percent)


def frequent_shingles(docs: DataFrame, text: str, size: int, limit: int) -> np.ndarray:
    """The most frequent shingles: their hashes and counts.  Each task counts its documents and
    reports shingles of two or more of them; rare ones cross no network."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0

        def report(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"]
            )

        for batch in batches:
            for piece in H.pieces(batch.column(0)):
                kept.append(H.distinct_shingles(piece, size)[1])
                held += len(kept[-1])
                if held > 4_000_000:
                    yield report(kept)
                    kept, held = [], 0
        if kept:
            yield report(kept)

    # Copies of a text are one set and say nothing about how many sets hold a shingle.
    counts = docs.select(text).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.filter("n > 3").orderBy(F.desc("n"), "shingle").limit(limit).toArrow()
    return np.stack([top["shingle"].to_numpy(), top["n"].to_numpy()]).astype(np.int64)


def set_table(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n_shingles, digest, ranges, text_hash) of every row; ``ranges`` counts shingles per range of hashes."""
    schema = docs.select(F.col(key).alias("_id")).schema.add("n_shingles", "long").add("digest", "long")
    schema = schema.add("ranges", T.ArrayType(T.IntegerType())).add("text_hash", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.pieces(batch.column(1)):
                owner, hashes = H.distinct_shingles(piece, size)
                n, digest = _digests(owner, hashes, len(piece))
                ids = batch.column(0).slice(piece.first, len(piece))
                cell = owner * RANGES + (hashes >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
                counts = np.bincount(cell, minlength=RANGES * len(piece)).astype(np.int32)
                cuts = np.arange(len(piece) + 1, dtype=np.int32) * RANGES
                ranges = pa.ListArray.from_arrays(pa.array(cuts), pa.array(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(digest), ranges, batch.column(2).slice(piece.first, len(piece))], schema.names)

    return docs.select(F.col(key).alias("_id"), F.col(text), F.xxhash64(F.col(text))).mapInArrow(run, schema)


def _digests(owner: np.ndarray, hashes: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and order-free digest of each text's set."""
    bounds = np.searchsorted(owner, np.arange(n_texts + 1))
    n = np.diff(bounds)
    scrambled = np.append(H.mix(hashes ^ np.uint64(0xD1B54A32D192ED03)), np.uint64(0))
    total = np.add.reduceat(scrambled, np.minimum(bounds[:-1], len(hashes))) if n_texts else np.zeros(0, np.uint64)
    total = np.where(n > 0, total, 0).astype(np.uint64)
    return n.astype(np.int64), H.mix(total + n.astype(np.uint64)).view(np.int64)


def prefix_table(docs: DataFrame, text: str, size: int, percent: int, frequent: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(shingle, node, meta): the prefix of each row's set, rare first; the node is the set's digest.
    With ``wanted``, only shingles that this filter lets through.

    ``meta`` packs the set's size (31 bits), the shingle's place (31 bits) and whether it lies in
    the shorter prefix that suffices for the smaller set of a pair."""
    shared = docs.sparkSession.sparkContext.broadcast((*frequent, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value[2]
        listed, counts = shared.value[0].view(np.uint64), shared.value[1]
        by_hash = np.argsort(listed)
        listed, counts = listed[by_hash], counts[by_hash]
        for batch in batches:
            for piece in H.pieces(batch.column(0)):
                owner, hashes = H.distinct_shingles(piece, size)
                if not len(hashes):
                    continue
                n, digest = _digests(owner, hashes, len(piece))
                rank = np.zeros(len(hashes), np.int64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
                    rank = np.where(listed[at] == hashes, counts[at], 0)
                order = np.lexsort((hashes, rank, owner))
                hashes, owner = hashes[order], owner[order]
                first = np.searchsorted(owner, np.arange(len(piece)))
                place = np.arange(len(hashes)) - first[owner]
                mine = n[owner]
                keep = place < mine - _ceil_div(percent * mine, 100) + 1
                if wanted is not None:
                    keep &= maybe(wanted, hashes)
                indexed = place < mine - _ceil_div(2 * percent * mine, 100 + percent) + 1
                meta = (mine << 32) | (place << 1) | indexed
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[keep].view(np.int64)), pa.array(digest[owner][keep]), pa.array(meta[keep])],
                    ["shingle", "node", "meta"],
                )

    return docs.select(text).mapInArrow(run, "shingle long, node long, meta long")


def _size(meta: str) -> Column:
    return F.shiftrightunsigned(F.col(meta), 32)


def _left(meta: str) -> Column:
    """Shingles of the set from this place on."""
    return _size(meta) - F.shiftrightunsigned(F.col(meta).bitwiseAND(0xFFFFFFFF), 1)


def _possible(percent: int) -> Column:
    """Length and positional filter of a pair (meta of the smaller set: mx, of the larger: my)."""
    nx, ny = _size("mx"), _size("my")
    need = F.expr(f"({percent} * (shiftrightunsigned(mx, 32) + shiftrightunsigned(my, 32)) + {99 + percent}) div {100 + percent}")
    return (nx * 100 >= ny * percent) & (F.least(_left("mx"), _left("my")) >= need)


def _sets(nodes: pa.Array, texts: pa.Array, size: int) -> dict[int, np.ndarray]:
    """Sorted shingles of each distinct node."""
    ids, rows = np.unique(nodes.to_numpy(), return_index=True)
    found: list[np.ndarray] = []
    for piece in H.pieces(texts.take(pa.array(rows))):
        owner, hashes = H.distinct_shingles(piece, size)
        found.extend(np.split(hashes, np.searchsorted(owner, np.arange(1, len(piece)))))
    return dict(zip(ids.tolist(), found, strict=True))


def _overlaps(batch: pa.RecordBatch, size: int, percent: int) -> np.ndarray:
    """Which pairs (x, y, text of x, text of y) are similar."""
    out = np.zeros(batch.num_rows, bool)
    xs, ys = (_sets(batch.column(c), batch.column(c + 2), size) for c in (0, 1))
    for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        x, y = xs[a], ys[b]
        need = overlap_needed(len(x), len(y), percent)
        if min(len(x), len(y)) < max(1, need):
            continue
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out[i] = int((y[at] == x).sum()) >= need
    return out


def _near_in_size(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Length filter of distinct pairs, before anything wider than their sizes is moved."""
    one, other = (classes.select(F.col("node").alias(p), F.col("n").alias(f"n{p}")) for p in ("x", "y"))
    near = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    return pairs.join(one, "x").join(other, "y").filter(near).select("x", "y")


def _near_in_suffixes(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Suffix filter of distinct pairs: of each range of hashes two sets share at most the smaller
    count, and these must add up to the overlap needed."""
    one, other = (
        classes.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("ranges").alias(f"r{p}")) for p in ("x", "y")
    )
    shared = F.aggregate(F.zip_with("rx", "ry", lambda p, q: F.least(p, q)), F.lit(0), lambda total, k: total + k)
    need = F.expr(f"({percent} * (nx + ny) + {99 + percent}) div {100 + percent}")
    return pairs.join(one, "x").join(other, "y").filter(shared >= need).select("x", "y")


def verified(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int
) -> DataFrame:
    """The links (x, y) among distinct candidate pairs of nodes, from the text of one document each."""
    pairs = cut(_near_in_suffixes(pairs, classes, percent))
    ends = cut(
        pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(classes.select("node", "_id"), "node")
    )
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ends.select(F.xxhash64("_id").alias("h")), "h"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = maybe(bits.value, batch.column(2).to_numpy(zero_copy_only=False))
            if hit.any():
                part = batch.filter(pa.array(hit))
                nodes = [_digests(*H.distinct_shingles(p, size), len(p))[1] for p in H.pieces(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(nodes)), part.column(1)], ["_id", "node", "t"])

    named = docs.select(F.col(key).alias("_id"), F.col(text).alias("t"), F.xxhash64(F.col(key)))
    schema = named.select("_id").schema.add("node", "long").add("t", "string")
    # A key may be repeated: the node tells its texts apart, and one copy of each is enough.
    texts = cut(named.mapInArrow(sift, schema).join(ends, ["_id", "node"]).groupBy("_id", "node").agg(F.first("t").alias("t")))
    joined = (
        pairs.join(texts.select(F.col("node").alias("x"), F.col("t").alias("tx")), "x")
        .join(texts.select(F.col("node").alias("y"), F.col("t").alias("ty")), "y")
        .select("x", "y", "tx", "ty")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array(_overlaps(part, size, percent))).select([0, 1])

    return cut(joined.mapInArrow(check, "x long, y long"))


def _unsettled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of groups that still have several components, with the component of each."""
    label = found.select("node", F.col("component").alias("c"))
    labelled = cut(rows.join(label, "node", "left").withColumn("c", F.coalesce("c", "node")))
    several = labelled.groupBy("shingle").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a != b")
    return cut(labelled.join(several.select("shingle"), "shingle", "left_semi").select("shingle", "node", "meta", "c"))


def _pairs_ahead(rows: DataFrame):
    """How many pairs across components the groups still hold, and how many rows, without forming any."""
    parts = rows.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("k"))
    groups = parts.groupBy("shingle").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    return groups.agg(F.sum(F.expr("(s * s - q) div 2")).alias("n"), F.sum("s").alias("rows")).first()


def _across(rows: DataFrame, percent: int, colours: int, turn: int) -> DataFrame:
    """Pairs of members of different components that the filters leave possible; with several
    colours only those of one colour, which ``turn`` deals anew to all nodes."""
    colour = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(colours))
    rows = rows.withColumn("colour", colour) if colours > 1 else rows.withColumn("colour", F.lit(0))
    small = rows.filter(F.col("meta").bitwiseAND(1) == 1).select(
        "shingle", "colour", F.col("node").alias("n1"), F.col("meta").alias("mx"), F.col("c").alias("c1")
    )
    large = rows.select("shingle", "colour", F.col("node").alias("n2"), F.col("meta").alias("my"), F.col("c").alias("c2"))
    met = small.join(large, ["shingle", "colour"]).filter("c1 != c2").filter(_possible(percent))
    return met.select(F.least("n1", "n2").alias("x"), F.greatest("n1", "n2").alias("y")).distinct()


def similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT,
    frequent: int = FREQUENT, decide: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_shingles`` and ``component_id`` (the smallest key
    that its links reach, itself included).  With ``decide`` also ``digest`` (of its set, null if that
    is empty), ``text_hash`` and ``stands``: does it have the key and set that stand for the component?"""
    keyed = docs.filter(F.col(key).isNotNull())
    sets = cut(set_table(docs, key, text, size))
    classes = cut(
        sets.filter((F.col("n_shingles") > 0) & F.col("_id").isNotNull())
        .groupBy(F.col("digest").alias("node")).agg(F.min("_id").alias("_id"), F.min("n_shingles").alias("n"), F.first("ranges").alias("ranges"))
    )
    frequency = frequent_shingles(docs, text, size, frequent)
    # Shingles in the prefixes of two sets or more; the first set in order of digest is the group's hub.
    groups = prefix_table(keyed, text, size, percent, frequency).groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("_last"))
    groups = cut(groups.filter("hub < _last").select("shingle", "hub"))
    shared = bitmap(groups, "shingle", bits_for(groups.count()))
    prefixes = prefix_table(keyed, text, size, percent, frequency, shared)
    members = cut(prefixes.join(groups, "shingle"))
    pairs = members.filter("node != hub").select(F.col("hub").alias("x"), F.col("node").alias("y")).distinct()
    tried = cut(_near_in_size(pairs, classes, percent))
    links = verified(tried, classes, keyed, key, text, size, percent)
    found = components(links, "x", "y")

    open_rows = _unsettled(members.select("shingle", "node", "meta"), found)
    colours, turn = None, 0
    while True:
        ahead = _pairs_ahead(open_rows)
        if not ahead["n"]:
            break
        wanted = -(-ahead["n"] // (PAIRS_PER_ROW * ahead["rows"]))
        colours = wanted if colours is None else min(wanted, colours // 4)
        last = colours <= 1
        turn += 1
        new = _across(open_rows, percent, max(1, colours), turn)
        new = cut(new.join(tried, ["x", "y"], "left_anti"))
        links = links.unionByName(verified(new, classes, keyed, key, text, size, percent))
        found = components(links, "x", "y")
        if last:
            break
        tried = tried.unionByName(new)
        open_rows = _unsettled(open_rows.drop("c"), found)

    whole = classes.join(found, "node", "left").select("node", "_id", F.coalesce("component", "node").alias("component"))
    smallest = whole.groupBy("component").agg(F.min(F.struct("_id", "node")).alias("first"))
    by_node = cut(
        whole.join(smallest, "component").select(F.col("node").alias("digest"), F.col("first._id").alias("component_id"), F.col("first.node").alias("_first"))
    )
    linked = F.when(F.col("n_shingles") > 0, F.col("digest"))
    stands = F.coalesce((F.col("_id") == F.col("component_id")) & (F.col("digest") == F.col("_first")), F.col("component_id").isNull() | F.col("_id").isNull())
    return (
        sets.withColumn("digest", linked).join(by_node, "digest", "left")
        .select(
            F.col("_id").alias(key), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"),
            *(["digest", stands.alias("stands"), "text_hash"] if decide else []),
        )
    )
