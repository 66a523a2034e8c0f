"""Near duplicates by SuperMinHash: signatures, bands, verified links, union-find groups.

A document's set holds its distinct runs of ``SIZE`` lower-cased words.  Documents with equal
sets are one class; classes link when 100 * intersection >= ``PERCENT`` * union.

Signature: every element draws from its own generator a permutation of the M components, one
place per step, and in step j offers j plus a fraction to the component at that place; a
component keeps the smallest offer of all elements.  Each element thus reaches each component
in exactly one step, so the components are correlated, and estimates vary less than those of
independent hashes.  A document stops as soon as every component holds an offer of an
earlier step, since later ones cannot be smaller: after about 1 + M log M / n steps for n
elements.  Permutations are kept as the swaps of the steps taken.

Bands: ``BANDS`` bands of ``ROWS`` components each.  Two sets of similarity 0.85 agree in no band
with a probability of at most (1 - 0.85**5)**32 = 7e-9.  Sets that share a band are candidates, and
every candidate is verified once on both whole sets; links are never guessed.

A bucket (one value of one band) is not expanded into all its pairs.  First all members meet
its hub, the smallest of them.  Verified links are united: each task by union-find over its
own edges, which leaves a forest, and Spark contracts the forests to components.  Buckets
whose members are in one component are settled, as a pair inside a component adds nothing.

The sets of all other buckets need not be compared pair by pair either: two of them can only
be similar if they share one of their first elements in an order by rarity among these sets,
at places that leave enough of both (what parts two edited copies is rare, so their common
rest comes too late).  They meet on those elements.  Members of one such element get random
colours, so many that it forms a few pairs per row, and only members of one colour and
different components meet; every round has a sixteenth of the colours and unites again, until
each element is settled or had all its members meet.  Large ones are dealt over several tasks.

Null texts, empty texts and texts without words have an empty set and are linked with nothing;
a text of fewer than ``SIZE`` words has one element, all its words.  Rows repeated with key and
text, and equal texts under different keys, fall into one class.  Rows with the same key get
the component that their own set's links demand.  A null key is left alone: no component, and
kept.  Other columns, whatever their names, are not read.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import cut
from . import wordhash as H
from .bitmaps import bitmap, bits_for, maybe
from .components import components
from .jaccard import frequent_shingles, prefix_table, set_table, verified

SIZE = 5
PERCENT = 85
ROWS, BANDS = 5, 32
#: A round looks at about so many pairs per row.
PAIRS_PER_ROW = 32
#: Colours of a round, as a share of those of the round before: 1 / FEWER.
FEWER = 64
#: Rows of a group that one task pairs with the others.
BLOCK = 2_000
#: So many of the most frequent elements are ordered last; a bound on what is broadcast, not on results.
FREQUENT = 100_000
#: Edges that one union-find holds.
FOREST_EDGES = 500_000

_STEP = np.uint64(52)
_EMPTY = np.uint64(2**64 - 1)


def signatures(owner: np.ndarray, hashes: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures of ``n_texts`` sets given as (set, element), as whole numbers: the step, then 52 bits of fraction."""
    out = np.full((n_texts, m), _EMPTY)
    cells = out.reshape(-1)
    owner, hashes = owner.astype(np.int64), hashes
    #: Of earlier steps: the place drawn, and what the swap put there.
    drawn: list[np.ndarray] = []
    put: list[np.ndarray] = []
    for j in range(m):
        if not len(owner):
            break
        noise = H.mix(hashes + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + (H.mix(noise ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m - j)).astype(np.int64)
        here, there = np.full(len(k), j), k.copy()
        for places, values in zip(drawn, put, strict=True):
            here = np.where(places == j, values, here)
            there = np.where(places == k, values, there)
        offer = np.uint64(j) << _STEP | noise >> np.uint64(12)
        np.minimum.at(cells, owner * m + there, offer)
        drawn.append(k)
        put.append(here)
        # Early stopping: nothing of step j + 1 is below an offer of step j.
        open_ = (out.max(axis=1) >> _STEP) > j
        live = open_[owner]
        owner, hashes = owner[live], hashes[live]
        drawn, put = [x[live] for x in drawn], [x[live] for x in put]
    return out


def band_values(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One hash per set and band."""
    total = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        total += H.mix(parts[:, :, r]) * np.uint64(2 * r + 3)
    return H.mix(total + H.mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)))


def band_table(docs: DataFrame, text: str, size: int, rows: int, bands: int) -> DataFrame:
    """(bucket, node): the bands of every distinct set; a task gives each set once as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in H.pieces(batch.column(0)):
                owner, hashes = H.distinct_shingles(piece, size)
                found, at = np.unique(owner, return_index=True)
                if not len(found):
                    continue
                node = digests(owner, hashes, at)
                fresh = np.array([d not in seen for d in node.tolist()])
                _, first = np.unique(node, return_index=True)
                once = np.zeros(len(node), bool)
                once[first] = True
                fresh &= once
                if not fresh.any():
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(node[fresh].tolist())
                number = np.full(len(piece), -1)
                number[found[fresh]] = np.arange(int(fresh.sum()))
                mine = number[owner] >= 0
                value = band_values(signatures(number[owner[mine]], hashes[mine], int(fresh.sum()), rows * bands), rows, bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.reshape(-1).view(np.int64)), pa.array(np.repeat(node[fresh], bands))], ["bucket", "node"]
                )

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, node long")


def digests(owner: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The digests by which ``set_table`` names sets, of the non-empty sets that begin at ``at``."""
    from .jaccard import _digests

    numbers = np.zeros(len(owner), np.int64)
    numbers[at[1:]] = 1
    return _digests(np.cumsum(numbers), hashes, len(at))[1]


def forest(links: DataFrame) -> DataFrame:
    """The links (x, y) thinned by union-find in every task: components stay, cycles go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            top = v
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[v] != top:
                parent[v], v = top, parent[v]
            return top

        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    kept[i] = True
            yield batch.filter(pa.array(kept))
            if len(parent) > FOREST_EDGES:
                parent.clear()

    return links.select("x", "y").mapInArrow(run, "x long, y long")


def _labelled(members: DataFrame, group: str, found: DataFrame) -> DataFrame:
    """Members of groups that hold several components, with the component ``c`` of each and the group's
    number of rows and of pairs across components."""
    label = found.select("node", F.col("component").alias("c"))
    rows = cut(members.join(label, "node", "left").withColumn("c", F.coalesce("c", "node")))
    parts = rows.groupBy(group, "c").agg(F.count(F.lit(1)).alias("k"))
    sums = parts.groupBy(group).agg(F.sum("k").alias("rows"), F.sum(F.col("k").cast("double") * F.col("k")).alias("q"), F.count(F.lit(1)).alias("several"))
    # Half of rows**2 - q; as double, for a group may hold billions of pairs.
    open_ = sums.filter("several > 1").select(group, "rows", ((F.col("rows").cast("double") * F.col("rows") - F.col("q")) / 2).alias("pairs"))
    return rows.join(open_, group)


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, t): one text of each set; only rows whose key may be asked for are shuffled."""
    wanted = cut(nodes.join(classes.select("node", "_id"), "node"))
    keys = wanted.select(F.xxhash64("_id").alias("h"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(keys, "h", bits_for(keys.count())))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(maybe(bits.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for piece in H.pieces(part.column(1)):
                owner, hashes = H.distinct_shingles(piece, size)
                found, at = np.unique(owner, return_index=True)
                rows = pa.array(found + piece.first)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(digests(owner, hashes, at)), part.column(1).take(rows)], ["_id", "node", "t"])

    schema = docs.select(F.col("_key").alias("_id")).schema.add("node", "long").add("t", "string")
    found = docs.select(F.col("_key").alias("_id"), "_text", F.xxhash64("_key")).mapInArrow(sift, schema)
    # A key may be repeated: the node tells its texts apart, and one copy of each is enough.
    return cut(found.join(wanted, ["_id", "node"]).groupBy("node").agg(F.first("t").alias("t")))


def _meeting(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of this round: one colour, different components, and sizes and places of the shared element that leave
    the overlap they need.  ``colours`` is per element."""
    place = F.shiftrightunsigned(F.col("meta").bitwiseAND(0xFFFFFFFF), 1)
    n = F.shiftrightunsigned("meta", 32)
    coloured = rows.withColumns({"colour": F.pmod(F.xxhash64("node", F.lit(turn)), "colours"), "n": n, "left_over": n - place})
    blocks = F.greatest(F.ceil(F.col("rows") / F.col("colours") / BLOCK), F.lit(1)).cast("long")
    left = coloured.filter(F.col("meta").bitwiseAND(1) == 1).select(
        "shingle", "colour", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.col("node").alias("a"), F.col("n").alias("na"),
        F.col("left_over").alias("la"), F.col("c").alias("ca"),
    )
    right = coloured.select(
        "shingle", "colour", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.col("node").alias("b"),
        F.col("n").alias("nb"), F.col("left_over").alias("lb"), F.col("c").alias("cb"),
    )
    need = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") >= F.col("na")) & (F.least("la", "lb") >= need)
    met = left.join(right, ["shingle", "colour", "block"]).filter("ca != cb").filter(near)
    return met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS,
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_shingles``, ``component_id`` (the smallest key that its links
    reach, itself included) and ``kept`` (is that its own key?)."""
    docs = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    keyed = docs.filter(F.col("_key").isNotNull())
    sets = cut(set_table(docs, "_key", "_text", size))
    classes = cut(
        sets.filter((F.col("n_shingles") > 0) & F.col("_id").isNotNull())
        .groupBy(F.col("digest").alias("node")).agg(F.min("_id").alias("_id"), F.min("n_shingles").alias("n"), F.first("ranges").alias("ranges"))
    )
    members = band_table(keyed, "_text", size, rows, bands).distinct()
    members = cut(members.join(classes.select("node", "n"), "node"))
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("_last"))
    hubs = hubs.filter("hub.node < _last").select("bucket", F.col("hub.node").alias("x"), F.col("hub.n").alias("nx"))
    members = cut(members.join(hubs, "bucket"))
    near = F.least("nx", "n") * 100 >= F.greatest("nx", "n") * percent
    tried = cut(members.filter((F.col("node") != F.col("x")) & near).select("x", F.col("node").alias("y")).distinct())
    members = members.select("bucket", "node", "n")
    links = verified(tried, classes, keyed, "_key", "_text", size, percent)
    found = components(forest(links), "x", "y")

    crowded = cut(_labelled(members, "bucket", found).select("node").distinct())
    if not crowded.isEmpty():
        texts = _texts(crowded, classes, keyed, size)
        frequency = frequent_shingles(texts, "t", size, FREQUENT)
        open_rows, turn = _labelled(cut(prefix_table(texts, "t", size, percent, frequency)), "shingle", found), 0
        while True:
            colours = F.ceil(F.col("pairs") / (PAIRS_PER_ROW * F.col("rows")) / float(FEWER**turn))
            open_rows = cut(open_rows.withColumn("colours", F.greatest(colours, F.lit(1)).cast("long")))
            if open_rows.isEmpty():
                break
            turn += 1
            new = cut(_meeting(open_rows, turn, percent).join(tried, ["x", "y"], "left_anti"))
            links = links.unionByName(verified(new, classes, keyed, "_key", "_text", size, percent))
            found = components(forest(links), "x", "y")
            tried = tried.unionByName(new)
            # Elements of one colour had all their members meet.
            open_rows = _labelled(open_rows.filter("colours > 1").select("shingle", "node", "meta"), "shingle", found)

    whole = classes.join(found, "node", "left").select("node", "_id", F.coalesce("component", "node").alias("component"))
    smallest = whole.groupBy("component").agg(F.min("_id").alias("component_id"))
    by_node = cut(whole.join(smallest, "component").select(F.col("node").alias("digest"), "component_id"))
    linked = F.when((F.col("n_shingles") > 0) & F.col("_id").isNotNull(), F.col("digest"))
    component = F.coalesce("component_id", "_id")
    return (
        sets.withColumn("digest", linked).join(by_node, "digest", "left")
        .select(F.col("_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
    )
