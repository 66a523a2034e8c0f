"""Fill-in-middle: cut a text at two units and put its middle last.

Units are runs of ASCII letters and single other code points.  A document's two cut ranks and
its form follow from the hash of its key, so that a rerun or a lost executor changes nothing.

The units of a batch lie in an indexable skip list.  The lowest lane links every unit with the
next; each express lane links about a quarter of the nodes of the lane below, and every link
carries how many units and how many code points it passes over.  A search starts in the top
lane, follows links while their unit widths stay within the rank that is left, goes down a
lane otherwise, and ends exactly before the unit of that rank, with the code points that it
passed.  All searches of a batch descend together.  A whole text is in the list, however long.

Forms: ``plain`` is the text itself (empty texts, texts that hold a marker, and a tenth of
all); ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` ``<S>`` suffix ``<P>``
prefix ``<M>`` middle.  Texts in the last two hold no marker, so ``restored`` finds their
parts again.

Null texts count as empty.  A null key counts as an empty string before hashing.  Repeated rows
come back as often as they came, with equal results.  Extra columns are carried along, except
those named like an output column, which the output replaces.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as H

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of a hundred of those so many take the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: A lane holds about one of so many nodes of the lane below.
SPARSER = 4
OUTPUT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


class SkipList:
    """Lanes over units of known widths in code points, the sparsest first."""

    def __init__(self, points: np.ndarray):
        """``points[i]``: code points of unit i."""
        self.size = len(points)
        before = np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
        towers = H.mix(np.arange(self.size, dtype=np.uint64))
        nodes = np.arange(self.size, dtype=np.int32)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        down = nodes
        while True:
            ends = np.append(nodes, self.size)
            # Of each node: its place in the lane below, and the widths of the link to the next node.
            self.lanes.insert(0, (down, np.diff(ends).astype(np.int32), np.diff(before[ends]).astype(np.int32)))
            if len(nodes) <= SPARSER:
                break
            # The first unit is in all lanes; others stay with a chance of 1 / SPARSER per lane.
            towers = towers // np.uint64(SPARSER) if len(self.lanes) > 1 else towers
            keep = towers % np.uint64(SPARSER) == 0
            keep[0] = True
            down = np.flatnonzero(keep).astype(np.int32)
            nodes, towers = nodes[down], towers[down]

    def points_before(self, ranks: np.ndarray) -> np.ndarray:
        """How many code points lie before the unit of each rank (0 to the number of units)."""
        left = ranks.astype(np.int64)
        passed = np.zeros(len(left), np.int64)
        if not self.size:
            return passed
        at = np.zeros(len(left), np.int64)
        for depth, (down, units, points) in enumerate(self.lanes):
            going = np.arange(len(left))
            while len(going):
                place = at[going]
                on = place < len(units)
                going, place = going[on], place[on]
                on = units[place] <= left[going]
                going, place = going[on], place[on]
                left[going] -= units[place]
                passed[going] += points[place]
                at[going] += 1
            if depth + 1 < len(self.lanes):
                # Past the last node only ranks at the very end remain: nothing is left of them.
                at = np.where(at < len(down), down[np.minimum(at, len(down) - 1)], len(self.lanes[depth + 1][0]))
        return passed


def units(piece: H.Piece) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every unit, and its width in code points."""
    data, n = piece.data, len(piece.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    first = point.copy()
    first[1:] &= ~(letter[1:] & letter[:-1])
    first[piece.bounds[:-1][piece.bounds[:-1] < n]] = True
    starts = np.flatnonzero(first)
    return starts, np.add.reduceat(point.astype(np.int32), starts)


def _draws(key: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]


def _cut(texts: pa.Array, draws: list[np.ndarray]) -> list[pa.Array]:
    """The output columns of some texts."""
    n, form, prefix, middle, output = (np.zeros(0, np.int64), [], [], [], [])
    counts = []
    for piece in H.pieces(texts):
        mine = slice(piece.first, piece.first + len(piece))
        h = [d[mine] for d in draws]
        starts, points = units(piece)
        bounds = np.searchsorted(starts, piece.bounds)
        size = np.diff(bounds)
        one, two = h[0] % (size + 1), h[1] % (size + 1)
        row = SkipList(points)
        begin, low, high = (row.points_before(bounds[:-1] + r) for r in (np.zeros_like(size), np.minimum(one, two), np.maximum(one, two)))
        low, high = low - begin, high - begin
        counts.append(size)
        for i, text in enumerate(texts.slice(piece.first, len(piece)).to_pylist()):
            text = text or ""
            if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2][i] % 100 >= TRANSFORMED:
                form.append("plain")
                prefix.append(None)
                middle.append(None)
                output.append(text)
                continue
            a, b = int(low[i]), int(high[i])
            head, mid, tail = text[:a], text[a:b], text[b:]
            prefix.append(a)
            middle.append(b - a)
            if h[3][i] % 100 < SUFFIX_FIRST:
                form.append("spm")
                output.append(f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}")
            else:
                form.append("psm")
                output.append(f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}")
    n = np.concatenate(counts) if counts else n
    return [
        pa.array(n.astype(np.int64)), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
        pa.array(middle, pa.int64()), pa.array(output, pa.string()),
    ]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    rest = [c for c in docs.columns if c not in OUTPUT]
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = kept.schema
    for name, kind in OUTPUT.items():
        schema = schema.add(name, kind)
    width = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few texts at a time: outputs are as long as the texts.
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                draws = [c.to_numpy(zero_copy_only=False) for c in part.columns[width + 1 :]]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *_cut(part.column(width), draws)], schema.names)

    # Names of the batch are its own, so none of the table's can clash.
    carried = [F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(rest)]
    return docs.select(*carried, F.col(f"`{text}`").alias("_t"), *_draws(key)).mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from it and its form alone."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2)))
        .when(F.col(form) == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(F.col(output))
    )
