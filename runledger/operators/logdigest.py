"""What a diagnosis needs of a log, from all its lines.

Markers, the last traceback and the last lines are found by a state machine over lines whose
states combine: a stretch of a log is told by its markers, its last traceback as far as it
goes, the lines that would still belong to a traceback begun earlier, and its last lines.
Every split of a file gives one such row, however many lines it has, and a file's rows are
combined in order.  No log is ever held as one string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logtext

_HEADER, _STOP, _TEXT = 1, 2, 4
_MARKS = [(8, "device_memory", logtext.DEVICE_MEMORY), (16, "collective", logtext.COLLECTIVE), (32, "import_error", logtext.IMPORT)]
_SPACE = " \t\n\x0b\f\r"
_SHOWN = logtext.EXCERPT_LINES

_RUN = "struct<n:bigint,first:array<string>,last:array<string>,stopped:boolean>"
_STATE = f"src_file string, block bigint, marks int, head {_RUN}, prefix {_RUN}, excerpt array<string>, blank boolean"
DIGEST = "src_file string, blank boolean, device_memory boolean, collective boolean, import_error boolean, traceback string, excerpt string"


@dataclass
class _Run:
    """Lines with text up to the first one that is not indented: their number, the first and the last few."""

    n: int = 0
    first: list[str] = field(default_factory=list)
    last: list[str] = field(default_factory=list)
    stopped: bool = False

    def extend(self, n: int, first: list[str], last: list[str], stopped: bool) -> None:
        self.n += n
        self.first = (self.first + first)[:_SHOWN]
        self.last = (self.last + last)[-(_SHOWN - 2) :]
        self.stopped = stopped

    def shown(self) -> str:
        return "\n".join(self.first if self.n <= _SHOWN else [self.first[0], "  ...", *self.last])


@dataclass
class _State:
    marks: int = 0
    head: _Run | None = None
    prefix: _Run = field(default_factory=_Run)
    excerpt: list[str] = field(default_factory=list)
    blank: bool = True

    def add(self, lines, flags: np.ndarray) -> None:
        """The next lines of this stretch (an Arrow array) with their flags."""
        n = len(flags)
        self.marks |= int(np.bitwise_or.reduce(flags)) if n else 0
        self.blank = self.blank and n == 0

        def text(places: np.ndarray) -> list[str]:
            return [lines[int(i)].as_py().rstrip(_SPACE) for i in places]

        def run_of(run: _Run, start: int, seek: int) -> None:
            """Extend by the lines from ``start`` to the first one from ``seek`` on that stops a traceback."""
            stops = np.flatnonzero(flags[seek:] & _STOP)
            end = seek + int(stops[0]) + 1 if len(stops) else n
            places = start + np.flatnonzero(flags[start:end] & _TEXT)
            run.extend(len(places), text(places[:_SHOWN]), text(places[-(_SHOWN - 2) :]), bool(len(stops)))

        if not self.prefix.stopped:
            run_of(self.prefix, 0, 0)
        headers = np.flatnonzero(flags & _HEADER)
        if len(headers):
            self.head = _Run()
            run_of(self.head, int(headers[-1]), int(headers[-1]) + 1)
        elif self.head is not None and not self.head.stopped:
            run_of(self.head, 0, 0)
        self.excerpt = (self.excerpt + text(np.flatnonzero(flags & _TEXT)[-_SHOWN:]))[-_SHOWN:]

    def then(self, later: _State) -> None:
        """Append the stretch that follows."""
        self.marks |= later.marks
        p = later.prefix
        if later.head is not None:
            self.head = later.head
        elif self.head is not None and not self.head.stopped:
            self.head.extend(p.n, p.first, p.last, p.stopped)
        if not self.prefix.stopped:
            self.prefix.extend(p.n, p.first, p.last, p.stopped)
        self.excerpt = (self.excerpt + later.excerpt)[-_SHOWN:]
        self.blank = self.blank and later.blank


def _run_row(run: _Run | None) -> dict | None:
    return None if run is None else {"n": run.n, "first": run.first, "last": run.last, "stopped": run.stopped}


def _states(batches: Iterator) -> Iterator:
    """One state per split from (src_file, block, line, flags) in order."""
    import pyarrow as pa

    place, state = None, _State()

    def row():
        return {
            "src_file": place[0], "block": place[1], "marks": state.marks, "head": _run_row(state.head), "prefix": _run_row(state.prefix),
            "excerpt": state.excerpt, "blank": state.blank,
        }

    for batch in batches:
        file, block, flags = batch.column(0), batch.column(1).to_numpy(), batch.column(3).to_numpy()
        if not len(block):
            continue
        code = file.dictionary_encode().indices.to_numpy()
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (code[1:] != code[:-1])
        out = []
        for s, e in zip((starts := np.flatnonzero(new)), np.append(starts[1:], len(block)), strict=True):
            here = file[int(s)].as_py(), int(block[s])
            if here != place:
                if place is not None:
                    out.append(row())
                place, state = here, _State()
            state.add(batch.column(2).slice(int(s), int(e - s)), flags[s:e])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_arrow_state())
    if place is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=_arrow_state())


def _arrow_state():
    import pyarrow as pa

    run = pa.struct([("n", pa.int64()), ("first", pa.list_(pa.string())), ("last", pa.list_(pa.string())), ("stopped", pa.bool_())])
    return pa.schema(
        [("src_file", pa.string()), ("block", pa.int64()), ("marks", pa.int32()), ("head", run), ("prefix", run), ("excerpt", pa.list_(pa.string())), ("blank", pa.bool_())]
    )


def _digests(batches: Iterator) -> Iterator:
    """One digest per file from its states in order."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in DIGEST.split(", "))])
    file, total = None, _State()

    def row():
        return {
            "src_file": file, "blank": total.blank, **{name: bool(total.marks & bit) for bit, name, _ in _MARKS},
            "traceback": total.head.shown() if total.head else None, "excerpt": "\n".join(total.excerpt),
        }

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state = _State(r["marks"], _Run(**r["head"]) if r["head"] else None, _Run(**r["prefix"]), r["excerpt"], r["blank"])
            if r["src_file"] == file:
                total.then(state)
                continue
            if file is not None:
                out.append(row())
            file, total = r["src_file"], state
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if file is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def digests(lines: DataFrame, log: Column | None = None) -> DataFrame:
    """One row per file of ``lines.read_lines``: markers, last traceback, last lines (``DIGEST``).

    With ``log``, an expression of ``src_file``, one row (under that name) per log of several files in order of their names."""
    valid = F.make_valid_utf8("line")
    # A line may hold further breaks (carriage returns, form feeds) that end lines of a log too.
    parts = logtext.lines_of(F.regexp_replace(valid, "\r$", ""))
    parts = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    each = lines.select("src_file", "block", F.explode(parts).alias("line"))
    low = F.lower("line")
    bits = [(_HEADER, logtext.is_header(F.col("line"))), (_STOP, logtext.is_stop(F.col("line"))), (_TEXT, F.col("line").rlike(r"\S"))]
    bits += [(bit, logtext.has_marker(low, words)) for bit, _, words in _MARKS]
    flags = sum((F.when(when, F.lit(bit)).otherwise(0) for bit, when in bits), F.lit(0))
    states = each.select("src_file", "block", "line", flags.cast("int").alias("flags")).mapInArrow(_states, _STATE)
    states = states.withColumns({"_part": F.col("src_file"), "src_file": F.col("src_file") if log is None else log})
    return states.repartition("src_file").sortWithinPartitions("src_file", "_part", "block").mapInArrow(_digests, DIGEST)
