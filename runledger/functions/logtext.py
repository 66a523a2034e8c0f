"""Reading the end of a log: markers, the last traceback, the last lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import memo
from .stats import let
from .text import as_col

# Lower-case substrings that identify a cause.
DEVICE_MEMORY = [
    "cuda out of memory", "cuda error: out of memory", "torch.cuda.outofmemoryerror",
    "hip out of memory", "cublas_status_alloc_failed",
]
COLLECTIVE = [
    "watchdog caught collective operation timeout", "ncclinternalerror", "ncclunhandledcudaerror",
    "ncclsystemerror", "ncclremoteerror", "nccl error", "nccl timeout", "nccl warn", "distbackenderror",
]
IMPORT = ["modulenotfounderror", "importerror", "no module named"]
TRACEBACK_HEADER = "Traceback (most recent call last)"

EXCERPT_LINES = 6

# Line breaks Python's splitlines knows beyond \n and \r.
_BREAKS = "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029]"


def has_marker(lowered: Column, markers: list[str]) -> Column:
    return lowered.rlike("|".join(re.escape(m).replace("\\ ", " ") for m in markers))


def lines_of(c) -> Column:
    # One character splits without a pattern, which Java would compile anew for every text.
    parts = F.split(F.regexp_replace(as_col(c), _BREAKS, "\n"), "\n")
    # A final line break ends the last line, it does not start an empty one.
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def _unranked(line: Column) -> Column:
    """Drop a launcher's ``[rank3]: `` prefix."""
    return F.when(line.contains("[rank"), F.regexp_replace(line, r"^\s*\[rank[^\]]*\]: ", "")).otherwise(line)


def _rstrip(line: Column) -> Column:
    return F.rtrim(line, F.lit(" \t\n\u000b\f\r"))


def _told(lines: Column) -> Column:
    """Lines with text, without white space at their ends."""
    return F.filter(F.transform(lines, _rstrip), lambda x: F.length(x) > 0)


def is_header(line: Column) -> Column:
    """Does a traceback begin in this line?"""
    return line.contains(TRACEBACK_HEADER) & F.ltrim(_unranked(line)).startswith(TRACEBACK_HEADER)


def is_stop(line: Column) -> Column:
    """Is this line, after a header, the last of its traceback?"""
    return _unranked(line).rlike(r"^\S")


@memo
def last_lines(c, n: int = EXCERPT_LINES) -> Column:
    # Bound step by step: a list that is named several times would be made as often.
    return let(_told(lines_of(c)), lambda kept: F.array_join(F.slice(kept, F.greatest(F.size(kept) - (n - 1), F.lit(1)), F.lit(n)), "\n"))


@memo
def traceback_tail(c, n: int = EXCERPT_LINES) -> Column:
    """The last traceback: its header through the first unindented line after it,
    shortened to the header, an ellipsis and the final ``n - 2`` lines."""

    def shown(chunk: Column) -> Column:
        short = F.concat(F.slice(chunk, 1, 1), F.array(F.lit("  ...")), F.slice(chunk, -(n - 2), n - 2))
        return F.array_join(F.when(F.size(chunk) > n, short).otherwise(chunk), "\n")

    def chunk_of(tail: Column) -> Column:
        """Of the lines from the last header on."""
        after = F.slice(tail, F.lit(2), F.size(tail))
        stop = F.array_position(F.transform(after, is_stop), True).cast("int")
        return let(F.when(stop > 0, stop + 1).otherwise(F.size(tail)), lambda k: let(_told(F.slice(tail, F.lit(1), k)), shown))

    def of_lines(lines: Column) -> Column:
        back = F.array_position(F.reverse(F.transform(lines, is_header)), True).cast("int")
        return let(back, lambda b: F.when(b > 0, let(F.slice(lines, -b, b), chunk_of)))

    return F.when(as_col(c).contains(TRACEBACK_HEADER), let(lines_of(c), of_lines))


def digest(c) -> Column:
    """The same as a struct, of a log that is one string."""
    low = F.lower(as_col(c))
    return F.struct(
        F.coalesce(F.length(as_col(c)) == 0, F.lit(True)).alias("blank"),
        has_marker(low, DEVICE_MEMORY).alias("device_memory"), has_marker(low, COLLECTIVE).alias("collective"),
        has_marker(low, IMPORT).alias("import_error"), traceback_tail(c).alias("traceback"), last_lines(c).alias("excerpt"),
    )
