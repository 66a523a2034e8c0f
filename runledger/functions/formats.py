"""Text forms used inside evidence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import memo
from .text import GIB, KIB, MIB, as_col

# ``%.1f`` prints 1024.0 from here on, so the next unit takes over.
_PROMOTE = 1023.95 / 1024.0
_LADDER = [("PiB", 1024**5), ("TiB", 1024**4), ("GiB", GIB), ("MiB", MIB), ("KiB", KIB)]


def _absent(c: Column) -> Column:
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))


def _clock(total: Column) -> Column:
    days = F.floor(total / 86400)
    rest = total - days * 86400
    hh = F.floor(rest / 3600)
    mm = F.floor((rest - hh * 3600) / 60)
    ss = rest - hh * 3600 - mm * 60
    hms = F.format_string("%02d:%02d:%02d", hh, mm, ss.cast("long"))
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("-"), hms)).otherwise(hms)


def printed(c, places: int) -> Column:
    """The double that ``%.<places>f`` prints as C does: by its exact binary value, halves to even.

    Java rounds the shortest decimal text of a double, halves up, so it prints 6.25 as 6.3 and 1.005 (a
    little less than that in binary) as 1.01.  What is returned has no more than ``places`` decimals left to
    round.  The product with a power of ten is rounded itself; where that gives a half, its error (by
    splitting the factor) decides.  From 2**52 / 10**places on a double stays as it is."""
    v = as_col(c).cast("double")
    scale = 10.0**places
    p = v * scale
    head = v * 134217729.0 - (v * 134217729.0 - v)  # the upper 26 bits
    error = (head * scale - p) + (v - head) * scale
    half = (F.abs(p - F.rint(p)) == 0.5) & (error != 0)
    whole = F.when(half, p + F.signum(error) * 0.5).otherwise(F.rint(p))
    return F.when(F.abs(p) < 2.0**52, whole / scale).otherwise(v)


@memo
def duration_text(c) -> Column:
    """``D-HH:MM:SS``; below a minute the seconds stay decimal.  Absent is ``n/a``."""
    c = as_col(c)
    s = c.cast("double")
    return (
        F.when(_absent(c), "n/a")
        .when(F.bround(s, 2) < 1, F.format_string("%.2fs", printed(s, 2)))
        .when(F.bround(s, 1) < 60, F.format_string("%.1fs", printed(s, 1)))
        .otherwise(_clock(F.bround(s, 0).cast("long")))
    )


@memo
def walltime_flag(c) -> Column:
    """Whole seconds in the spelling a time-limit option takes."""
    return _clock(as_col(c).cast("long"))


@memo
def bytes_text(c) -> Column:
    c = as_col(c)
    v = c.cast("double")
    out = F.when(_absent(c), "n/a")
    for unit, scale in _LADDER:
        out = out.when(v >= scale * _PROMOTE, F.format_string("%.1f " + unit, printed(v / scale, 1)))
    return out.otherwise(F.format_string("%d B", v.cast("long")))


@memo
def memory_flag(c) -> Column:
    """Whole GiB, rounded up and never zero; NULL stays NULL."""
    v = as_col(c).cast("double")
    return F.when(
        ~_absent(v), F.format_string("%dG", F.greatest(F.ceil(v / GIB), F.lit(1).cast("long")))
    )


@memo
def percent_text(c) -> Column:
    """A fraction as percent; an interior value is never printed as a boundary."""
    c = as_col(c)
    p = c.cast("double") * 100.0
    return (
        F.when(_absent(c), "n/a")
        .when((p > 0) & (p < 0.05), "<0.1%")
        .when((p >= 99.95) & (p < 100.0), ">99.9%")
        .otherwise(F.format_string("%.1f%%", printed(p, 1)))
    )


@memo
def percent_range_text(low, high) -> Column:
    return F.concat(
        F.regexp_replace(percent_text(low), "%$", ""), F.lit(" – "), percent_text(high)
    )


def clock_text(hz) -> Column:
    hz = as_col(hz)
    return (
        F.when(_absent(hz), "n/a")
        .when(hz >= 1e9, F.format_string("%.2f GHz", printed(hz / 1e9, 2)))
        .otherwise(F.format_string("%.0f MHz", printed(hz / 1e6, 0)))
    )


def plural(count, word: str) -> Column:
    """``word`` with an s unless the count prints as one."""
    n = F.bround(F.coalesce(as_col(count), F.lit(0)).cast("double"), 0)
    return F.when(n == 1, word).otherwise(word + "s")


def counted(count, word: str) -> Column:
    return F.concat(as_col(count).cast("long").cast("string"), F.lit(" "), plural(count, word))


def compact_number(c) -> Column:
    """Shortest form of a number: 6.0 prints as 6, 2.5 as 2.5 (six digits kept)."""
    d = as_col(c).cast("double")
    whole = d == F.floor(d)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", d), "0+$", ""), r"\.$", "")
    return F.when(whole, F.format_string("%d", d.cast("long"))).otherwise(text)
