"""Readers for the text forms an accounting dump uses.

All of them share one rule: a value that cannot be read is NULL and a real zero
stays 0.  A number is what a decimal pattern captures, because Java's own parser also
accepts suffixes (``1d``) and specials (``NaN``) that are not measurements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import memo

# Words the accounting tool prints in place of a value.
UNSET_WORDS = ["", "unknown", "none", "n/a", "unlimited", "(null)", "partition_limit"]
NO_NODES = "None assigned"

KIB = 1024
MIB = 1024**2
GIB = 1024**3
BYTE_UNITS = {"k": KIB, "m": MIB, "g": GIB, "t": 1024**4, "p": 1024**5}
CLOCK_UNITS = {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12}
CLOCK_FLOOR_HZ = 400e6
CLOCK_CEILING_HZ = 6e9

# Decimal text that always fits a double, so a match is always finite.  Expressions
# below mention their input once per captured group: generated code stays small, which
# matters when a hundred columns are parsed in one projection.
_NUM = r"[+-]?(?:[0-9]{1,99}(?:\.[0-9]{0,99})?|\.[0-9]{1,99})(?:[eE][+-]?[0-9]{1,2})?"
_PART = r"[0-9]{1,15}(?:\.[0-9]{0,15})?"
_DURATION = rf"^\s*(?:([0-9]{{1,12}})-)?(?:(?:({_PART}):)?({_PART}):)?({_PART})\s*$"


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def null_if_empty(c) -> Column:
    c = as_col(c)
    return F.when(F.length(c) > 0, c)


@memo
def clean(c) -> Column:
    """Trimmed text, NULL for every spelling of "not recorded"."""
    t = F.trim(as_col(c))
    return _given(c, F.when(~F.lower(t).isin(UNSET_WORDS), t))


@memo
def free_text(c) -> Column:
    """Trimmed text a person chose: ``None`` is a legal job name, only "" is absent."""
    return null_if_empty(F.trim(as_col(c)))


def _given(c, value: Column) -> Column:
    """Only look at text that is there: a failing cast of '' costs an exception per row,
    and most cells of a dump are empty."""
    return F.when(F.length(as_col(c)) > 0, value)


def _group(c, pattern: str, index: int) -> Column:
    """A captured group; no match and an empty group are both ''."""
    return F.regexp_extract(as_col(c), pattern, index)


def _double(c, pattern: str, index: int) -> Column:
    return _group(c, pattern, index).try_cast("double")


@memo
def to_double(c) -> Column:
    return _given(c, _double(c, rf"^\s*({_NUM})\s*$", 1))


@memo
def to_long(c) -> Column:
    """Through double, truncated toward zero; out of range is NULL."""
    return to_double(c).try_cast("bigint")


def digits_to_long(c) -> Column:
    return _given(c, _group(c, "^[0-9]+$", 0).try_cast("bigint"))


@memo
def duration(c) -> Column:
    """``[D-]HH:MM:SS``, ``MM:SS[.mmm]`` or seconds, in seconds."""
    # A leading zero makes an absent part 0 and leaves a present one as it is.
    days, hours, minutes = (
        F.concat(F.lit("0"), _group(c, _DURATION, i)).try_cast("double") for i in (1, 2, 3)
    )
    value = days * 86400 + hours * 3600 + minutes * 60 + _double(c, _DURATION, 4)
    return _given(c, value)


@memo
def seconds(raw, formatted) -> Column:
    """The integer column when the release has it, else the formatted one."""
    return F.coalesce(to_long(raw).cast("double"), duration(formatted))


def _scaled(c, units: dict, bare: float, trailer: str = "") -> Column:
    letters = "".join(units) + "".join(units).upper()
    pattern = rf"^\s*({_NUM})\s*([{letters}]?){trailer}\s*$"
    table = {"": float(bare), **{k: float(v) for k, v in units.items()}}
    factor = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    suffix = F.lower(_group(c, pattern, 2))
    return _given(c, _double(c, pattern, 1) * F.try_element_at(factor, suffix))


@memo
def byte_size(c) -> Column:
    """``53741792K``, ``40Gn``, ``1024`` in bytes; a trailing ``n``/``c`` is a scope."""
    return _scaled(c, BYTE_UNITS, 1, "[nc]*").try_cast("bigint")


@memo
def memory_limit(c) -> Column:
    """A memory request in bytes: a bare number is MiB and a zero limit is no limit."""
    value = _scaled(c, BYTE_UNITS, MIB, "[nc]*").try_cast("bigint")
    return F.nullif(value, F.lit(0).cast("bigint"))


@memo
def memory_scope(c) -> Column:
    t = F.trim(as_col(c))
    return F.when(t.endswith("n"), F.lit("node")).when(t.endswith("c"), F.lit("cpu"))


@memo
def exit_part(c, index: int) -> Column:
    """``code:signal``: part 0 is the code, part 1 the signal."""
    number = r"\s*([+-]?[0-9]+)\s*"
    pattern = rf"^{number}(?::|$)" if index == 0 else rf"^[^:]*:{number}$"
    return _given(c, _group(c, pattern, 1).try_cast("int"))


@memo
def clock_hz(c) -> Column:
    """Average CPU clock.  The printed unit may sit on a Hz or a kHz base, so both
    readings are tried and only one inside a real clock range is believed."""
    value = _scaled(c, CLOCK_UNITS, 1)
    readings = F.transform(F.array(F.lit(1.0), F.lit(1e3)), lambda base: value * base)
    real = F.filter(readings, lambda hz: hz.between(CLOCK_FLOOR_HZ, CLOCK_CEILING_HZ))
    return F.get(real, F.lit(0))


# -- states and ids -------------------------------------------------------------

@memo
def canonical_state(c) -> Column:
    return F.regexp_replace(as_col(c), r"^OUT_OF_ME\+(?= |$)", "OUT_OF_MEMORY")


@memo
def node_list_text(c) -> Column:
    """A node list, with the sentence for "never allocated" read as absent."""
    t = clean(c)
    return F.when(t != NO_NODES, t)


@memo
def canceller_uid(state) -> Column:
    return null_if_empty(F.regexp_extract(as_col(state), r"^\s*CANCELLED\s+by\s+([0-9]+)\s*$", 1))


@memo
def scheduled_by(flags) -> Column:
    f = F.lower(as_col(flags))
    return (
        F.when(f.contains("backfill"), "backfill")
        .when(f.contains("schedmain"), "main")
        .when(f.contains("schedsubmit"), "submit")
    )


def base_id(step_id) -> Column:
    return F.substring_index(as_col(step_id), ".", 1)


def array_master(job_id) -> Column:
    return F.substring_index(as_col(job_id), "_", 1)


def queryable_id(job_id) -> Column:
    """An array that was never expanded (``12_[3-9]``) is asked about by its master."""
    c = as_col(job_id)
    return F.when(c.rlike(r"^[0-9]+_\["), array_master(c)).otherwise(c)


@memo
def id_primary(job_id) -> Column:
    plain = F.substring_index(as_col(job_id), "+", 1)
    return F.coalesce(digits_to_long(F.substring_index(plain, "_", 1)), F.lit(0).cast("long"))


@memo
def id_task(job_id) -> Column:
    plain = F.substring_index(as_col(job_id), "+", 1)
    return F.coalesce(
        F.when(plain.contains("_"), digits_to_long(F.regexp_extract(plain, r"^[^_]*_(.*)$", 1))),
        F.lit(-1).cast("long"),
    )


@memo
def fold_name(name) -> Column:
    """Every digit run (any script) becomes ``#``; a nameless job is ``?``."""
    c = as_col(name)
    return F.when(F.length(c) > 0, F.regexp_replace(c, r"\p{Nd}+", "#")).otherwise("?")


@memo
def fold_erased(signature) -> Column:
    """True when folding left no letter, so the fold no longer names anything."""
    return ~as_col(signature).rlike(r"\p{L}")


# -- packed resource strings ----------------------------------------------------

def _key(key: str) -> str:
    return r"(?:^|,)\s*" + key


def _holding(c, key: str, value: Column) -> Column:
    return F.when(F.contains(as_col(c), F.lit(key)), value)


@memo
def tres_int(c, key: str) -> Column:
    """First entry of ``key`` that starts with digits in ``cpu=6,gres/gpu=1,mem=80G``."""
    found = F.regexp_extract(as_col(c), _key(key) + r"\s*=\s*([0-9]+)", 1).try_cast("long")
    return _holding(c, key, found)


@memo
def tres_typed_sum(c, key: str) -> Column:
    """Sum over the model-qualified entries, ``gres/gpu:a100=4``; zero reads as absent."""
    hits = F.regexp_extract_all(as_col(c), F.lit(_key(key) + r":[^=,]*=\s*([0-9]+)"), F.lit(1))
    return F.nullif(
        F.aggregate(hits, F.lit(0).cast("long"), lambda s, x: s + x.try_cast("long")),
        F.lit(0).cast("long"),
    )


@memo
def tres_double(c, key: str) -> Column:
    found = F.regexp_extract(as_col(c), _key(key) + r"\s*=\s*([^,]*)", 1)
    return _holding(c, key, to_double(found))


@memo
def tres_bytes(c, key: str, zero_is_missing: bool = False) -> Column:
    found = F.regexp_extract(as_col(c), _key(key) + r"\s*=\s*([^,]*)", 1)
    value = _holding(c, key, byte_size(found))
    return F.nullif(value, F.lit(0).cast("bigint")) if zero_is_missing else value


@memo
def gres_sum(c, key: str) -> Column:
    """Device count of the colon form ``gpu:tesla:4``; a bare ``gpu`` is one device."""
    parts = F.transform(
        F.split(as_col(c), ","),
        lambda e: F.filter(F.transform(F.split(e, ":"), lambda p: F.trim(p)), lambda p: F.length(p) > 0),
    )
    mine = F.filter(parts, lambda p: F.lower(F.get(p, 0)) == key)
    one = F.lit(1).cast("long")
    count = F.aggregate(
        mine,
        F.lit(0).cast("long"),
        lambda s, p: s
        + F.when(
            F.size(p) > 1,
            F.coalesce(
                F.regexp_extract(F.get(p, F.size(p) - 1), r"^([0-9]+)", 1).try_cast("long"), one
            ),
        ).otherwise(one),
    )
    return F.nullif(count, F.lit(0).cast("long"))
