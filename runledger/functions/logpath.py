"""Where a job's log may be: recorded patterns, submit options, conventional names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .hostlist import first_host
from .memo import memo
from .stats import let

# Conventional log names, subdirectories and suffixes, in search order.
NAME_PATTERNS = ["slurm-{jid}.out", "slurm-{jid}.err", "{jid}.out", "{jid}.err", "slurm_{jid}.out", "job-{jid}.out"]
SUBDIRS = ["", "logs", "log", "report", "slurm_logs", "out", "outputs"]
SUFFIX_ORDER = [".err", ".out", ".log"]
NULL_DEVICE = "/dev/null"
MAX_PAD = 64

_CODES = "%AaJjNnstux"


#: A segment that ``normal_path`` takes away; most paths have none.
_ODD_SEGMENT = r"^\.{1,2}(/|$)|/\.{0,2}(/|$)"


def normal_path(c) -> Column:
    """Collapse ``//``, ``.`` and ``..`` segments."""
    c = text.as_col(c)
    parts = F.filter(F.split(c, "/"), lambda p: (F.length(p) > 0) & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    collapsed = F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(c.rlike(_ODD_SEGMENT), collapsed).otherwise(c)


def pattern_values() -> Column:
    """Code -> text for this job; a code without a value makes a pattern unusable."""
    own = F.when(
        F.length("job_id_raw") > 0, F.col("job_id_raw")
    ).otherwise(F.col("job_id"))
    task = text.null_if_empty(F.regexp_extract("job_id", r"^[^_]*_(.*)$", 1))
    values = {
        "%": F.lit("%"),
        "A": text.array_master("job_id"),
        "a": F.coalesce(task, F.lit("0")),
        "j": own,
        "J": own,
        "s": F.lit("batch"),
        "u": F.col("user"),
        "x": F.col("name"),
        "N": first_host("node_list"),
        "n": F.lit("0"),
        "t": F.lit("0"),
    }
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v.cast("string"))])


def expand_pattern(pattern, values) -> Column:
    """``run-%4a_%j.out`` for this job; NULL when a code has no value."""
    pattern, values = text.as_col(pattern), text.as_col(values)
    tokens = F.regexp_extract_all(pattern, F.lit(rf"(%[0-9]*[{_CODES}]|[^%]+|%)"), F.lit(1))

    def fill(token: Column) -> Column:
        value = text.null_if_empty(F.try_element_at(values, F.right(token, F.lit(1))))
        width = F.regexp_extract(token, "^%([0-9]+)", 1).try_cast("int")
        padded = F.lpad(value, F.greatest(F.least(width, F.lit(MAX_PAD)), F.length(value)), F.lit("0"))
        filled = F.when(width.isNotNull() & value.rlike("^[0-9]+$"), padded).otherwise(value)
        return F.when(token.rlike(rf"^%[0-9]*[{_CODES}]$"), filled).otherwise(token)

    filled = F.transform(tokens, fill)
    return F.when(
        (F.length(pattern) > 0) & ~F.exists(filled, lambda x: x.isNull()), F.array_join(filled, "")
    )


def _option(tokens: Column, long: str, short: str) -> Column:
    """Values of an option, last one first.  Both ``--opt=v``, ``--opt v`` and ``-ov``."""
    def value(t: Column, i: Column) -> Column:
        v = (
            F.when(t.startswith(long + "="), F.substring(t, F.lit(len(long) + 2), F.length(t)))
            .when(t.isin(long, short), F.get(tokens, i + 1))
            .when((F.length(t) > 2) & t.startswith(short), F.substring(t, F.lit(3), F.length(t)))
        )
        return F.when((F.length(v) > 0) & ~v.startswith("-"), v)

    return F.reverse(F.filter(F.transform(tokens, value), lambda x: x.isNotNull()))


@memo
def submit_patterns(line) -> Column:
    """Output patterns named on the recorded submit line, error options first.

    Simple quoting only: a line with an unbalanced quote gives none, and backslash
    escapes are not interpreted.
    """
    line = text.as_col(line)
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(line, F.lit(r"""((?:[^\s"']|"[^"]*"|'[^']*')+)"""), F.lit(1))
    tokens = F.transform(words, lambda w: F.regexp_replace(w, "[\"']", ""))
    balanced = ~F.regexp_replace(line, r"""("[^"]*"|'[^']*')""", "").rlike("[\"']")
    found = F.concat(_option(tokens, "--error", "-e"), _option(tokens, "--output", "-o"))
    return F.when(balanced, found).otherwise(none)


def is_log_name(c: Column) -> Column:
    return c.rlike(r"\.(out|err|log)$")


def has_recorded_paths() -> Column:
    """Is anything recorded that ``recorded_paths`` reads?"""
    given = [F.length(c) > 0 for c in ("std_err", "std_out", "submit_line", "comment")]
    return F.coalesce(reduce(lambda a, b: a | b, given), F.lit(False))


def recorded_paths(values: str) -> Column:
    """Distinct absolute paths from recorded patterns, most specific source first."""
    comment = F.trim("comment")
    patterns = F.concat(
        F.array("std_err", "std_out"),
        F.coalesce(submit_patterns("submit_line"), F.array().cast("array<string>")),
        F.array(F.when(comment.startswith("/") & is_log_name(comment), comment)),
    )

    def locate(p: Column) -> Column:
        path = expand_pattern(p, values)
        rooted = F.when(
            ~path.startswith("/") & (F.length("work_dir") > 0), F.concat("work_dir", F.lit("/"), path)
        ).otherwise(path)
        return F.when(path.isNotNull(), normal_path(rooted))

    return F.array_distinct(F.filter(F.transform(patterns, locate), lambda x: x.isNotNull()))


def _own_dirs(body: Callable[[Callable[[str], Column]], Column], none: Column) -> Column:
    """``body`` of the work directory's subdirectories, whose normal form is found once; ``none`` without one."""

    def under(root: Column) -> Column:
        head = F.when(root.isin("", "/"), root).otherwise(F.concat(root, F.lit("/")))
        return body(lambda sub: F.concat(head, F.lit(sub)) if sub else root)

    return F.when(F.length("work_dir") > 0, let(normal_path("work_dir"), under)).otherwise(none)


def searched_dirs(extra: Sequence[str]) -> Column:
    """Every root with its conventional subdirectories, in search order."""
    none = F.array().cast("array<string>")
    own = _own_dirs(lambda sub: F.array(*[sub(s) for s in SUBDIRS]), none)
    given = [normal_path(F.lit(f"{d}/{s}" if s else d)) for d in extra if d for s in SUBDIRS]
    return F.array_distinct(F.concat(F.array(*given), own)) if given else own


def scanned_dirs(extra: Sequence[str]) -> Column:
    """(dir, trusted): given directories are trusted, the work directory itself is not."""
    kind = "array<struct<dir:string,trusted:boolean>>"
    # A directory's subdirectories differ from it and from one another.
    own = _own_dirs(
        lambda sub: F.array(*[F.struct(sub(s).alias("dir"), F.lit(bool(s)).alias("trusted")) for s in SUBDIRS]),
        F.array().cast(kind),
    )
    given = [F.struct(normal_path(F.lit(d)).alias("dir"), F.lit(True).alias("trusted")) for d in extra if d]
    if not given:
        return own
    # The first mention of a directory decides.
    return F.aggregate(
        F.concat(F.array(*given), own),
        F.array().cast(kind),
        lambda acc, r: F.when(F.exists(acc, lambda a: a["dir"] == r["dir"]), acc).otherwise(
            F.concat(acc, F.array(r))
        ),
    )


def identifiers() -> Column:
    """Ids a log name may carry, most specific first."""
    plain = F.substring_index(F.substring_index("job_id", ".", 1), "+", 1)
    ids = F.array(F.col("job_id"), F.col("job_id_raw"), plain, text.array_master(plain))
    return F.array_distinct(F.filter(ids, lambda x: F.length(x) > 0))


def suffix_rank(name) -> Column:
    ext = F.regexp_extract(text.as_col(name), r"(\.[^./]*)$", 1)
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(s) for s in SUFFIX_ORDER]), ext), F.lit(0)) - 1, F.lit(3)
    ).cast("int")
