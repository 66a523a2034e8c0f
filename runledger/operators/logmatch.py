"""Which log file belongs to which job: by recorded path, by name, by id, by time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logpath as lp
from .common import by_rows, cut
from .intervals import greedy_match, window_matches

SLACK_BEFORE_MS = 60 * 1000
SLACK_AFTER_MS = 600 * 1000
MIN_NAME = 3

_JOB = [
    "alloc_id", "job_id", "job_id_raw", "name", "user", "node_list", "start", "end", "work_dir",
    "comment", "std_out", "std_err", "submit_line",
]


def _logs_only(files: DataFrame) -> DataFrame:
    return files.filter(lp.is_log_name(F.col("name")))


def by_recorded_path(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """First recorded path that exists."""
    wanted = jobs.filter(lp.has_recorded_paths()).withColumn("_v", lp.pattern_values()).select(
        "alloc_id", F.posexplode(lp.recorded_paths("_v")).alias("priority", "path")
    )
    # Most jobs of a site may record the null device: it is no file, and one key of a join.
    wanted = wanted.filter(F.col("path") != lp.NULL_DEVICE)
    hits = wanted.join(files.select("path"), "path")
    return hits.groupBy("alloc_id").agg(F.min_by("path", "priority").alias("path"))


def _convention_of(name: Column) -> Column:
    """(pattern rank, id) for every conventional form a file name has."""
    forms = []
    for rank, pattern in enumerate(lp.NAME_PATTERNS):
        head, tail = pattern.split("{jid}")
        regex = "^" + head + r"([0-9][^/]*)" + tail.replace(".", r"\.") + "$"
        forms.append(
            F.when(
                name.rlike(regex),
                F.struct(F.lit(rank).alias("form"), F.regexp_extract(name, regex, 1).alias("ident")),
            )
        )
    return F.filter(F.array(*forms), lambda x: x.isNotNull())


def by_convention(jobs: DataFrame, files: DataFrame, extra_dirs: Sequence[str] = ()) -> DataFrame:
    """Conventional names in the searched directories: the name is taken apart once per
    file, so the join is on (directory, id) instead of on every candidate path."""
    named = files.select("path", "dir", F.explode(_convention_of(F.col("name"))).alias("f")).select(
        "path", "dir", "f.form", "f.ident"
    )
    jid = F.substring_index(F.substring_index("job_id", ".", 1), "+", 1)
    ids = F.array_distinct(F.array(jid, F.substring_index(jid, "_", 1)))
    wanted = jobs.select("alloc_id", ids.alias("_ids"), F.posexplode(lp.searched_dirs(extra_dirs)).alias("dir_rank", "dir"))
    wanted = wanted.select("alloc_id", "dir_rank", "dir", F.posexplode("_ids").alias("id_rank", "ident"))
    hits = wanted.join(named, ["dir", "ident"])
    return hits.groupBy("alloc_id").agg(
        F.min_by("path", F.struct("dir_rank", "form", "id_rank")).alias("path")
    )


def by_id(jobs: DataFrame, files: DataFrame, extra_dirs: Sequence[str] = ()) -> DataFrame:
    """A job id anywhere in the name, delimited by non-digits."""
    runs = F.array_distinct(F.regexp_extract_all("name", F.lit(r"([0-9]+)"), F.lit(1)))
    indexed = _logs_only(files).select("path", "dir", "name", F.explode(runs).alias("digits"))
    ids = F.transform(lp.identifiers(), lambda i: F.struct(i.alias("ident"), F.regexp_extract(i, r"([0-9]+)", 1).alias("digits")))
    wanted = jobs.select("alloc_id", ids.alias("_ids"), lp.scanned_dirs(extra_dirs).alias("_dirs"))
    wanted = wanted.select("alloc_id", "_dirs", F.posexplode("_ids").alias("id_rank", "_i"))
    wanted = wanted.select("alloc_id", "id_rank", "_i.*", F.posexplode("_dirs").alias("dir_rank", "_d"))
    wanted = wanted.select("alloc_id", "id_rank", "ident", "digits", "dir_rank", "_d.dir")
    carried = F.concat(F.lit(r"(^|[^0-9])\Q"), F.col("ident"), F.lit(r"\E($|[^0-9])"))
    plain = F.col("ident") == F.col("digits")
    hits = wanted.join(indexed, ["dir", "digits"]).filter(plain | F.regexp_like("name", carried))
    order = F.struct("id_rank", "dir_rank", lp.suffix_rank("name"), "name")
    return hits.groupBy("alloc_id").agg(F.min_by("path", order).alias("path"))


def by_name(jobs: DataFrame, files: DataFrame, extra_dirs: Sequence[str] = ()) -> DataFrame:
    """Recorded path, else conventional name, else id in the name; each step sees only jobs that those before
    it left without a file."""
    rest = jobs.select(*_JOB)
    found: list[DataFrame] = []
    for step in (by_recorded_path, by_convention, by_id):
        if found:
            rest = rest.join(found[-1].select("alloc_id"), "alloc_id", "left_anti")
        found.append(cut(step(rest, files) if step is by_recorded_path else step(rest, files, extra_dirs)))
    return reduce(DataFrame.unionByName, found)


# -- by time -----------------------------------------------------------------------------------

def _millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def time_sides(jobs: DataFrame, files: DataFrame, extra_dirs: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Intervals and points for matching by time.

    The group says in which directory and why a file may belong to the job: any log of
    a trusted directory, else a name with the scheduler's prefix, a digit run equal to
    one of the job's ids, or the job's own name inside it.
    """
    mark = F.lower(F.trim("name"))
    windows = jobs.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        F.col("alloc_id").alias("iid"),
        (_millis("start") - SLACK_BEFORE_MS).alias("lo"),
        _millis("end").alias("mid"),
        (_millis("end") + SLACK_AFTER_MS).alias("hi"),
        F.when(F.length(mark) >= MIN_NAME, mark).alias("mark"),
        F.filter(lp.identifiers(), lambda x: x.rlike("^[0-9]+$")).alias("ids"),
        lp.scanned_dirs(extra_dirs).alias("dirs"),
    )
    # Read twice: for the intervals, and for the names that files are asked about.
    windows = cut(windows).select("*", F.explode("dirs").alias("d"))
    untrusted = F.concat(
        F.array(F.lit("prefix")),
        F.transform("ids", lambda i: F.concat(F.lit("id:"), i)),
        F.filter(F.array(F.concat(F.lit("name:"), F.col("mark"))), lambda x: x.isNotNull()),
    )
    why = F.when(F.col("d.trusted"), F.array(F.lit("any"))).otherwise(untrusted)
    intervals = windows.select(
        "iid", "lo", "mid", "hi", F.col("d.dir").alias("dir"),
        F.when(F.col("d.trusted"), 0).otherwise(1).alias("pref"), F.explode(why).alias("why"),
    )
    logs = _logs_only(files)
    lowered = F.lower("name")
    digit_tags = F.transform(
        F.array_distinct(F.regexp_extract_all("name", F.lit(r"([0-9]+)"), F.lit(1))),
        lambda d: F.concat(F.lit("id:"), d),
    )
    tags = F.concat(
        F.array(F.lit("any")), digit_tags, F.filter(F.array(F.when(lowered.startswith("slurm"), "prefix")), lambda x: x.isNotNull())
    )
    point = [
        F.col("path").alias("pid"), "dir", F.unix_millis("mtime").alias("t"),
        F.when(F.col("size") == 0, 1).otherwise(0).alias("pclass"), lp.suffix_rank("name").alias("ptie"),
    ]
    tagged = logs.select(*point, F.explode(tags).alias("why"))
    # A job name inside a file name: file names are listed by their runs of three characters, and each
    # job name looks under the rarest of its own, so rows grow with the length of names and matches.
    names = windows.filter(~F.col("d.trusted") & F.col("mark").isNotNull()).select("d.dir", "mark").distinct()

    def runs(c: Column) -> Column:
        starts = F.when(F.length(c) >= MIN_NAME, F.sequence(F.lit(1), F.length(c) - (MIN_NAME - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(MIN_NAME))))

    listed = logs.select(*point, lowered.alias("_low"), F.explode(runs(lowered)).alias("run"))
    often = listed.groupBy("dir", "run").agg(F.count(F.lit(1)).alias("_n"))
    mine = names.withColumn("_runs", runs(F.col("mark"))).select("dir", "mark", F.size("_runs").alias("_need"), F.explode("_runs").alias("run"))
    # A name with a run that no file has is in none.
    rarest = mine.join(often, ["dir", "run"]).groupBy("dir", "mark", "_need").agg(
        F.count(F.lit(1)).alias("_have"), F.min_by("run", F.struct("_n", "run")).alias("run")
    ).filter("_have = _need")
    hits = listed.join(rarest.select("dir", "run", "mark"), ["dir", "run"]).filter(F.col("_low").contains(F.col("mark")))
    named = hits.select(
        "pid", "dir", "t", "pclass", "ptie", F.concat(F.lit("name:"), F.col("mark")).alias("why")
    )
    points = tagged.unionByName(named)
    grp = F.concat_ws("|", "dir", "why").alias("grp")
    points = cut(points.select("pid", grp, "t", "pclass", "ptie"))
    # A job asks in some ten groups, and most of them hold no file.
    held = by_rows(cut(points.select("grp").distinct()))
    return intervals.select("iid", grp, "lo", "mid", "hi", "pref").join(held, "grp", "left_semi"), points


def by_time(jobs: DataFrame, files: DataFrame, extra_dirs: Sequence[str] = ()) -> DataFrame:
    """Best file per job by closeness of its last write to the job's end."""
    intervals, points = time_sides(jobs.select(*_JOB), files, extra_dirs)
    best = window_matches(intervals, points)
    return best.select(F.col("iid").alias("alloc_id"), F.col("pid").alias("path"), "distance")


def assign_logs(jobs: DataFrame, files: DataFrame, extra_dirs: Sequence[str] = ()) -> DataFrame:
    """One log per job: name matches first, then a one-to-one assignment by time.

    Gives ``alloc_id, job_id, path, inferred``; a job without a log keeps a NULL path.
    """
    jobs = jobs.select(*_JOB)
    named = cut(by_name(jobs, files, extra_dirs))
    pending = jobs.join(named, "alloc_id", "left_anti")
    free = files.join(named.select("path").distinct(), "path", "left_anti")
    intervals, points = time_sides(pending, free, extra_dirs)
    intervals = cut(intervals)
    timed = greedy_match(intervals, points).select(
        F.col("iid").alias("alloc_id"), F.col("pid").alias("path"), F.lit(True).alias("inferred")
    )
    found = named.withColumn("inferred", F.lit(False)).unionByName(timed)
    return jobs.select("alloc_id", "job_id").join(found, "alloc_id", "left").withColumn(
        "inferred", F.coalesce("inferred", F.lit(False))
    )


def logs_of(assigned: DataFrame, files: DataFrame) -> DataFrame:
    """``alloc_id, log`` (what the assigned file says; NULL if it is empty)."""
    return assigned.filter(F.col("path").isNotNull()).join(files.select("path", "log"), "path").select("alloc_id", "log")


def with_expected(assigned: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """For jobs without a log, the first recorded path and why nothing is there."""
    first = jobs.select(*_JOB).withColumn("_v", lp.pattern_values()).select(
        "alloc_id", F.get(lp.recorded_paths("_v"), 0).alias("expected")
    )
    present = files.select(F.col("path").alias("expected"), F.lit(True).alias("_there"))
    df = assigned.join(first, "alloc_id", "left")
    # Only what can be there is looked up; the rest would meet on one key.
    asked = F.coalesce(F.col("path").isNull() & (F.col("expected") != lp.NULL_DEVICE), F.lit(False))
    looked_up = df.filter(asked).join(present, "expected", "left")
    df = looked_up.unionByName(df.filter(~asked).withColumn("_there", F.lit(None).cast("boolean")))
    status = (
        F.when(F.col("expected") == lp.NULL_DEVICE, "discarded")
        .when(F.col("_there"), "found")
        .otherwise("absent")
    )
    missing = F.col("path").isNull() & F.col("expected").isNotNull()
    return df.select(
        "alloc_id", "path", "inferred",
        F.when(missing, F.struct(F.col("expected").alias("path"), status.alias("status"))).alias("log_expected"),
    )
