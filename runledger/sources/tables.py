"""Side inputs: window scans, the live queue, live counters, cluster settings, logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states, text
from ..functions.hostlist import explode_hosts
from ..operators import logdigest
from . import lines

# Log file suffixes and the pattern that lists them.
LOG_SUFFIXES = [".out", ".err", ".log"]
LOG_GLOB = "*.{out,err,log}"

_RELATIVE = re.compile(r"^(?:now)?\s*-\s*(\d+)\s*(second|minute|hour|day|week|month)s?$", re.IGNORECASE)
MAX_CPU_SECONDS = 366 * 24 * 3600


# -- windows -------------------------------------------------------------------------

def time_bound(spec: str) -> Column:
    """``-7days`` / ``now-7days`` / ``now`` / an ISO time, as a timestamp expression."""
    spec = spec.strip()
    relative = _RELATIVE.match(spec)
    now = F.localtimestamp()
    if relative:
        unit = relative.group(2).lower() + "s"
        return now - F.make_interval(**{unit: F.lit(int(relative.group(1)))})
    return now if spec.lower() == "now" else F.lit(spec).cast("timestamp_ntz")


def jobs_in_window(
    jobs: DataFrame,
    since: str | None = None,
    until: str | None = None,
    users: Sequence[str] | None = None,
    job_states: Sequence[str] | None = None,
    partition: str | None = None,
    job_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Whole jobs that ran inside the window; every filter can reach the scan.

    A state filter without an end bound still ends at now.  Explicit ids ignore the
    window.  On a table partitioned by ``end_date`` the lower bound also prunes
    partitions (open records sit in the NULL partition and are always read).
    """
    if job_ids is not None:
        return jobs.filter(F.col("job_id").isin([str(i) for i in job_ids]))
    if job_states and until is None:
        until = "now"
    df = jobs
    if since is not None:
        low = time_bound(since)
        df = df.filter(F.col("end").isNull() | (F.col("end") >= low))
        if "end_date" in jobs.columns:
            df = df.filter(F.col("end_date").isNull() | (F.col("end_date") >= low.cast("date")))
    if until is not None:
        df = df.filter(F.coalesce("start", "submit") <= time_bound(until))
    if users:
        df = df.filter(F.col("user").isin(list(users)))
    if job_states:
        df = df.filter(states.base_state("state").isin([s.upper() for s in job_states]))
    if partition:
        df = df.filter(F.col("partition") == partition)
    return df


def steps_of(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """All steps of the selected jobs: the window never clips steps."""
    return steps.join(jobs.select("alloc_id"), "alloc_id", "left_semi")


# -- the live queue and live counters ----------------------------------------------------

def live_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct ids of a queue listing; ``900_[5-10%2]`` also counts as its tasks."""
    token = F.trim(F.col(column))
    plain = F.regexp_replace(token, r"%[0-9]+", "")
    rows = lines.filter(F.length(token) > 0).select(token.alias("job_id"), F.when(token.contains("["), plain).alias("_tasks"))
    # A pending array may name millions of tasks in one line.
    tasks = explode_hosts(rows.select("_tasks"), "_tasks", "job_id")
    return rows.select("job_id").unionByName(tasks).distinct()


def live_step_metrics(rows: DataFrame) -> DataFrame:
    """Counters of running steps from their text columns (JobID, MaxRSS, MaxRSSNode,
    MaxRSSTask, AveRSS, MaxVMSize, MaxPages, AveCPU, NTasks); empty rows dropped."""
    cpu = text.duration("AveCPU")
    measured = {
        "max_rss": text.byte_size("MaxRSS"),
        "ave_rss": text.byte_size("AveRSS"),
        "max_vmsize": text.byte_size("MaxVMSize"),
        "max_pages": text.byte_size("MaxPages"),
        # An overflowed counter is not a measurement.
        "ave_cpu": F.when(cpu.between(0, MAX_CPU_SECONDS), cpu),
    }
    step = text.clean("JobID")
    typed = rows.select(
        text.base_id(step).alias("job_id"), step.alias("step_id"),
        *[c.alias(n) for n, c in measured.items()],
        text.clean("MaxRSSNode").alias("max_rss_node"), text.clean("MaxRSSTask").alias("max_rss_task"),
        text.to_long("NTasks").alias("ntasks"),
    )
    return typed.filter(F.col("step_id").contains(".") & F.coalesce(*measured).isNotNull())


# -- cluster settings ----------------------------------------------------------------------

def site_config(settings: DataFrame) -> DataFrame:
    """One row per cluster from ``(cluster, key, value)`` settings."""
    keys = {
        "version": "slurm_version",
        "gather_type": "jobacctgathertype",
        "storage_type": "accountingstoragetype",
        "tres_text": "accountingstoragetres",
        "frequency": "jobacctgatherfrequency",
    }
    value = F.trim("value")
    known = F.when((F.lower(value) != "(null)") & (F.length(value) > 0), value)
    df = settings.groupBy("cluster").agg(
        *[F.max(F.when(F.lower(F.trim("key")) == k, known)).alias(n) for n, k in keys.items()]
    )
    tres = F.filter(F.transform(F.split("tres_text", ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    task = F.regexp_extract(F.lower("frequency"), r"(?:^|,)\s*task\s*=\s*([^,]*)", 1)
    raw = F.trim(F.when(F.col("frequency").contains("="), task).otherwise(F.col("frequency")))
    every = F.when(raw.rlike(r"^[0-9]+$"), raw.try_cast("int"))
    return df.select(
        "cluster", "version", "gather_type", "storage_type",
        tres.alias("tres"),
        F.when(every > 0, every).alias("sampling_seconds"),
        F.col("gather_type").contains("cgroup").alias("from_cgroup"),
        F.exists(tres, lambda t: (t == "gres/gpu") | t.startswith("gres/gpu:")).alias("tracks_gpu"),
        F.array_contains(tres, "gres/gpuutil").alias("tracks_gpu_utilization"),
    )


def partition_ceilings(nodes: DataFrame) -> DataFrame:
    """Largest node per partition; ``64+`` counts as 64, other text is unknown."""
    def count(c: str) -> Column:
        t = F.regexp_replace(F.trim(F.col(c).cast("string")), r"\++$", "")
        return text.digits_to_long(t)

    return nodes.groupBy("cluster", "partition").agg(
        F.max(count("cores")).alias("max_cores"), F.max(count("mem_mb")).alias("max_mem_mb")
    )


# -- log files -------------------------------------------------------------------------------

def log_files(spark: SparkSession, path: str, glob: str = LOG_GLOB, in_parts: bool = False) -> DataFrame:
    """``(path, dir, name, mtime, size, log)`` of the log files under ``path``: ``log`` holds what a diagnosis
    needs of the whole file (``logdigest.DIGEST``), whatever its size.  Spark's sources skip empty files.

    With ``in_parts``, a log is a folder of files, in order of their names, and ``path`` names the folder.
    The listing reads no content, so a report that needs no text (``drop("log")``) reads none."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    name = F.regexp_replace("path", r"^file:/+", "/").alias("path")
    listing = files.select(name, F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    folder = F.regexp_replace("src_file", r"/[^/]*$", "")
    if in_parts:
        listing = listing.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("path")).agg(F.max("mtime").alias("mtime"), F.sum("size").alias("size"))
    found = logdigest.digests(lines.read_lines(spark, path, glob), folder if in_parts else None)
    parts = [c for c in found.columns if c != "src_file"]
    told = found.select(lines.local_path(F.col("src_file")).alias("path"), F.struct(*parts).alias("log"))
    return with_location(listing).join(told, "path", "left")


def with_location(files: DataFrame) -> DataFrame:
    return files.withColumns(
        {
            "dir": F.regexp_replace("path", r"/[^/]*$", ""),
            "name": F.regexp_extract("path", r"([^/]*)$", 1),
        }
    )
