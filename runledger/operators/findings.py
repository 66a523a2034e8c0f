"""Diagnostic rules: one projection turns a job's figures into finding rows.

Each rule is a condition and its texts.  All rules of a job form one array that is
filtered and exploded, so the whole rule set costs no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions import logtext, states, text
from ..functions.text import GIB, MIB
from . import sizing

CRITICAL, WARNING, INFO = "critical", "warning", "info"
SEVERITIES = [CRITICAL, WARNING, INFO]

# Thresholds.
LOW_CPU_UTIL = 0.15
MIN_ELAPSED_FOR_CPU = 120.0
WALLTIME_SLACK = 0.5
SYSTEM_CPU_HEAVY = 0.30
SYSTEM_CPU_MIN_SECONDS = 60.0
IO_RATE_LOUD = 100 * MIB
IO_VOLUME_FLOOR = 10 * GIB
STRAGGLER_SPREAD = 0.25
RSS_IMBALANCE = 2.0
PAGING_FLOOR = 1000
MEM_SLACK = 0.35
MEM_SLACK_FLOOR = 32 * GIB
GPU_IDLE = 0.05
GPU_UNDERUSED = 0.40
GPU_SUSPECT_CPU = 0.02

# States that already name who ended the job, and signal names.
KILL_EXPLAINED = ["OUT_OF_MEMORY", "TIMEOUT", "CANCELLED", "PREEMPTED", "NODE_FAIL"]
SIGNALS = {
    1: "SIGHUP", 2: "SIGINT", 3: "SIGQUIT", 6: "SIGABRT", 9: "SIGKILL", 11: "SIGSEGV",
    13: "SIGPIPE", 15: "SIGTERM", 24: "SIGXCPU", 25: "SIGXFSZ",
}


def severity_rank(severity) -> Column:
    c = text.as_col(severity)
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c), F.lit(0)) - 1, F.lit(99))


def _say(*parts) -> Column:
    """Concatenate text and columns; a NULL part prints as nothing."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


class _Rules:
    def __init__(self, codes: Collection[str] | None = None):
        self.items: list[Column] = []
        self.codes = codes

    def add(self, severity, code, when: Column, title, evidence, action="") -> None:
        if self.codes is not None and isinstance(code, str) and code not in self.codes:
            return

        def lit(v):
            return v if isinstance(v, Column) else F.lit(v)

        row = F.struct(
            lit(severity).alias("severity"), lit(code).alias("code"), lit(title).alias("title"),
            lit(evidence).alias("evidence"), lit(action).alias("action"),
        )
        self.items.append(F.when(F.coalesce(when, F.lit(False)), row))


def _walltime(r: _Rules) -> None:
    c, noop = F.col, F.col("is_noop")
    timeout = states.is_state("state", "TIMEOUT")
    elapsed, limit = fmt.duration_text("elapsed"), fmt.duration_text("timelimit")
    r.add(CRITICAL, "timeout-hang", timeout & noop, "Timed out without running",
          _say("Held for ", elapsed, " with ", fmt.duration_text("total_cpu"), " of CPU: blocked."),
          "A longer limit only lengthens the hang. Look for what it waits on.")
    r.add(CRITICAL, "timeout-real", timeout & ~noop, "Timed out while working",
          _say("Reached ", limit, " after ", fmt.duration_text("total_cpu"), " of CPU (", fmt.percent_text("cpu_utilization"), ")."),
          "Raise the limit clearly: the true run time is longer than what was seen.")
    r.add(INFO, "walltime-slack", c("is_completed") & ~noop & (c("walltime_used") < WALLTIME_SLACK),
          "Time limit far above the need",
          _say(elapsed, " of ", limit, " used (", fmt.percent_text("walltime_used"), ")."),
          "A shorter limit fits more backfill gaps.")


def _memory(r: _Rules, cgroup: Column, interval: Column) -> None:
    c = F.col
    rss, limit = c("max_rss"), c("mem_limit")
    oom = states.is_state("state", "OUT_OF_MEMORY")
    over = rss > limit
    caveat = sizing.rss_caveat(cgroup)
    thin = sizing.sampling_note("elapsed", interval)
    seen = F.when(
        over, _say(" The recorded peak ", fmt.bytes_text(rss), " is above the limit ", fmt.bytes_text(limit), " and cannot be a footprint: ", caveat, ".")
    ).when(
        rss.isNotNull() & limit.isNotNull(),
        _say(" Sampled peak ", fmt.bytes_text(rss), " of ", fmt.bytes_text(limit), "; the real peak reached the limit.",
             F.when(F.length(thin) > 0, _say(" (", thin, ")"))),
    )
    r.add(CRITICAL, "host-oom", oom, "Out of host memory", _say("Killed at its memory limit.", seen),
          "Raise the memory request, or reduce workers, prefetching or caches.")
    r.add(WARNING, "rss-above-limit", ~oom & over, "Peak memory above a limit that never fired",
          _say(fmt.bytes_text(rss), " against ", fmt.bytes_text(limit), " per node: ", caveat, "."),
          "Measure a live run before sizing memory.")
    unused = limit - rss
    slack = c("is_completed") & ~c("is_noop") & (F.try_divide(rss, limit) < MEM_SLACK) & (unused >= MEM_SLACK_FLOOR)
    r.add(INFO, "memory-slack", slack, "Far more memory reserved than touched",
          _say("Peak ", fmt.bytes_text(rss), " of ", fmt.bytes_text(limit), " (", fmt.percent_text(F.try_divide(rss, limit)), "), ", fmt.bytes_text(unused), " unused."),
          _say("Try --mem=", fmt.memory_flag(F.floor(rss * 1.3)), " (peak plus 30%); ", caveat, ".",
               F.when(F.length(thin) > 0, _say(" Thinly sampled: ", thin, "."))))


def _cpu(r: _Rules, cgroup: Column) -> None:
    c = F.col
    explained = F.coalesce(c("base_state").isin(states.CPU_EXPLAINED_STATES), F.lit(False))
    judged = ~states.is_state("state", "TIMEOUT") & ~c("open_ended") & ~explained
    loud = F.coalesce((c("io_bytes") >= IO_VOLUME_FLOOR) & (c("io_rate") >= IO_RATE_LOUD), F.lit(False))
    held = F.when(c("gpu_count") > 0, F.format_string(", %d GPU(s) held", "gpu_count"))
    base = _say(fmt.duration_text("elapsed"), " of wall clock, ", fmt.duration_text("total_cpu"), " of CPU", held)
    r.add(CRITICAL, "noop-allocation", judged & c("is_noop") & loud, "No computing: the time went to I/O",
          _say(base, ", ", fmt.bytes_text("io_bytes"), " moved at ", fmt.bytes_text("io_rate"), "/s."),
          "Stage the input on faster storage or overlap transfer with compute.")
    outcome = F.when(F.coalesce(cgroup, F.lit(False)), "Nothing was computed.").otherwise(
        _say("No CPU time was attributed to it; ", sizing.cpu_caveat(cgroup), "."))
    r.add(CRITICAL, "noop-allocation", judged & c("is_noop") & ~loud, "The allocation did nothing",
          _say(base, ". ", outcome), "Find the blocking call, or work done by detached processes.")
    util, cores = c("cpu_utilization"), c("cpu_count")
    per_task = F.coalesce("cpus_per_task", cores)
    idle = judged & ~c("is_noop") & (c("elapsed") >= MIN_ELAPSED_FOR_CPU) & (cores > 1) & (util < LOW_CPU_UTIL)
    r.add(WARNING, "cpu-overrequest", idle, "Most cores were idle",
          _say(fmt.percent_text(util), " of ", cores, " cores",
               F.when(c("task_count") > 1, F.format_string(" over %d tasks", "task_count")),
               F.format_string(", about %.1f cores of work; ", fmt.printed(util * cores, 1)), sizing.cpu_caveat(cgroup), "."),
          _say("Try --cpus-per-task=", F.greatest(F.floor(util * per_task + 0.999), F.lit(1)), ", unless cores feed a data loader."))


def _kernel_io_parallel_paging(r: _Rules) -> None:
    c = F.col
    r.add(WARNING, "system-cpu-heavy",
          ~c("open_ended") & ~c("is_noop") & (c("system_share") >= SYSTEM_CPU_HEAVY) & (c("total_cpu") >= SYSTEM_CPU_MIN_SECONDS),
          "CPU time went to the kernel", _say(fmt.percent_text("system_share"), " of CPU time was system time."),
          "System-call overhead: batch small reads or pack small files.")
    r.add(WARNING, "io-heavy",
          ~c("open_ended") & (c("io_bytes") >= IO_VOLUME_FLOOR) & (c("io_rate") >= IO_RATE_LOUD),
          "Storage may set the pace",
          _say("Read ", fmt.bytes_text(F.coalesce("read_bytes", F.lit(0))), ", wrote ", fmt.bytes_text(F.coalesce("write_bytes", F.lit(0))), ", ", fmt.bytes_text("io_rate"), "/s over ", fmt.duration_text("elapsed"), "."),
          "Check which storage tier the input is on.")
    parallel = ~c("open_ended") & (c("task_count") > 1)
    r.add(WARNING, "straggler", parallel & (c("straggler_spread") >= STRAGGLER_SPREAD), "One task fell behind",
          _say("The slowest task used ", fmt.percent_text("straggler_spread"), " less CPU than the mean of ", c("task_count"), " tasks.",
               F.when(F.length("slowest_node") > 0, _say(" Task ", F.coalesce("slowest_task", F.lit("?")), " on ", c("slowest_node"), "."))),
          "Compare the ranks: the one that reports an error is often the victim.")
    r.add(INFO, "task-memory-imbalance", parallel & (c("rss_task_imbalance") >= RSS_IMBALANCE), "Uneven memory across tasks",
          _say(F.format_string("One task held %.1f times the mean of %d tasks.", fmt.printed("rss_task_imbalance", 1), "task_count")))
    r.add(WARNING, "paging", ~c("open_ended") & (c("max_pages") >= PAGING_FLOOR), "The job was paging",
          _say(F.format_number("max_pages", 0), " major page faults."), "Raise the memory request or shrink the working set.")


def _exit(r: _Rules) -> None:
    c = F.col
    state, code, signal = c("base_state"), c("exit_code"), c("signal")

    def st(word: str) -> Column:
        return states.is_state("state", word)

    by = text.canceller_uid("state")
    other = F.coalesce(st("CANCELLED") & (F.length("uid") > 0) & (by != c("uid")), F.lit(False))
    r.add(INFO, "cancelled-by-other", other, F.when(by == "0", "Cancelled by root").otherwise("Cancelled by another user"),
          _say("Ended by uid ", by, ", owner is uid ", c("uid"), "."),
          F.when(by == "0", "Check for maintenance or a policy limit before resubmitting.").otherwise(_say("Ask the holder of uid ", by, ".")))
    r.add(INFO, "cancelled", st("CANCELLED") & ~other, "Cancelled, not failed",
          "Left out of failure rates: a deliberate stop and an abandoned run look the same.")
    r.add(WARNING, "node-failed", st("NODE_FAIL"), "The node failed", "The machine died; small CPU or memory totals are missing data.",
          "Resubmit; the node table tells whether one machine stands out.")
    r.add(WARNING, "boot-failed", st("BOOT_FAIL"), "The node did not boot", "Nothing of the job ran.",
          "Resubmit; the node table tells whether one machine stands out.")
    r.add(CRITICAL, "deadline", st("DEADLINE"), "Killed at its deadline", "The deadline passed; it is not the time limit.",
          "Move the deadline or submit earlier.")
    r.add(INFO, "preempted", st("PREEMPTED"), "Preempted, not failed", "The allocation was reclaimed for other work.",
          "Requeue, or use a priority class that keeps its allocation.")
    r.add(CRITICAL, "command-not-found", code == 127, "Command not found (exit 127)", "The shell did not find an executable.",
          "Check module loads and environment activation order.")
    killer = F.coalesce(F.nullif(signal, F.lit(0)), F.when(code == 137, 9))
    names = F.create_map(*[F.lit(v) for k, n in SIGNALS.items() for v in (k, n)])
    named = F.coalesce(F.try_element_at(names, killer), F.format_string("signal %d", killer))
    unexplained = killer.isNotNull() & ~F.coalesce(state.isin(KILL_EXPLAINED), F.lit(False))
    r.add(CRITICAL, F.when(killer == 9, "sigkill").otherwise("signal-kill"), unexplained, _say("Killed by ", named),
          _say("Signal ", killer, " with state ", F.coalesce(state, F.lit("unrecorded")), ": no scheduler limit explains it."),
          "Look for a wrapper, a timeout in the script or the node's own memory killer.")
    log = c("log")
    blank = F.coalesce(log["blank"], F.lit(True))
    above = code.isin(127, 137) | F.coalesce(signal != 0, F.lit(False))
    r.add(WARNING, "exit-nonzero-nolog", blank & (code != 0) & st("FAILED"),
          F.when(above, _say("Exit ", code, ", no log to confirm it")).when(code == 1, "Exit 1, no log to explain it").otherwise(_say("Exit ", code, ", no log to explain it")),
          F.when(above, "The status is known, the command and progress are not.").when(code == 1, "Exit 1 is any interpreter error; the log would tell which.").otherwise(_say("Exit ", code, " alone names no cause.")),
          "Record the error output at a known path.")
    some = ~blank
    gpus = c("gpu_count") > 0
    r.add(CRITICAL, "cuda-oom", some & gpus & log["device_memory"], "GPU out of memory",
          "A device allocation failed; host memory is not involved.", "Reduce the batch size, checkpoint activations or shard.")
    many = gpus & ((c("gpu_count") > 1) | (c("task_count") > 1) | (c("node_count") > 1))
    r.add(CRITICAL, "nccl", some & many & log["collective"], "Collective communication failed",
          "Collective-library errors in the log, usually a symptom of one rank that stopped.", "Compare all ranks.")
    r.add(CRITICAL, "import-error", some & log["import_error"], "A Python import failed",
          "Import failure in the log.", "Pin the environment and record it with the run.")
    trace = log["traceback"]
    r.add(INFO, "traceback", some & trace.isNotNull(), "Last traceback in the log", trace)
    excerpt = log["excerpt"]
    r.add(INFO, "log-tail", some & trace.isNull() & c("is_failed") & (F.length(excerpt) > 0), "End of the log", excerpt)


def _gpu(r: _Rules) -> None:
    c = F.col
    held = (c("gpu_count") > 0) & ~c("open_ended") & ~c("is_noop")
    measured = c("gpu_utilization")
    shape = F.format_string("%d GPU(s) for ", "gpu_count")
    r.add(CRITICAL, "gpu-idle", held & (measured < GPU_IDLE), "GPUs barely used",
          _say(shape, fmt.duration_text("elapsed"), " at ", fmt.percent_text(measured), " measured utilization."),
          "Check the input pipeline before asking for more devices.")
    r.add(WARNING, "gpu-underused", held & (measured >= GPU_IDLE) & (measured < GPU_UNDERUSED), "GPUs partly busy",
          _say(shape, fmt.duration_text("elapsed"), " at ", fmt.percent_text(measured), " measured utilization."),
          "Raise the work per step.")
    explained = F.coalesce(c("base_state").isin(states.CPU_EXPLAINED_STATES), F.lit(False))
    r.add(WARNING, "gpu-suspect-idle", held & measured.isNull() & ~explained & (c("cpu_utilization") < GPU_SUSPECT_CPU),
          "GPUs held while the CPU barely moved",
          _say(shape, fmt.duration_text("elapsed"), " at ", fmt.percent_text("cpu_utilization"), " CPU utilization; launches need the CPU."),
          "Confirm on a live run: this is a proxy.")


def findings(
    metrics: DataFrame,
    logs: DataFrame | None = None,
    notes: DataFrame | None = None,
    site: DataFrame | None = None,
    keep: tuple[str, ...] = ("job_id",),
    codes: Collection[str] | None = None,
) -> DataFrame:
    """One row per finding: job, position in rule order, severity, code and texts.

    With ``codes``, only findings of these codes: the texts of the other rules are not formed, and positions count
    what is left.

    ``logs(alloc_id, log)`` with ``log`` as in ``tables.log_files`` (or ``log_text``, one string), ``notes(alloc_id, node_note)`` and
    ``site(cluster, from_cgroup, sampling_seconds)`` are optional inputs; metrics that
    went through ``rollup.with_places`` also name the slowest task.
    """
    df = metrics
    none = F.lit(None).cast("string")
    if logs is None:
        df = df.withColumn("log", logtext.digest(none))
    else:
        told = "log" if "log" in logs.columns else logtext.digest("log_text").alias("log")
        df = df.join(logs.select("alloc_id", told), "alloc_id", "left")
    if notes is None:
        df = df.withColumn("node_note", none)
    else:
        df = df.join(notes.select("alloc_id", "node_note"), "alloc_id", "left")
    if site is None:
        df = df.withColumns({"from_cgroup": F.lit(None).cast("boolean"), "sampling_seconds": F.lit(None).cast("int")})
    else:
        df = df.join(site.select("cluster", "from_cgroup", "sampling_seconds"), "cluster", "left")
    for place in ("slowest_node", "slowest_task"):
        if place not in df.columns:
            df = df.withColumn(place, none)
    cgroup, interval = F.col("from_cgroup"), F.col("sampling_seconds")
    r = _Rules(codes)
    live = F.col("live")
    r.add(INFO, "open-record", F.col("open_ended"), "The record is not closed",
          _say("State ", F.coalesce("state", F.lit("?")), " without an end; elapsed ", fmt.duration_text("elapsed"), " runs to now."),
          F.when(live, "The job is still in the queue system. Left out of totals.").when(~live, "The job is long gone. Left out of totals.").otherwise("Check the queue. Left out of totals."))
    _walltime(r)
    _memory(r, cgroup, interval)
    _cpu(r, cgroup)
    _kernel_io_parallel_paging(r)
    _exit(r)
    _gpu(r)
    r.add(INFO, "node-history", F.length("node_note") > 0, "This node has a history", F.col("node_note"), "Consider excluding it if this repeats.")
    fired = F.filter(F.array(*r.items), lambda x: x.isNotNull())
    found = df.select("alloc_id", *keep, F.posexplode(fired).alias("position", "_f")).select(
        "alloc_id", *keep, "position", severity_rank("_f.severity").alias("severity_rank"), "_f.*"
    )
    # The code of one rule depends on the job.
    return found if codes is None else found.filter(F.col("code").isin(list(codes)))


def worst_per_job(found: DataFrame, by: tuple[str, ...] = ("alloc_id", "job_id")) -> DataFrame:
    """The first of the most severe findings per job, and how many there are."""
    order = F.struct("severity_rank", "position")
    return found.groupBy(*by).agg(
        F.min_by(F.struct("severity", "code", "title"), order).alias("_w"), F.count("*").alias("findings")
    ).select(*by, "_w.*", "findings")


def by_code(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(
        F.count("*").alias("findings"), F.count_distinct("alloc_id").alias("jobs")
    )


def sorted_findings(found: DataFrame) -> DataFrame:
    return found.orderBy("alloc_id", "severity_rank", "position")


def strict_failure(found: DataFrame) -> DataFrame:
    """One boolean: is there any critical finding?"""
    return found.agg(
        F.coalesce(F.bool_or(F.col("severity") == CRITICAL), F.lit(False)).alias("any_critical")
    )
