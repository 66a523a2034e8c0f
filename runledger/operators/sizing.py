"""What the next run of a workload should request, from how its runs went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, states
from ..functions.text import GIB
from .workloads import KEY, newest, with_key

MIN_RUNS = 3
WALLTIME_MARGIN = 1.25
MEMORY_MARGIN = 1.30
CPU_MARGIN = 1.20
MIN_CHANGE = 0.20
VETO_COUNT = 3
VETO_SHARE = 0.20
SPARSE_SAMPLES = 5

FLAGS = ["--time", "--mem", "--cpus-per-task"]


def latest(value) -> Column:
    """Value of the newest run that has one (zero counts as none)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by(value, F.when(value != 0, newest()))


def round_walltime(seconds: Column) -> Column:
    step = F.when(seconds < 3600, 300).otherwise(900)
    return F.ceil(seconds / step) * step


def _by_change(target: Column, current: Column) -> Column:
    return (
        F.when(target > current * (1 + MIN_CHANGE), "raise")
        .when(target < current * (1 - MIN_CHANGE), "lower")
        .otherwise("keep")
    )


def _round_gib(nbytes: Column) -> Column:
    return F.ceil(nbytes / float(GIB))


# -- measurement caveats -----------------------------------------------------------------

def sample_count(elapsed, interval) -> Column:
    """How often the sampler can have looked at a job; NULL when unknown."""
    e, i = F.col(elapsed) if isinstance(elapsed, str) else elapsed, interval
    return F.when((e >= 0) & (i > 0), F.floor(e / i) + 1)


def sampling_note(elapsed, interval) -> Column:
    n = sample_count(elapsed, interval)
    e = F.col(elapsed) if isinstance(elapsed, str) else elapsed
    return F.when(
        n <= SPARSE_SAMPLES, F.concat(F.lit("no more than "), formats.counted(n, "sample"), F.format_string(" in %ds", e.cast("long")))
    ).otherwise("")


def rss_caveat(from_cgroup: Column) -> Column:
    return (
        F.when(from_cgroup, "the peak is the control group's own high-water mark")
        .when(~from_cgroup, "the peak counts shared pages more than once, an upper bound")
        .otherwise("the peak may read too high on this cluster, an upper bound")
    )


def cpu_caveat(from_cgroup: Column) -> Column:
    return (
        F.when(from_cgroup, "CPU time covers detached workers")
        .when(~from_cgroup, "CPU time misses detached workers, a lower bound")
        .otherwise("CPU time may miss detached workers, a lower bound")
    )


def gpu_utilization_note(tracked: Column) -> Column:
    return (
        F.when(tracked, "not recorded for this job")
        .when(~tracked, "not gathered on this cluster")
        .otherwise("not recorded")
    )


# -- the three directives ------------------------------------------------------------------

def sizing_facts(metrics: DataFrame) -> DataFrame:
    """Everything the three directives need, in one aggregation per workload.

    The percentile is exact over whole seconds; its buffer holds distinct elapsed
    values, bounded by the longest time limit rather than by the number of runs.
    """
    noop, done = F.col("is_noop"), F.col("is_completed")
    timeout = states.is_state("state", "TIMEOUT")
    oom = states.is_state("state", "OUT_OF_MEMORY")
    fit = done & (F.col("elapsed") > 0) & ~noop
    measured = F.coalesce((F.col("max_rss") > 0) & (F.col("mem_limit") > 0), F.lit(False)) & ~noop
    over = measured & (F.col("max_rss") > F.col("mem_limit"))
    inside = measured & ~over
    cpu = F.col("cpu_utilization").isNotNull() & F.col("cpus_per_task").isNotNull() & ~noop
    busy = F.col("cpu_utilization") * F.col("cpus_per_task")
    rows = with_key(metrics.filter(states.usable()))
    fit_s = F.when(fit, F.col("elapsed"))
    rows = rows.withColumns({"_fit_s": fit_s, "_busy": F.when(cpu, busy)})
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("runs"),
        latest("timelimit").alias("t_current"),
        F.count("_fit_s").alias("t_fit"),
        F.max("_fit_s").alias("t_longest"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _fit_s)").alias("t_p95"),
        F.count_if(timeout).alias("t_timeouts"),
        F.count_if(timeout & noop).alias("t_hung"),
        F.max(F.when(timeout & ~noop, F.col("timelimit"))).alias("t_floor"),
        latest("mem_limit").alias("m_current"),
        F.count_if(oom).alias("m_oom"),
        F.max(F.when(oom, F.col("mem_limit"))).alias("m_floor"),
        F.count_if(measured).alias("m_measured"),
        F.count_if(over).alias("m_over"),
        F.count_if(inside).alias("m_fit"),
        F.max(F.when(inside, F.col("max_rss"))).alias("m_peak"),
        F.min(F.when(inside, F.col("elapsed"))).alias("m_shortest"),
        F.max(F.when(inside, F.col("node_count"))).alias("m_nodes"),
        latest("cpus_per_task").alias("c_current"),
        F.count("_busy").alias("c_fit"),
        F.max("_busy").alias("c_peak"),
        F.max_by("cpus_per_task", F.struct("_busy", "id_primary", "id_task")).alias("c_of"),
        F.max(F.when(cpu, F.col("gpu_count"))).alias("c_gpus"),
        F.max(F.when(cpu, F.col("task_count"))).alias("c_tasks"),
        F.min_by("cluster", F.when(cpu, F.col("job_id"))).alias("cluster"),
    )


def _advice(facts: DataFrame, flag: str, columns: dict[str, Column]) -> DataFrame:
    """Add the directive as one struct column, so that all three share a single pass."""
    df = facts
    for name in [k for k in columns if k.startswith("_")]:
        df = df.withColumn(name, columns[name])
    df = df.withColumn("verdict", columns["verdict"])
    known = F.col("verdict") != "unknown"
    row = F.struct(
        F.lit(flag).alias("flag"),
        F.col("verdict").alias("verdict"),
        columns["requested"].cast("double").alias("requested"),
        F.when(known, columns["target"]).cast("double").alias("target"),
        columns["observed"].cast("double").alias("observed"),
        F.when(
            F.col("verdict").isin("raise", "lower", "capped"), columns["suggestion"]
        ).alias("suggestion"),
        columns["basis"].alias("basis"),
        columns["caution"].alias("caution"),
    )
    return df.select(*facts.columns, row.alias(f"advice_{flag}"))


def walltime_advice(facts: DataFrame) -> DataFrame:
    hung, timeouts = F.col("t_hung"), F.col("t_timeouts")
    computing = timeouts - hung
    floor = F.coalesce(F.nullif("t_floor", F.lit(0.0)), F.lit(0.0))
    veto = (hung >= VETO_COUNT) & (hung >= 0.5 * timeouts) & (hung >= VETO_SHARE * F.col("runs"))
    thin = F.col("t_fit") < MIN_RUNS
    target = F.greatest(
        round_walltime(F.col("t_longest") * WALLTIME_MARGIN),
        F.when(floor > 0, round_walltime(floor * WALLTIME_MARGIN)),
    )
    current = F.col("t_current")
    verdict = (
        F.when(veto | thin, "unknown")
        .when(current.isNull(), "raise")
        .otherwise(_by_change(F.col("_target"), current))
    )
    basis = (
        F.when(veto, F.format_string("%d of %d timeouts used no CPU: they were blocked, not slow.", "t_hung", "t_timeouts"))
        .when(thin, F.format_string("%d completed runs; %d are needed.", F.col("t_fit"), F.lit(MIN_RUNS)))
        .otherwise(F.concat(F.lit("Longest of "), F.col("t_fit").cast("string"), F.lit(" completed runs: "), formats.duration_text("t_longest"), F.lit(", 95th percentile "), formats.duration_text("t_p95"), F.lit(".")))
    )
    caution = (
        F.when(veto, "Find the blocking call before touching the time limit.")
        .when(thin, "")
        .otherwise(
            F.concat_ws(
                " ",
                F.when(computing > 0, F.concat(formats.counted(computing, "run"), F.lit(" timed out while computing: this is a floor."))),
                F.when(hung > 0, F.concat(formats.counted(hung, "timeout"), F.lit(" without CPU left out."))),
            )
        )
    )
    return _advice(
        facts, "--time",
        {
            "_target": target, "verdict": verdict, "requested": current, "target": F.col("_target"),
            "observed": F.col("t_longest"), "suggestion": formats.walltime_flag("_target"),
            "basis": basis, "caution": caution,
        },
    )


def memory_advice(facts: DataFrame) -> DataFrame:
    """Needs ``from_cgroup`` and ``sampling_seconds`` on the facts (NULL if unknown)."""
    oom, fit = F.col("m_oom") > 0, F.col("m_fit")
    floor, peak = F.nullif("m_floor", F.lit(0).cast("long")), F.col("m_peak")
    by_floor = F.greatest(
        _round_gib(floor * MEMORY_MARGIN),
        F.when((fit >= MIN_RUNS) & floor.isNotNull(), _round_gib(peak * MEMORY_MARGIN)),
    )
    untrusted = (
        (F.col("m_over") > 0)
        & (F.col("m_over") >= VETO_SHARE * F.greatest("m_measured", F.lit(1)))
        & (fit < MIN_RUNS)
    )
    target = F.when(oom, by_floor).when(~untrusted & (fit >= MIN_RUNS), _round_gib(peak * MEMORY_MARGIN))
    current = F.col("m_current")
    verdict = (
        F.when(F.col("_target").isNull(), "unknown")
        .when(current.isNull(), "raise")
        .otherwise(_by_change(F.col("_target") * GIB, current))
    )
    site = F.col("from_cgroup")
    basis = (
        F.when(oom, F.concat(F.lit("A limit that was exceeded is a floor"), F.when(floor.isNotNull(), F.concat(F.lit(": "), formats.bytes_text(floor))).otherwise(""), F.lit(".")))
        .when(untrusted, F.concat(F.format_string("%d of %d peaks read above an enforced limit: ", "m_over", "m_measured"), rss_caveat(site), F.lit(".")))
        .when(fit < MIN_RUNS, F.format_string("%d runs with a usable peak; %d are needed.", fit, F.lit(MIN_RUNS)))
        .otherwise(F.concat(F.lit("Highest peak of "), fit.cast("string"), F.lit(" runs: "), formats.bytes_text(peak), F.lit(".")))
    )
    note = sampling_note("m_shortest", F.col("sampling_seconds"))
    measured_caution = F.concat_ws(
        " ",
        F.when(F.length(note) > 0, F.concat(F.lit("Thinly sampled ("), note, F.lit("): the peak may be low."))).otherwise(F.concat(rss_caveat(site), F.lit("."))),
        F.when(F.col("m_over") > 0, F.concat(formats.counted("m_over", "run"), F.lit(" above the limit left out."))),
        F.when(F.col("m_nodes") > 1, "Per node."),
    )
    caution = (
        F.when(oom, "If a run also completed at this size, memory is not the cause.")
        .when(untrusted, "Measure a live run to size this.")
        .when(fit < MIN_RUNS, "")
        .otherwise(measured_caution)
    )
    return _advice(
        facts, "--mem",
        {
            "_target": target, "verdict": verdict, "requested": current,
            "target": F.col("_target"),
            "observed": F.when(oom, floor).otherwise(peak),
            "suggestion": F.format_string("%dG", "_target"), "basis": basis, "caution": caution,
        },
    )


def cpu_advice(facts: DataFrame) -> DataFrame:
    """Per task, clipped to ``max_cores`` of the partition (NULL if unknown)."""
    thin = F.col("c_fit") < MIN_RUNS
    wanted = F.greatest(F.ceil(F.col("c_peak") * CPU_MARGIN), F.lit(1).cast("long"))
    ceiling, current = F.nullif("max_cores", F.lit(0)), F.col("c_current")
    clipped = F.coalesce(F.col("_wanted") > ceiling, F.lit(False))
    saturated = clipped & F.coalesce(current >= ceiling, F.lit(False))
    verdict = (
        F.when(thin | current.isNull(), "unknown")
        .when(F.col("_saturated"), "capped")
        .otherwise(_by_change(F.col("_target"), current))
    )
    basis = F.when(thin, F.format_string("%d runs with CPU accounting; %d are needed.", F.col("c_fit"), F.lit(MIN_RUNS))).otherwise(
        F.concat(F.format_string("The busiest run used %.2f of ", formats.printed("c_peak", 2)), formats.compact_number("c_of"), F.lit(" cores per task."))
    )
    lower = F.col("verdict") == "lower"
    caution = F.when(thin, "").otherwise(
        F.concat_ws(
            " ",
            F.when(F.col("_saturated"), F.format_string("Already at the partition's %d cores per node.", ceiling)),
            F.when(lower, F.concat(cpu_caveat(F.col("from_cgroup")), F.lit("."))),
            F.when(lower & (F.col("c_gpus") > 0), "GPU workload: idle-looking cores may feed the data loader."),
            F.when(F.col("c_tasks") > 1, F.format_string("Per task; a run has %d tasks.", "c_tasks")),
        )
    )
    return _advice(
        facts, "--cpus-per-task",
        {
            "_wanted": wanted, "_target": F.when(clipped, ceiling).otherwise(F.col("_wanted")),
            "_saturated": saturated, "verdict": verdict, "requested": current,
            "target": F.col("_target"), "observed": F.when(~thin, F.col("c_peak")),
            "suggestion": F.format_string("%d", "_target"), "basis": basis, "caution": caution,
        },
    )


def with_site(
    facts: DataFrame, site: DataFrame | None = None, ceilings: DataFrame | None = None
) -> DataFrame:
    """Attach cluster settings and partition ceilings (absent tables give NULLs).

    Both dimensions are a few rows per cluster and partition; the plain left join lets
    adaptive execution broadcast them by their measured size.
    """
    if site is None:
        facts = facts.withColumns(
            {"from_cgroup": F.lit(None).cast("boolean"), "sampling_seconds": F.lit(None).cast("int")}
        )
    else:
        facts = facts.join(site.select("cluster", "from_cgroup", "sampling_seconds"), "cluster", "left")
    if ceilings is None:
        return facts.withColumn("max_cores", F.lit(None).cast("long"))
    known = ceilings.select(
        "cluster", F.col("partition").alias("workload_partition"), "max_cores"
    )
    return facts.join(known, ["cluster", "workload_partition"], "left")


def advice(
    metrics: DataFrame, site: DataFrame | None = None, ceilings: DataFrame | None = None
) -> DataFrame:
    """All three directives for every workload, from one aggregation."""
    facts = with_site(sizing_facts(metrics), site, ceilings)
    rows = cpu_advice(memory_advice(walltime_advice(facts)))
    each = F.explode(F.array(*[F.col(f"`advice_{f}`") for f in FLAGS])).alias("_a")
    return rows.select(*KEY, "runs", each).select(*KEY, "runs", "_a.*")


def actionable() -> Column:
    return F.col("verdict").isin("raise", "lower") & F.col("suggestion").isNotNull()


def directive_lines(df: DataFrame) -> DataFrame:
    """Script lines for the directives worth changing."""
    return df.filter(actionable()).select(
        *KEY, F.format_string("#SBATCH %s=%s", "flag", "suggestion").alias("line")
    )


def sizing_routing(df: DataFrame) -> DataFrame:
    """Workloads and runs by what can be said: advice, already right, too few runs."""
    per = df.groupBy(*KEY).agg(
        F.max("runs").alias("runs"),
        F.bool_or(actionable()).alias("_act"),
        F.bool_and(F.col("verdict") == "unknown").alias("_none"),
    )
    status = F.when(F.col("_act"), "has_advice").when(F.col("_none"), "too_few_runs").otherwise("already_right")
    return per.groupBy(status.alias("status")).agg(
        F.count("*").alias("workloads"), F.sum("runs").alias("runs")
    )
