"""Step measurements rolled up per allocation: the ``job_metrics`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states, text
from ..functions.memo import memo
from .common import dealt

MIN_CPU_FOR_A_SHARE = 1.0


def _nz(c) -> Column:
    c = text.as_col(c)
    return F.when(c != 0, c)


def step_rollup(steps: DataFrame) -> DataFrame:
    """One row per allocation.  Steps are shuffled as they are: an allocation has few of them in any
    one task, so aggregating before the shuffle would send as many rows, each of sixty buffers.  An
    allocation with very many steps passes through one task row by row.  All aggregates are numeric,
    which keeps the aggregation hash-based; names and places are in ``with_places``."""
    work = ~F.coalesce(F.col("step_id").endswith(".extern"), F.lit(False))
    going = states.step_in_progress("state")
    read = F.coalesce(text.tres_bytes("tres_in_tot", "fs/disk"), F.col("max_disk_read"))
    write = F.coalesce(text.tres_bytes("tres_out_tot", "fs/disk"), F.col("max_disk_write"))
    gpu_util = (
        F.coalesce(
            text.tres_double("tres_in_ave", "gres/gpuutil"),
            text.tres_double("tres_in_max", "gres/gpuutil"),
        )
        / 100.0
    )
    gpu_mem = F.coalesce(
        _nz(text.tres_bytes("tres_in_max", "gres/gpumem")),
        _nz(text.tres_bytes("tres_in_ave", "gres/gpumem")),
    )
    s = steps.withColumns(
        {
            "_work": work, "_going": going, "_read": read, "_write": write,
            "_util": gpu_util, "_gmem": gpu_mem, "_hz": text.clock_hz("ave_cpu_freq"),
        }
    )
    return dealt(s, "alloc_id").groupBy("alloc_id").agg(*_step_aggregates())


@memo
def _step_aggregates() -> list[Column]:
    pos = F.col("pos")
    w, live = F.col("_work"), F.col("_work") & F.col("_going")
    many = w & (F.col("ntasks") > 1)

    def first(value, when: Column) -> Column:
        return F.min_by(value, F.when(when, pos))

    aggs = [F.count("*").alias("step_count"), F.max("ntasks").alias("s_tasks")]
    for cpu in ("total_cpu", "user_cpu", "system_cpu"):
        aggs.append(F.sum(F.when(w, F.col(cpu))).alias(f"s_{cpu}"))
        aggs.append(F.sum(F.when(live, _nz(cpu))).alias(f"l_{cpu}"))
    aggs.append(F.max(F.when(w, F.col("cpu_time"))).alias("s_cpu_time"))
    aggs.append(first("_hz", w & F.col("_hz").isNotNull()).alias("cpu_freq_hz"))
    spread = F.greatest(F.lit(0.0), (F.col("ave_cpu") - F.col("min_cpu")) / F.col("ave_cpu"))
    compared = many & (F.col("ave_cpu") > 0) & F.col("min_cpu").isNotNull()
    aggs.append(first(F.when(compared, spread), compared).alias("straggler_spread"))
    ratio = F.when(w, F.try_divide(_nz("max_rss"), _nz("ave_rss")))
    for p, scope in (("s", F.lit(True)), ("l", F.col("_going"))):
        ws = w & scope
        aggs += [
            F.max(F.when(scope, F.col("max_rss"))).alias(f"{p}_peak"),
            F.max(F.when(ws, F.col("max_rss"))).alias(f"{p}_peak_work"),
            F.max(F.when(scope & ~w, F.col("max_rss"))).alias(f"{p}_peak_extern"),
            F.max(F.when(ws, F.col("ave_rss"))).alias(f"{p}_ave_rss"),
            F.max(F.when(ws, ratio)).alias(f"{p}_imbalance"),
            F.count(F.when(ws, _nz("max_rss"))).alias(f"{p}_spread_n"),
            F.min(F.when(ws, _nz("max_rss"))).alias(f"{p}_spread_lo"),
            F.max(F.when(ws, _nz("max_rss"))).alias(f"{p}_spread_hi"),
            F.max(F.when(scope, F.col("max_vmsize"))).alias(f"{p}_vmsize"),
            F.max(F.when(scope, F.col("max_pages"))).alias(f"{p}_pages"),
        ]
    for io in ("_read", "_write"):
        aggs.append(
            F.coalesce(F.sum(F.when(w, F.col(io))), F.max(io)).alias(f"{io[1:]}_bytes")
        )
    aggs.append(F.max(F.when(w, F.col("_util"))).alias("gpu_utilization"))
    aggs.append(F.max("_gmem").alias("gpu_mem_peak_bytes"))
    aggs.append(F.max(_nz("consumed_energy")).alias("energy_joules"))
    return aggs


@memo
def gpu_count() -> Column:
    found = [
        f(c, k)
        for c in ("alloc_tres", "req_tres")
        for f, k in (
            (lambda c, k: _nz(text.tres_int(c, k)), "gres/gpu"),
            (text.tres_typed_sum, "gres/gpu"),
        )
    ]
    found += [text.gres_sum(c, "gpu") for c in ("alloc_gres", "req_gres")]
    return F.coalesce(*found, F.lit(0).cast("long"))


def shape_columns(jobs: DataFrame) -> DataFrame:
    """Columns that need the allocation row only."""
    return jobs.withColumns(
        {
            "base_state": states.base_state("state"),
            "is_failed": states.failed("state"),
            "is_completed": states.completed("state"),
            "is_cancelled": states.cancelled("state"),
            "job_in_progress": states.in_progress("state", "live"),
            "folded_name": text.fold_name("name"),
            "stamp": F.coalesce("start", "submit"),
            "id_primary": text.id_primary("job_id"),
            "id_task": text.id_task("job_id"),
            "gpu_count": gpu_count(),
            "cpu_count": F.coalesce(
                _nz("alloc_cpus"), _nz("ncpus"), _nz(text.tres_int("alloc_tres", "cpu")),
                F.col("req_cpus"), F.lit(0).cast("long"),
            ),
            "node_count": F.coalesce(
                _nz("nnodes"), _nz("alloc_nodes"), _nz(text.tres_int("alloc_tres", "node")),
                F.lit(1).cast("long"),
            ),
            "scheduled_by": text.scheduled_by("flags"),
        }
    )


def job_metrics(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """All per-job figures.  NULL means not measured, 0 means measured as zero."""
    df = shape_columns(jobs).join(step_rollup(steps), "alloc_id", "left")
    going = F.col("job_in_progress")

    def pick(name: str) -> Column:
        return F.when(going, F.col(f"l_{name}")).otherwise(F.col(f"s_{name}"))

    df = df.withColumns(
        {
            "step_count": F.coalesce("step_count", F.lit(0).cast("long")),
            "task_count": F.coalesce(_nz("ntasks"), _nz("s_tasks"), F.lit(0).cast("long")),
            **{
                c: F.when(going, F.col(f"l_{c}")).otherwise(
                    F.coalesce(F.col(f"s_{c}"), F.col(f"{c}_alloc"))
                )
                for c in ("total_cpu", "user_cpu", "system_cpu")
            },
            "cpu_time": F.greatest(
                "cpu_time_alloc", F.col("elapsed") * _nz("cpu_count"), "s_cpu_time"
            ),
            "mem_limit_total": F.coalesce(
                text.tres_bytes("alloc_tres", "mem", zero_is_missing=True),
                _nz("req_mem_bytes")
                * F.when(F.col("req_mem_scope") == "node", F.col("node_count"))
                .when(F.col("req_mem_scope") == "cpu", F.greatest("cpu_count", F.lit(1)))
                .otherwise(F.lit(1)),
                text.tres_bytes("req_tres", "mem", zero_is_missing=True),
            ),
        }
    )
    per_node = F.floor(F.col("mem_limit_total") / F.col("node_count"))
    df = df.withColumn(
        "mem_limit",
        F.when((F.col("req_mem_scope") == "node") & _nz("req_mem_bytes").isNotNull(), F.col("req_mem_bytes"))
        .otherwise(_nz(per_node)),
    )
    # The bookkeeping step is ignored exactly when the limit proves it impossible
    # and the work steps stay inside.
    peak, inside, extern = pick("peak"), pick("peak_work"), pick("peak_extern")
    phantom = F.coalesce(
        (peak > F.col("mem_limit")) & (inside <= F.col("mem_limit")) & (extern == peak),
        F.lit(False),
    )
    df = df.withColumn("max_rss", F.when(phantom, inside).otherwise(peak))

    df = df.withColumns(
        {
            "is_noop": states.noop("open_ended", "elapsed", "total_cpu"),
            "cpus_per_task": F.try_divide(
                _nz("cpu_count"), F.coalesce(_nz("task_count"), F.col("node_count"))
            ),
            "system_share": F.when(
                (F.col("total_cpu") >= MIN_CPU_FOR_A_SHARE)
                & (F.col("system_cpu") <= F.col("total_cpu")),
                F.try_divide("system_cpu", "total_cpu"),
            ),
            "cpu_utilization": F.try_divide(F.col("total_cpu"), _nz("cpu_time")),
            "ave_rss": pick("ave_rss"),
            "rss_task_imbalance": pick("imbalance"),
            "rss_step_spread": F.when(
                pick("spread_n") >= 2, F.try_divide(pick("spread_hi"), pick("spread_lo"))
            ),
            "max_vmsize": pick("vmsize"),
            "max_pages": pick("pages"),
            "mem_utilization": F.try_divide(F.col("max_rss"), _nz("mem_limit")),
            "io_bytes": F.when(
                F.coalesce("read_bytes", "write_bytes").isNotNull(),
                F.coalesce("read_bytes", F.lit(0)) + F.coalesce("write_bytes", F.lit(0)),
            ),
            "walltime_used": F.try_divide(F.col("elapsed"), _nz("timelimit")),
            "gpu_hours": F.col("elapsed") * _nz("gpu_count") / 3600.0,
            "core_hours": F.col("elapsed") * _nz("cpu_count") / 3600.0,
        }
    )
    over = F.coalesce(
        (F.col("mem_limit") > 0) & (F.col("max_rss") > F.col("mem_limit")), F.lit(False)
    )
    refused = going & F.col("foreign_owner") & ~F.col("live_metrics")
    df = df.withColumns(
        {
            "cores_busy": F.col("cpu_utilization") * _nz("cpu_count"),
            "vmsize_to_rss": F.try_divide(_nz("max_vmsize"), _nz("max_rss")),
            "io_rate": F.try_divide(F.col("io_bytes"), _nz("elapsed")),
            "peak_trustworthy": ~going & ~over,
            "peak_source": F.when(
                F.col("max_rss").isNotNull(),
                F.when(~going, "accounting (final)")
                .when(F.col("live_metrics"), "live reading")
                .when(refused, "accounting (unflushed, live reading is owner-only)")
                .otherwise("accounting (unflushed)"),
            ),
            "peak_missing_reason": F.when(
                F.col("max_rss").isNull(),
                F.when(refused, "foreign_owner")
                .when(going, "in_progress_unflushed")
                .otherwise("not_gathered"),
            ),
        }
    )
    scratch = [c for c in df.columns if c[:2] in ("s_", "l_")]
    return df.drop(*scratch)


def with_places(metrics: DataFrame, steps: DataFrame) -> DataFrame:
    """Add the text that says where: node and task of the peak, of the slowest task, and
    the raw clock.  Meant for the jobs of a report, where it costs one more pass over
    their steps.  Places are those of the first step that has the value."""
    work = ~F.coalesce(F.col("step_id").endswith(".extern"), F.lit(False))
    rows = steps.join(metrics.select("alloc_id", F.col("max_rss").alias("_peak")), "alloc_id")
    at_peak = F.col("max_rss") == F.col("_peak")
    pos = F.col("pos")

    def first(value, when: Column) -> Column:
        return F.min_by(value, F.when(when, pos))

    slow = work & (F.col("ntasks") > 1) & F.col("min_cpu").isNotNull()
    places = rows.groupBy("alloc_id").agg(
        first("max_rss_node", at_peak & (F.length("max_rss_node") > 0)).alias("max_rss_node"),
        first("max_rss_task", at_peak & (F.length("max_rss_task") > 0)).alias("max_rss_task"),
        first("min_cpu_node", slow).alias("slowest_node"),
        first("min_cpu_task", slow).alias("slowest_task"),
        first("ave_cpu_freq", work & (F.length("ave_cpu_freq") > 0)).alias("cpu_freq"),
    )
    return metrics.join(places, "alloc_id", "left")
