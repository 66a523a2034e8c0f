"""Report tables in their nested, written form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states, text
from ..operators import patterns, reliability, rollup, sizing, workloads
from ..operators.common import null_safe_join
from ..operators.findings import severity_rank

# Report sections: output name -> column of job_metrics.
SECTIONS = {
    "identity": {
        "job_id": "job_id", "job_id_raw": "job_id_raw", "name": "name", "user": "user", "uid": "uid",
        "group": "group", "account": "account", "cluster": "cluster", "partition": "partition",
        "qos": "qos", "assoc_id": "assoc_id", "wckey": "wckey", "work_dir": "work_dir",
        "reservation": "reservation", "comment": "comment", "admin_comment": "admin_comment",
        "layout": "layout", "stdout_pattern": "std_out", "stderr_pattern": "std_err",
        "submit_line": "submit_line",
    },
    "outcome": {
        "state": "base_state", "state_raw": "state", "exit_code": "exit_code", "signal": "signal",
        "derived_exit_code": "derived_exit_code", "derived_signal": "derived_signal",
        "reason": "reason", "failed": "is_failed", "completed": "is_completed",
        "cancelled": "is_cancelled", "open_ended_record": "open_ended", "live": "live",
    },
    "timing": {
        "submit": "submit", "eligible": "eligible", "start": "start", "end": "end",
        "elapsed_seconds": "elapsed", "timelimit_seconds": "timelimit", "walltime_used": "walltime_used",
        "queue_wait_seconds": "queue_wait", "suspended_seconds": "suspended",
        "scheduled_by": "scheduled_by", "flags": "flags", "priority": "priority", "earlier": "earlier",
    },
    "shape": {
        "nodes": "node_count", "node_list": "node_list", "cpus": "cpu_count",
        "cpus_per_task": "cpus_per_task", "tasks": "task_count", "gpus": "gpu_count",
        "req_cpus": "req_cpus", "req_nodes": "req_nodes", "alloc_tres": "alloc_tres",
        "req_tres": "req_tres", "alloc_gres": "alloc_gres", "req_gres": "req_gres",
        "constraints": "constraints", "req_mem_scope": "req_mem_scope",
        "req_cpu_freq_min": "req_cpu_freq_min", "req_cpu_freq_max": "req_cpu_freq_max",
        "req_cpu_freq_governor": "req_cpu_freq_gov",
    },
    "cpu": {
        "total_seconds": "total_cpu", "user_seconds": "user_cpu", "system_seconds": "system_cpu",
        "system_fraction": "system_share", "allocated_core_seconds": "cpu_time",
        "utilization": "cpu_utilization", "frequency": "cpu_freq", "frequency_hz": "cpu_freq_hz",
        "straggler_spread": "straggler_spread", "slowest_task_node": "slowest_node",
        "slowest_task_id": "slowest_task", "core_hours": "core_hours",
    },
    "memory": {
        "limit_bytes": "mem_limit", "limit_total_bytes": "mem_limit_total", "req_mem_raw": "req_mem_raw",
        "peak_bytes": "max_rss", "peak_node": "max_rss_node", "peak_task": "max_rss_task",
        "average_bytes": "ave_rss", "task_imbalance": "rss_task_imbalance",
        "step_spread": "rss_step_spread", "utilization": "mem_utilization",
        "virtual_bytes": "max_vmsize", "virtual_to_resident": "vmsize_to_rss",
        "page_faults": "max_pages", "peak_trustworthy": "peak_trustworthy",
        "peak_source": "peak_source", "peak_unavailable_reason": "peak_missing_reason",
        "job_in_progress": "job_in_progress",
    },
    "filesystem": {
        "read_bytes": "read_bytes", "write_bytes": "write_bytes", "total_bytes": "io_bytes",
        "rate_bytes_per_second": "io_rate",
    },
    "gpu": {
        "count": "gpu_count", "gpu_hours": "gpu_hours", "utilization": "gpu_utilization",
        "memory_peak_bytes": "gpu_mem_peak_bytes",
    },
}

STEP_FIELDS = {
    "step_id": "step_id", "state": "state", "exit_code": "exit_code", "signal": "signal",
    "elapsed_seconds": "elapsed", "total_cpu_seconds": "total_cpu", "user_cpu_seconds": "user_cpu",
    "system_cpu_seconds": "system_cpu", "ave_cpu_seconds": "ave_cpu", "min_cpu_seconds": "min_cpu",
    "min_cpu_node": "min_cpu_node", "min_cpu_task": "min_cpu_task", "cpu_frequency": "ave_cpu_freq",
    "max_rss_bytes": "max_rss", "max_rss_node": "max_rss_node", "max_rss_task": "max_rss_task",
    "ave_rss_bytes": "ave_rss", "max_vmsize_bytes": "max_vmsize", "max_vmsize_node": "max_vmsize_node",
    "ave_vmsize_bytes": "ave_vmsize", "max_pages": "max_pages", "max_pages_node": "max_pages_node",
    "ave_pages": "ave_pages", "read_bytes": "_read", "write_bytes": "_write",
    "max_disk_read_bytes": "max_disk_read", "max_disk_read_node": "max_disk_read_node",
    "ave_disk_read_bytes": "ave_disk_read", "max_disk_write_bytes": "max_disk_write",
    "max_disk_write_node": "max_disk_write_node", "ave_disk_write_bytes": "ave_disk_write",
    "tres_usage_in_max": "tres_in_max", "tres_usage_in_max_node": "tres_in_max_node",
    "tres_usage_in_ave": "tres_in_ave", "gpu_utilization": "_util", "gpu_memory_bytes": "_gmem",
    "consumed_energy": "consumed_energy", "ntasks": "ntasks", "nnodes": "nnodes", "node_list": "node_list",
}


def _struct(fields: dict[str, str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(n) for n, c in fields.items()])


def _ordered_list(order: str, row: Column) -> Column:
    """A job's own rows in order; the element count is bounded by one job's records."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("_row"))))
    return F.transform(packed, lambda x: x["_row"])


def job_report(
    metrics: DataFrame,
    steps: DataFrame,
    findings: DataFrame,
    attempts: DataFrame | None = None,
    logs: DataFrame | None = None,
) -> DataFrame:
    """One nested row per job: its figures by section, steps, earlier attempts, findings
    and log path.  ``metrics`` selects the jobs."""
    if "max_rss_node" not in metrics.columns:
        metrics = rollup.with_places(metrics, steps)
    nz = lambda c: F.when(c != 0, c)
    s = steps.withColumns(
        {
            "_read": F.coalesce(text.tres_bytes("tres_in_tot", "fs/disk"), "max_disk_read"),
            "_write": F.coalesce(text.tres_bytes("tres_out_tot", "fs/disk"), "max_disk_write"),
            "_util": F.coalesce(text.tres_double("tres_in_ave", "gres/gpuutil"), text.tres_double("tres_in_max", "gres/gpuutil")) / 100.0,
            "_gmem": F.coalesce(nz(text.tres_bytes("tres_in_max", "gres/gpumem")), text.tres_bytes("tres_in_ave", "gres/gpumem")),
        }
    )
    step_rows = s.groupBy("alloc_id").agg(_ordered_list("pos", _struct(STEP_FIELDS)).alias("steps"))
    said = {c: c for c in ("severity", "code", "title", "evidence", "action")}
    ranked = findings.withColumn("_order", severity_rank("severity") * 1000 + F.col("position"))
    finding_rows = ranked.groupBy("alloc_id").agg(_ordered_list("_order", _struct(said)).alias("findings"))
    df = metrics.join(step_rows, "alloc_id", "left").join(finding_rows, "alloc_id", "left")
    if attempts is None:
        df = df.withColumn("earlier", F.array())
    else:
        fields = {
            "state": "state", "base_state": "_base", "exit_code": "exit_code", "submit": "submit",
            "start": "start", "end": "end", "elapsed_seconds": "elapsed", "node_list": "node_list",
        }
        tries = attempts.withColumn("_base", states.base_state("state")).groupBy("cluster", "job_id").agg(
            _ordered_list("attempt", _struct(fields)).alias("earlier")
        )
        df = null_safe_join(df, tries, ["cluster", "job_id"], "left")
    if logs is None:
        df = df.withColumns({"log": F.lit(None).cast("string"), "log_expected": F.lit(None).cast("struct<path:string,status:string>")})
    else:
        df = df.join(logs.select("alloc_id", F.col("path").alias("log"), "log_expected"), "alloc_id", "left")
    return df.select(
        "alloc_id",
        *[_struct(fields).alias(name) for name, fields in SECTIONS.items()],
        "energy_joules", "log", "log_expected", "steps", "findings",
    )


def covering(section: DataFrame, since: str | None = None, until: str | None = None, counters: dict[str, int] | None = None) -> DataFrame:
    """A section's rows with what they cover: the window, and the records that reading refused (NULL if none)."""
    refused = {k: v for k, v in (counters or {}).items() if k != "records" and v}
    pairs = [x for k, v in sorted(refused.items()) for x in (F.lit(k), F.lit(v).cast("long"))]
    window = F.struct(F.lit(since).cast("string").alias("since"), F.lit(until).cast("string").alias("until"))
    return section.withColumns({"window": window, "dropped_rows": (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,bigint>")})


def write_json(report: DataFrame, path: str) -> None:
    """One document per job, measured absences kept as explicit nulls."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def overview_section(metrics: DataFrame, sort: str = "cost") -> tuple[DataFrame, DataFrame]:
    """Totals and the workload table of a window."""
    table = workloads.sort_workloads(workloads.workloads(metrics), sort)
    return workloads.goodput(metrics), table


def sizing_section(metrics: DataFrame, site: DataFrame | None = None, ceilings: DataFrame | None = None):
    """One row per workload with its three directives."""
    rows = sizing.advice(metrics, site, ceilings)
    flags = ("flag", "verdict", "requested", "target", "observed", "suggestion", "basis", "caution")
    order = F.array_position(F.array(*[F.lit(f) for f in sizing.FLAGS]), F.col("flag"))
    ranked = rows.withColumn("_order", order)
    return ranked.groupBy(*workloads.KEY, "runs").agg(
        _ordered_list("_order", _struct({f: f for f in flags})).alias("advice")
    )


def patterns_section(metrics: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return workloads.goodput(metrics), patterns.patterns(metrics, attempts)


def nodes_section(metrics: DataFrame, metric: str = "failure", controlled: bool = True) -> tuple[DataFrame, DataFrame]:
    """The node table and its totals."""
    rows = reliability.placements(metrics, metric)
    if controlled:
        pick = reliability.dominant_workload(metrics, metric).select(*reliability.WORKLOAD)
        rows = reliability.null_safe_join(rows, pick, reliability.WORKLOAD, "left_semi")
    rows = reliability.cut(rows)
    hit = F.col("hit")
    return reliability.entity_rates(rows, "node", hit), reliability.entity_rates_summary(rows, "node", hit)
