"""Jobs rolled up into workloads, searched, ordered and totalled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, states, text
from ..functions.hostlist import expand_hosts
from .common import mark_top

KEY = ["workload_name", "workload_partition", "workload_kind", "workload_user"]
GPU_CORE_EQUIVALENT = 16.0
IDLE_SHARE = 0.10
IDLE_HOURS = 100.0
IDLE_HEADLINE_HOURS = 1.0


def with_key(metrics: DataFrame) -> DataFrame:
    """The workload key: folded name, partition, kind of device and user.  Sizes are
    left out on purpose, so that a changed request stays the same workload."""
    return metrics.withColumns(
        {
            "workload_name": F.col("folded_name"),
            "workload_partition": F.coalesce("partition", F.lit("?")),
            "workload_kind": F.when(F.col("gpu_count") > 0, "gpu").otherwise("cpu"),
            "workload_user": F.coalesce("user", F.lit("?")),
        }
    )


def newest() -> Column:
    """Orders runs by start (else submit), then numeric id."""
    return F.struct("stamp", "id_primary", "id_task", "job_id")


def label_aggregates(ok: Column) -> list[Column]:
    named = ok & (F.length("name") > 0)
    return [
        F.count_distinct(F.when(ok, F.coalesce("name", F.lit("")))).alias("distinct_names"),
        F.max_by("name", F.when(named, newest())).alias("newest_name"),
    ]


def label() -> Column:
    """The real name if there is one, the newest name if the fold kept no letter."""
    name = F.col("newest_name")
    more = F.col("distinct_names") - 1
    erased = F.when(name.isNull(), F.col("workload_name")).when(
        more > 0, F.concat(name, F.lit(" +"), more.cast("string"))
    ).otherwise(name)
    return (
        F.when(F.col("distinct_names") == 1, F.coalesce(name, F.col("workload_name")))
        .when(text.fold_erased("workload_name"), erased)
        .otherwise(F.col("workload_name"))
    )


def workloads(metrics: DataFrame, query: str | None = None) -> DataFrame:
    """One row per workload over usable jobs; ``excluded`` counts open records of it.

    With ``query``, a boolean ``matches`` tells whether the text occurs in the name,
    partition, last or first date, or in any member's real name.  Member names are
    tested while aggregating, so no list of names is ever collected.
    """
    ok = states.usable()
    problem = F.col("is_failed") | F.col("is_noop")
    gpu = F.coalesce("gpu_hours", F.lit(0.0))
    core = F.coalesce("core_hours", F.lit(0.0))
    needle = (query or "").strip().lower()
    aggs = [
        F.count_if(ok).alias("runs"),
        F.count_if(ok & F.col("is_completed")).alias("completed"),
        F.count_if(ok & F.col("is_failed")).alias("failed"),
        F.count_if(ok & F.col("is_cancelled")).alias("cancelled"),
        F.count_if(ok & F.col("is_noop")).alias("noop"),
        F.count_if(ok & problem).alias("problems"),
        F.sum(F.when(ok, gpu)).alias("gpu_hours"),
        F.sum(F.when(ok, core)).alias("core_hours"),
        F.coalesce(F.sum(F.when(ok & problem, gpu)), F.lit(0.0)).alias("wasted_gpu_hours"),
        F.min(F.when(ok, F.col("stamp"))).alias("first_seen"),
        F.max(F.when(ok, F.col("stamp"))).alias("last_seen"),
        F.count_if("open_ended").alias("excluded"),
        *label_aggregates(ok),
    ]
    if needle:
        aggs.append(F.min(F.when(ok & (F.length("name") > 0), F.col("name"))).alias("_name0"))
        aggs.append(
            F.bool_or(F.when(ok, F.contains(F.lower("name"), F.lit(needle)))).alias("_member")
        )
    df = with_key(metrics).groupBy(*KEY).agg(*aggs).filter("runs > 0")
    df = df.withColumns(
        {
            "label": label(),
            "failure_rate": F.try_divide(F.col("failed"), F.col("completed") + F.col("failed")),
            "noop_rate": F.col("noop") / F.col("runs"),
            "cost": F.col("gpu_hours") * GPU_CORE_EQUIVALENT + F.col("core_hours"),
        }
    )
    rate, idle, many = F.col("failure_rate"), F.col("noop_rate"), F.col("runs") >= 3
    df = df.withColumn(
        "severity",
        F.when(many & (rate >= 0.5), "crit")
        .when(many & (idle >= 0.25), "crit")
        .when((rate >= 0.2) | (idle >= 0.1), "warn")
        .otherwise("ok"),
    )
    if needle:
        def date(c: str) -> Column:
            return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))

        head = F.lower(
            F.concat_ws(
                " ", "workload_name", "workload_partition", date("last_seen"), date("first_seen"), "_name0"
            )
        )
        found = F.contains(head, F.lit(needle)) | F.coalesce("_member", F.lit(False))
        df = df.withColumn("matches", found).drop("_name0", "_member")
    return df


def filter_workloads(df: DataFrame, mode: str = "all") -> DataFrame:
    """Keep workloads with failures / noops / either; apply ``matches`` if present."""
    wanted = {
        "failed": F.col("failed") > 0,
        "noop": F.col("noop") > 0,
        "problem": (F.col("failed") > 0) | (F.col("noop") > 0),
    }.get(mode)
    if wanted is not None:
        df = df.filter(wanted)
    return df.filter("matches").drop("matches") if "matches" in df.columns else df


SORT_MODES = ["cost", "failures", "rate", "recent", "runs", "name"]


def workload_order(mode: str = "cost") -> list[Column]:
    """Ascending sort columns of a mode, completed to a total order by the key."""
    cost, runs = -F.col("cost"), -F.col("runs")
    lead = {
        "cost": [cost, runs],
        "failures": [-F.col("problems"), cost],
        "rate": [-F.coalesce("failure_rate", F.lit(0.0)), runs],
        # No stamp at all comes last.
        "recent": [F.col("last_seen").isNull(), -F.unix_micros(F.col("last_seen").cast("timestamp")), F.col("workload_name")],
        "runs": [runs, F.col("workload_name")],
        "name": [F.lower("workload_name"), F.col("workload_partition")],
    }
    return [*lead.get(mode, lead["cost"]), *[F.col(k) for k in KEY]]


def sort_workloads(df: DataFrame, mode: str = "cost") -> DataFrame:
    return df.orderBy(*workload_order(mode))


def tail_share(df: DataFrame, shown: int, mode: str = "cost") -> DataFrame:
    """What lies below the first ``shown`` workloads: how many, runs, share of cost."""
    marked = mark_top(df, workload_order(mode), shown)
    hidden = ~F.col("shown")
    return marked.agg(
        F.count_if("shown").alias("shown"),
        F.count_if(hidden).alias("hidden"),
        F.coalesce(F.sum(F.when(hidden, F.col("runs"))), F.lit(0)).alias("hidden_runs"),
        F.coalesce(
            F.try_divide(F.sum(F.when(hidden, F.col("cost"))), F.sum("cost")), F.lit(0.0)
        ).alias("hidden_cost_share"),
    )


# -- job filters -----------------------------------------------------------------------

def outcome(mode: str) -> Column:
    return {
        "failed": F.col("is_failed"),
        "noop": F.col("is_noop"),
        "problem": F.col("is_failed") | F.col("is_noop"),
    }.get(mode, F.lit(True))


def filter_jobs(metrics: DataFrame, mode: str = "all", query: str = "") -> DataFrame:
    """Outcome filter plus case-insensitive text search over id, name, state,
    partition, hosts (list and expanded) and start."""
    df = metrics.filter(outcome(mode))
    needle = query.strip().lower()
    if not needle:
        return df
    blank = F.lit("")
    hosts = F.when(
        F.col("node_list").contains("["),
        F.concat_ws(" ", "node_list", F.array_join(expand_hosts("node_list"), " ")),
    ).otherwise(F.coalesce("node_list", blank))
    hay = F.concat_ws(
        " ", "job_id", F.coalesce("name", blank), F.coalesce("base_state", blank),
        F.coalesce("partition", blank), hosts,
        F.coalesce(F.date_format("start", "yyyy-MM-dd HH:mm:ss"), blank),
    )
    return df.filter(F.contains(F.lower(hay), F.lit(needle)))


def problem_jobs(metrics: DataFrame, mode: str = "problem", query: str = "") -> DataFrame:
    """Newest first, over usable records."""
    rows = filter_jobs(metrics.filter(states.usable()), mode, query)
    return rows.orderBy(F.desc_nulls_last("stamp"), F.desc("job_id"))


def jobs_by_id(metrics: DataFrame, job_ids: list[str]) -> DataFrame:
    return metrics.filter(F.col("job_id").isin(job_ids))


def workload_of(metrics: DataFrame, groups: DataFrame, job_id: str) -> DataFrame:
    """The workload row a job belongs to."""
    mine = with_key(jobs_by_id(metrics, [job_id])).select(*KEY).distinct()
    return groups.join(mine, KEY, "left_semi")


# -- totals ----------------------------------------------------------------------------

def goodput(metrics: DataFrame) -> DataFrame:
    """One row of totals.  Every input row is counted as used or excluded by reason."""
    ok = states.usable()
    gpu = F.coalesce("gpu_hours", F.lit(0.0))
    done, gone, bad = F.col("is_completed"), F.col("is_cancelled"), F.col("is_failed")

    def hours(cond: Column, value: Column = gpu) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))

    df = metrics.agg(
        F.count_if(ok).alias("jobs"),
        F.count_if(ok & done).alias("completed"),
        F.count_if(ok & bad).alias("failed"),
        F.count_if(ok & gone).alias("cancelled"),
        F.count_if(ok & ~done & ~gone & ~bad).alias("unclassified"),
        F.count_if(ok & F.col("is_noop")).alias("noop_jobs"),
        hours(ok).alias("gpu_hours_total"),
        hours(ok & done).alias("gpu_hours_completed"),
        hours(ok & F.col("is_noop")).alias("gpu_hours_noop"),
        hours(ok, F.coalesce("core_hours", F.lit(0.0))).alias("core_hours_total"),
        F.count_if("open_ended").alias("excluded_open_records"),
        F.count_if(F.col("base_state").isNull()).alias("excluded_unparsed"),
        (
            F.count("*") - F.count_if(ok) - F.count_if("open_ended")
            - F.count_if(F.col("base_state").isNull())
        ).alias("excluded_no_elapsed"),
        (F.count("*") + F.coalesce(F.sum("step_count"), F.lit(0))).alias("parsed_rows"),
    )
    classified = F.col("completed") + F.col("failed") + F.col("cancelled")
    return df.withColumns(
        {
            "gpu_goodput": F.try_divide("gpu_hours_completed", "gpu_hours_total"),
            "gpu_noop_fraction": F.try_divide("gpu_hours_noop", "gpu_hours_total"),
            "completion_rate": F.try_divide(F.col("completed"), classified),
        }
    )


def span_concurrency(metrics: DataFrame) -> DataFrame:
    """Hours between the first start and the last end, and mean GPUs held over them."""
    df = metrics.filter(states.usable()).agg(
        F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
        F.sum("gpu_hours").alias("gpu_hours_total"),
    )
    span = (F.unix_micros(F.col("last_end").cast("timestamp")) - F.unix_micros(F.col("first_start").cast("timestamp"))) / 3.6e9
    df = df.withColumn("span_hours", F.when(span > 0, span))
    return df.withColumn(
        "gpu_concurrency",
        F.when(F.col("gpu_hours_total") != 0, F.try_divide("gpu_hours_total", "span_hours")),
    )


def idle_hours(totals: DataFrame) -> DataFrame:
    """The goodput row, kept only when idle GPU-hours are worth naming."""
    idle, total = F.col("gpu_hours_noop"), F.col("gpu_hours_total")
    worth = (F.try_divide(idle, total) >= IDLE_SHARE) | (idle >= IDLE_HOURS)
    return totals.filter((idle > 0) & (total > 0) & worth)


def idle_workload(groups: DataFrame) -> DataFrame:
    """The workload wasting most GPU-hours, if that is worth a headline."""
    worst = groups.orderBy(F.desc("wasted_gpu_hours"), *workload_order("cost")).limit(1)
    wasted = F.col("wasted_gpu_hours")
    share = F.try_divide(wasted, F.col("gpu_hours"))
    return worst.filter(
        (wasted >= IDLE_HEADLINE_HOURS) & ((share >= IDLE_SHARE) | (wasted >= IDLE_HOURS))
    )


def headline(totals: DataFrame) -> DataFrame:
    """One sentence on a window: idle hours, else failures, else nothing flagged."""
    idle, total = F.col("gpu_hours_noop"), F.col("gpu_hours_total")
    worth = (idle > 0) & ((F.try_divide(idle, total) >= IDLE_SHARE) | (idle >= IDLE_HOURS))
    said = (
        F.when(
            worth,
            F.concat(
                F.format_string("%.0f of %.0f ", formats.printed(idle, 0), formats.printed(total, 0)), formats.plural(total, "GPU-hour"),
                F.lit(" went to allocations that did not compute"),
            ),
        )
        .when(F.col("failed") > 0, F.concat(F.format_string("%d of ", "failed"), formats.counted("jobs", "job"), F.lit(" failed")))
        .otherwise(F.concat(formats.counted("jobs", "job"), F.lit(", none flagged")))
    )
    return totals.select(said.alias("headline"))
