"""What repeats across the runs of a workload.

Each detector is aggregations per workload.  The ordered one (the memory walk) goes
through ``ordered.value_runs``, which never sorts a whole workload in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, states, text
from . import ordered
from .common import mark_top, null_safe_join, top_per_group
from .workloads import KEY, label, label_aggregates, with_key

REPEAT_MIN = 5
REPEAT_FAIL_FRACTION = 0.5
OOM_MIN = 3
REQUEUE_MIN = 3
REQUEUE_FRACTION = 0.1
REPORT_LIMIT = 4
WALK_STEPS = 8
WALK_HEAD, WALK_TAIL = 4, 3
NOOP_QUICK_SECONDS = 900.0


def _members(metrics: DataFrame) -> DataFrame:
    return with_key(metrics.filter(states.usable()))


def _dominant(rows: DataFrame, state: Column, prefix: str) -> DataFrame:
    """Most frequent state per workload; a tie goes to the later word."""
    counts = rows.groupBy(*KEY, state.alias("_state")).agg(F.count("*").alias("_n"))
    best = F.max(F.struct("_n", "_state"))
    return (
        counts.groupBy(*KEY)
        .agg(best.alias("_best"))
        .select(
            *KEY, F.col("_best._state").alias(f"{prefix}_state"), F.col("_best._n").alias(f"{prefix}_count")
        )
    )


def repeat_failures(metrics: DataFrame, min_runs: int = REPEAT_MIN) -> DataFrame:
    """Workloads that keep failing: at least ``min_runs`` failures, half of all runs."""
    rows = _members(metrics)
    bad = F.col("is_failed")
    hung = bad & F.col("is_noop")
    master = text.array_master("job_id")
    limit_text = F.when(bad & F.col("timelimit").isNotNull(), formats.duration_text("timelimit"))
    groups = rows.groupBy(*KEY).agg(
        F.count("*").alias("runs"),
        F.count_if(bad).alias("failures"),
        F.count_if(F.col("is_completed")).alias("completed"),
        F.count_if(hung).alias("hung"),
        F.coalesce(F.sum(F.when(bad, F.coalesce("gpu_hours", F.lit(0.0)))), F.lit(0.0)).alias("wasted_gpu_hours"),
        # "one distinct value" is min = max: no set is collected.
        F.min(master).alias("_m0"), F.max(master).alias("_m1"),
        F.min(limit_text).alias("_l0"), F.max(limit_text).alias("_l1"),
        F.max(F.when(bad & ~F.col("is_noop"), F.col("timelimit"))).alias("computing_limit"),
        *label_aggregates(F.lit(True)),
    )
    groups = groups.filter(
        (F.col("runs") >= min_runs)
        & (F.col("failures") >= min_runs)
        & (F.col("failures") / F.col("runs") >= REPEAT_FAIL_FRACTION)
    )
    dominant = _dominant(rows.filter(bad), F.col("base_state"), "dominant")
    df = groups.join(dominant, KEY)
    one_limit = (F.col("dominant_state") == "TIMEOUT") & (F.col("_l0") == F.col("_l1"))
    df = df.withColumns(
        {
            "label": label(),
            "share": F.col("failures") / F.col("runs"),
            "array_job": F.when((F.col("_m0") == F.col("_m1")) & (F.col("runs") > 1), F.col("_m0")),
            "shared_timelimit": F.when(one_limit, F.col("_l0")),
            "mostly_hung": (F.col("hung") > 0) & (F.col("hung") >= 0.5 * F.col("failures")),
            "computing": F.col("failures") - F.col("hung"),
        }
    )
    df = df.withColumn("severity", F.when(F.col("share") > 0.8, "critical").otherwise("warning"))
    sentence = F.concat(
        F.format_string("%d of %d runs of %s on %s failed, %d as %s.", "failures", "runs", "label", "workload_partition", "dominant_count", "dominant_state"),
        F.when(F.col("array_job").isNotNull(), F.format_string(" They are tasks of array %s.", "array_job")).otherwise(""),
        F.when(F.col("shared_timelimit").isNotNull(), F.format_string(" All had the limit %s.", "shared_timelimit")).otherwise(""),
        F.when(F.col("wasted_gpu_hours") > 1.0, F.concat(F.format_string(" Failures took %.0f ", formats.printed("wasted_gpu_hours", 0)), formats.plural("wasted_gpu_hours", "GPU-hour"), F.lit("."))).otherwise(""),
    )
    split = F.when(
        (F.col("computing") > 0) & (F.coalesce("computing_limit", F.lit(0.0)) > 0),
        F.concat(F.lit(" The "), F.col("computing").cast("string"), F.lit(" that computed were cut at "), formats.duration_text("computing_limit"), F.lit(", a lower bound for the limit.")),
    ).otherwise("")
    mixed = F.when(
        F.col("completed") > 0, F.format_string(" %d of %d completed: compare them.", "completed", "runs")
    ).otherwise("")
    advice = (
        F.when(F.col("mostly_hung"), F.concat(F.format_string("%d hung without using CPU; a longer limit does not help them. Find the blocking call.", "hung"), split))
        .when(F.col("dominant_state") == "TIMEOUT", "The runs were cut off; the limit is below what they need.")
        .when(F.col("dominant_state") == "OUT_OF_MEMORY", "See the memory finding of this workload.")
        .when(F.col("array_job").isNotNull(), F.concat(F.lit("A single array: reproduce one task interactively."), mixed))
        .when(F.col("completed") > 0, F.concat(F.lit("Reproduce interactively."), mixed))
        .otherwise("The failure is deterministic: resubmitting repeats it. Reproduce interactively.")
    )
    return df.withColumns(
        {"code": F.lit("repeat-failure"), "evidence": sentence, "action": advice}
    ).drop("_m0", "_m1", "_l0", "_l1", "newest_name")


def requeues(
    metrics: DataFrame, attempts: DataFrame, min_runs: int = REQUEUE_MIN, fraction: float = REQUEUE_FRACTION
) -> DataFrame:
    """Workloads whose jobs are restarted often: ended earlier attempts of their jobs."""
    rows = _members(metrics)
    ended = (
        attempts.filter(F.col("end").isNotNull())
        .select("job_id", F.col("cluster").alias("_cluster"), F.coalesce(states.base_state("state"), F.lit("?")).alias("_state"), F.coalesce("elapsed", F.lit(0.0)).alias("_elapsed"))
    )
    # Attempts per job and state first: one row per job and state reaches the join.
    per_job = ended.groupBy("job_id", "_cluster", "_state").agg(
        F.count("*").alias("_n"), F.sum("_elapsed").alias("_burned")
    )
    jobs = rows.select("job_id", F.col("cluster").alias("_cluster"), *KEY)
    joined = null_safe_join(per_job, jobs, ["job_id", "_cluster"])
    by_state = joined.groupBy(*KEY, "_state").agg(F.sum("_n").alias("_n"), F.sum("_burned").alias("_burned"))
    best = F.max(F.struct("_n", "_state"))
    states_of = by_state.groupBy(*KEY).agg(
        best.alias("_best"), F.sum("_n").alias("attempts"), F.sum("_burned").alias("abandoned_seconds")
    )
    requeued = joined.select(*KEY, "job_id", "_cluster").distinct().groupBy(*KEY).agg(F.count("*").alias("requeued"))
    runs = rows.groupBy(*KEY).agg(F.count("*").alias("runs"), *label_aggregates(F.lit(True)))
    df = (
        states_of.join(requeued, KEY)
        .filter(F.col("requeued") >= min_runs)
        .join(runs, KEY)
        .filter(F.col("requeued") / F.col("runs") >= fraction)
    )
    df = df.withColumns(
        {"label": label(), "dominant_state": F.col("_best._state"), "dominant_count": F.col("_best._n")}
    )
    sentence = F.concat(
        F.format_string("%d of %d runs of %s on %s were restarted: ", "requeued", "runs", "label", "workload_partition"),
        formats.counted("attempts", "attempt"),
        F.format_string(", %d as %s.", "dominant_count", "dominant_state"),
        F.when(F.col("abandoned_seconds") > 0, F.concat(F.lit(" Abandoned run time: "), formats.duration_text("abandoned_seconds"), F.lit("."))).otherwise(""),
    )
    advice = (
        F.when(F.col("dominant_state") == "NODE_FAIL", "Machines failed under it: check the node table and avoid the bad ones.")
        .when(F.col("dominant_state").isin("PREEMPTED", "CANCELLED"), "Policy, not a fault: use a higher priority class, and checkpoint.")
        .otherwise("Without checkpoints each restart repeats the work; check the node table.")
    )
    return df.withColumns(
        {"code": F.lit("requeue-repeat"), "severity": F.lit("warning"), "evidence": sentence, "action": advice}
    ).drop("_best", "newest_name")


def memory_walk(oom: DataFrame, keys: list[str], value: str = "mem_limit") -> DataFrame:
    """Run-length walk of memory limits over kills in id order."""
    rows = oom.filter(F.col(value).isNotNull()).withColumn("_chunk", ordered.id_chunk(F.col("id_primary")))
    return ordered.value_runs(
        rows, keys, "_chunk", ["id_primary", "id_task", "job_id"], value, edge=WALK_STEPS
    )


def walk_text() -> Column:
    step = lambda s: F.when(
        s["n"] > 1, F.concat(formats.bytes_text(s["value"]), F.lit(" ×"), s["n"].cast("string"))
    ).otherwise(formats.bytes_text(s["value"]))
    runs = F.transform("walk_runs", step)
    short = F.array_join(runs, " -> ")
    gap = F.format_string("... %d more ...", F.col("n_runs") - (WALK_HEAD + WALK_TAIL))
    long = F.array_join(
        F.concat(F.slice(runs, 1, WALK_HEAD), F.array(gap), F.slice(runs, -WALK_TAIL, WALK_TAIL)), " -> "
    )
    return F.when(F.col("n_runs") <= WALK_STEPS, short).otherwise(long)


def memory_contradictions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First completed run whose limit had already been exceeded earlier in id order."""
    order = F.struct("id_primary", "id_task", "job_id")
    killed = (
        rows.filter(states.is_state("state", "OUT_OF_MEMORY") & F.col("mem_limit").isNotNull())
        .groupBy(*keys, "mem_limit")
        .agg(F.min(order).alias("_killed"))
    )
    done = rows.filter("is_completed").withColumn("_order", order)
    later = done.join(killed, [*keys, "mem_limit"]).filter(F.col("_order") > F.col("_killed"))
    first = F.min_by(F.struct("job_id", "mem_limit"), "_order")
    return later.groupBy(*keys).agg(first.alias("_c")).select(
        *keys, F.col("_c.job_id").alias("contradicting_job"), F.col("_c.mem_limit").alias("contradicting_limit")
    )


def memory_searches(metrics: DataFrame, min_oom: int = OOM_MIN) -> DataFrame:
    """Workloads whose memory limit is being guessed at by trial and error."""
    rows = _members(metrics)
    oom = states.is_state("state", "OUT_OF_MEMORY")
    asked = F.when(oom, F.col("mem_limit"))
    groups = rows.groupBy(*KEY).agg(
        F.count("*").alias("runs"),
        F.count_if(oom).alias("oom_kills"),
        F.count(asked).alias("known_limits"),
        F.min(asked).alias("smallest_limit"),
        F.max(asked).alias("largest_limit"),
        *label_aggregates(F.lit(True)),
    ).filter((F.col("oom_kills") >= min_oom) & (F.col("known_limits") >= min_oom))
    picked = groups.select(*KEY)
    kills = rows.filter(oom).join(picked, KEY, "left_semi")
    df = groups.join(memory_walk(kills, KEY), KEY).join(
        memory_contradictions(rows.join(picked, KEY, "left_semi"), KEY), KEY, "left"
    )
    against = F.col("contradicting_job").isNotNull()
    df = df.withColumns(
        {
            "label": label(),
            "searching": F.col("smallest_limit") < F.col("largest_limit"),
            "monotone": F.col("n_decreases") == 0,
            "walk": walk_text(),
            "severity": F.when(against, "critical").otherwise("warning"),
        }
    )
    searching = F.col("searching")
    sentence = F.concat(
        F.when(searching, F.format_string("%d memory kills of %s; the limit went %s.", "oom_kills", "label", "walk"))
        .otherwise(F.concat(F.format_string("%d memory kills of %s, each at ", "oom_kills", "label"), formats.bytes_text("largest_limit"), F.lit("."))),
        F.when(against, F.concat(F.format_string(" Job %s then completed with ", "contradicting_job"), formats.bytes_text("contradicting_limit"), F.lit("."))).otherwise(""),
    )
    advice = (
        F.when(against, "The same limit failed and sufficed, so memory is not the cause: look for what else changed.")
        .when(~searching, "The request never changed: measure the peak once and add a margin.")
        .when(~F.col("monotone"), "The limit goes up and down without converging: measure the peak once and add a margin.")
        .otherwise(F.concat(F.lit("Stop stepping: go well above "), formats.bytes_text("largest_limit"), F.lit(" once, then tighten by measurement.")))
    )
    code = F.when(searching, "memory-search").otherwise("memory-unchanged")
    return df.withColumns({"code": code, "evidence": sentence, "action": advice}).drop("newest_name")


_TABLE = ["scope", "position", "severity", "code", *KEY, "weight", "hits", "evidence", "action"]
# Codes of the remainder rows.
_MORE = {"repeat": "repeat-failure-more", "memory": "memory-more", "requeue": "requeue-repeat-more"}


def _report(df: DataFrame, scope: str, weight: Column, hits: Column, limit: int) -> DataFrame:
    """The ``limit`` heaviest rows, then one row that says what was left out."""
    rows = df.select(
        F.lit(scope).alias("scope"), "severity", "code", *KEY,
        weight.cast("double").alias("weight"), hits.cast("long").alias("hits"), "evidence", "action",
    )
    order = [-F.col("weight"), -F.col("hits"), *[F.col(k) for k in KEY]]
    marked = mark_top(rows, order, limit)
    hidden = marked.filter(~F.col("shown"))
    more = hidden.agg(
        F.count("*").alias("_n"), F.sum("weight").alias("weight"), F.sum("hits").alias("hits")
    ).filter(F.col("_n") > 0)
    more = more.select(
        F.lit(scope).alias("scope"), F.lit(1).alias("position"), F.lit("info").alias("severity"),
        F.lit(_MORE[scope]).alias("code"), *[F.lit(None).cast("string").alias(k) for k in KEY],
        "weight", "hits",
        F.concat(formats.counted("_n", "further workload"), F.lit(", "), F.col("hits").cast("string"), F.lit(" more hits.")).alias("evidence"),
        F.lit("").alias("action"),
    )
    return marked.filter("shown").withColumn("position", F.lit(0)).select(*_TABLE).unionByName(more.select(*_TABLE))


def patterns(
    metrics: DataFrame, attempts: DataFrame, limit: int = REPORT_LIMIT, memory_limit: int = REPORT_LIMIT
) -> DataFrame:
    """All detectors of a history, each cut to its heaviest workloads plus a remainder."""
    found = [
        _report(repeat_failures(metrics), "repeat", F.col("wasted_gpu_hours"), F.col("failures"), limit),
        _report(memory_searches(metrics), "memory", F.col("oom_kills"), F.col("oom_kills"), memory_limit),
        _report(requeues(metrics, attempts), "requeue", F.col("abandoned_seconds"), F.col("requeued"), limit),
    ]
    return reduce(DataFrame.unionByName, found)


def patterns_per_workload(metrics: DataFrame, attempts: DataFrame) -> DataFrame:
    """The same findings for every workload, without a global cut."""
    cols = ["severity", "code", *KEY, "evidence", "action"]
    found = [
        repeat_failures(metrics).select(*cols),
        memory_searches(metrics).select(*cols),
        requeues(metrics, attempts).select(*cols),
    ]
    return reduce(DataFrame.unionByName, found)


def noop_top(metrics: DataFrame, top: int = 10) -> DataFrame:
    """The longest allocations that computed nothing, by GPU-hours else hours."""
    held = F.coalesce(F.nullif("gpu_hours", F.lit(0.0)), F.coalesce("elapsed", F.lit(0.0)) / 3600.0)
    dead = metrics.filter(states.usable() & F.col("is_noop")).withColumn("held_hours", held)
    return dead.orderBy(F.desc("held_hours"), "id_primary", "id_task", "job_id").limit(top)


def noop_summary(metrics: DataFrame) -> DataFrame:
    return metrics.filter(states.usable() & F.col("is_noop")).agg(
        F.count("*").alias("noop_jobs"),
        F.coalesce(F.sum("gpu_hours"), F.lit(0.0)).alias("gpu_hours"),
        F.count_if(F.coalesce("elapsed", F.lit(0.0)) <= NOOP_QUICK_SECONDS).alias("quick"),
    )


# -- the same detectors over any table -------------------------------------------------

def event_runs(
    df: DataFrame, entity: str, order: list[str], chunk: Column, event: Column, edge: int = WALK_STEPS
) -> DataFrame:
    """Run-length view of a boolean along an entity's rows: rows, events, runs, the
    longest event run, found without sorting an entity in one task."""
    rows = df.select(entity, *order, chunk.alias("_chunk"), event.cast("int").alias("_hit"))
    changed = rows.withColumn("_one", F.lit(1)).withColumn("_miss", 1 - F.col("_hit"))
    # Rows of one event run share the number of misses before them.
    numbered = ordered.running_count(changed, [entity], "_chunk", order, "_miss", "_group")
    runs = numbered.filter("_hit = 1").groupBy(entity, "_group").agg(F.count("*").alias("_len"))
    longest = runs.groupBy(entity).agg(
        F.max("_len").alias("longest_run"), F.count("*").alias("event_runs")
    )
    totals = rows.groupBy(entity).agg(F.count("*").alias("n_rows"), F.sum("_hit").alias("events"))
    return totals.join(longest, entity, "left").select(
        entity, "n_rows", "events",
        F.coalesce("event_runs", F.lit(0)).alias("event_runs"),
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
    )


def worst_per_workload(found: DataFrame, n: int = 1) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return top_per_group(found, KEY, [rank, F.col("code")], n)
