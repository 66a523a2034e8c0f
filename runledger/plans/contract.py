"""The driver-facing queries: each takes a session and a folder of parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, logtext, text
from ..functions.hostlist import explode_hosts
from ..operators import attach, intervals, logmatch, ordered, refresh, store
from ..operators import findings as D
from ..operators import patterns as PT
from ..operators import reliability as R
from ..operators import sizing as Z
from ..operators import workloads as W
from ..operators.common import checkpoint_dir, shuffles_removed
from ..operators.rollup import job_metrics
from ..sources import dumps, sinks, tables
from . import pipeline
from . import projections as P

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def r6(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def ts(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_RATES = ["rate", "ci_low", "ci_high", "comparison", "p_value"]


def _rates(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, big("bad"), big("trials"), *[r6(c) for c in _RATES], "direction", "verdict")


def _returned() -> Column:
    return F.col("l_returnflag") == "R"


@query
def entity_rates_supplier(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem")
    return _rates(R.entity_rates(items, "l_suppkey", _returned()), "l_suppkey")


def _summary(df: DataFrame) -> DataFrame:
    return df.select(
        r6("baseline"), big("trials"), big("hits"), "tested", "skipped", "held_back", "worse", "better",
        "confidence_level", "fdr_alpha",
    )


@query
def entity_rates_supplier_summary(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem")
    return _summary(R.entity_rates_summary(items, "l_suppkey", _returned()))


@query
def entity_rates_supplier_stratified(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem")
    part = P.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = items.join(part, items.l_partkey == part.p_partkey)
    return _rates(R.entity_rates(rows, "l_suppkey", _returned(), ["p_brand"]), "p_brand", "l_suppkey")


@query
def entity_rates_biased(spark, sf_dir):
    return _rates(R.node_rates(P.metrics(spark, sf_dir), controlled=False), "node")


@query
def entity_rates_biased_summary(spark, sf_dir):
    rows = R.placements(P.metrics(spark, sf_dir))
    return _summary(R.entity_rates_summary(rows, "node", F.col("hit")))


@query
def dominant_stratum(spark, sf_dir):
    return R.dominant_workload(P.metrics(spark, sf_dir), "failure")


@query
def exclude_top8(spark, sf_dir):
    rates = R.node_rates(P.metrics(spark, sf_dir), controlled=False)
    return R.suggest_exclude(rates).select(big("shown"), big("left_out"), "exclude")


@query
def node_notes(spark, sf_dir):
    return R.node_notes(P.metrics(spark, sf_dir)).select(big("job_id"), "noted_node")


@query
def job_metrics_cpu(spark, sf_dir):
    m = P.metrics_plan(spark, sf_dir)
    doubles = [
        "total_cpu", "system_cpu", "user_cpu", "system_share", "cpu_time", "cpu_utilization",
        "cores_busy", "cpus_per_task", "gpu_hours", "core_hours", "walltime_used",
    ]
    return m.select(big("job_id"), *[r6(c) for c in doubles], big("task_count"), big("gpu_count"), "is_noop")


@query
def job_metrics_memory(spark, sf_dir):
    m = P.metrics_plan(spark, sf_dir)
    longs = ["job_id", "max_rss", "ave_rss", "mem_limit", "mem_limit_total"]
    ratios = ["mem_utilization", "rss_task_imbalance", "rss_step_spread"]
    return m.select(*[big(c) for c in longs], *[r6(c) for c in ratios], "peak_trustworthy")


@query
def job_metrics_io(spark, sf_dir):
    m = P.metrics_plan(spark, sf_dir)
    longs = ["job_id", "read_bytes", "write_bytes", "io_bytes", "step_count"]
    return m.select(*[big(c) for c in longs], F.round("io_rate", 3).alias("io_rate"))


def _workload_columns(df: DataFrame) -> DataFrame:
    counts = ["runs", "completed", "failed", "cancelled", "noop", "problems", "excluded", "distinct_names"]
    doubles = ["gpu_hours", "core_hours", "wasted_gpu_hours", "cost", "failure_rate", "noop_rate"]
    return df.select(
        *W.KEY, "label", "severity", *[big(c) for c in counts], *[r6(c) for c in doubles],
        ts("first_seen"), ts("last_seen"),
    )


@query
def workload_rollup(spark, sf_dir):
    return _workload_columns(W.workloads(P.metrics(spark, sf_dir)))


@query
def workload_top_cost(spark, sf_dir):
    return _workload_columns(W.sort_workloads(W.workloads(P.metrics(spark, sf_dir))).limit(25))


@query
def workload_search(spark, sf_dir):
    found = W.filter_workloads(W.workloads(P.metrics(spark, sf_dir), "B-3"), "problem")
    return _workload_columns(found)


@query
def tail_share(spark, sf_dir):
    return W.tail_share(W.workloads(P.metrics(spark, sf_dir)), 20).select(
        big("shown"), big("hidden"), big("hidden_runs"), r6("hidden_cost_share")
    )


@query
def idle_workload(spark, sf_dir):
    return W.idle_workload(W.workloads(P.metrics(spark, sf_dir))).select(
        *W.KEY, r6("wasted_gpu_hours"), r6("gpu_hours")
    )


@query
def goodput(spark, sf_dir):
    g = W.goodput(P.metrics(spark, sf_dir))
    return g.select(*[r6(c) if t == "double" else big(c) for c, t in g.dtypes])


@query
def span_concurrency(spark, sf_dir):
    return W.span_concurrency(P.metrics(spark, sf_dir)).select(
        ts("first_start"), ts("last_end"), r6("gpu_hours_total"), r6("span_hours"), r6("gpu_concurrency")
    )


@query
def job_search(spark, sf_dir):
    found = W.filter_jobs(P.metrics(spark, sf_dir), "problem", "Node-0020")
    return found.select(big("job_id"), "state", "node_list")


@query
def problem_listing(spark, sf_dir):
    rows = W.problem_jobs(P.metrics(spark, sf_dir)).limit(25)
    return rows.select(big("job_id"), "name", "state", ts("start"))


@query
def repeat_failures(spark, sf_dir):
    return PT.repeat_failures(P.metrics(spark, sf_dir)).select(
        *W.KEY, big("runs"), "failures", "completed", "hung", r6("wasted_gpu_hours"),
        "dominant_state", "dominant_count", "severity",
    )


@query
def requeue_pattern(spark, sf_dir):
    return PT.requeues(P.metrics(spark, sf_dir), P.attempts(spark, sf_dir)).select(
        *W.KEY, big("runs"), "requeued", "attempts", "abandoned_seconds", "dominant_state", "dominant_count"
    )


@query
def noop_top(spark, sf_dir):
    return PT.noop_top(P.metrics(spark, sf_dir)).select(big("job_id"), r6("held_hours"))


@query
def noop_summary(spark, sf_dir):
    return PT.noop_summary(P.metrics(spark, sf_dir)).select("noop_jobs", r6("gpu_hours"), "quick")


@query
def memory_search_walk(spark, sf_dir):
    return PT.memory_searches(P.metrics(spark, sf_dir)).select(
        *W.KEY, "oom_kills", big("smallest_limit"), big("largest_limit"), big("n_runs"), "searching", "monotone"
    )


@query
def memory_contradiction(spark, sf_dir):
    found = PT.memory_searches(P.metrics(spark, sf_dir)).filter(F.col("contradicting_job").isNotNull())
    return found.select(*W.KEY, big("contradicting_job"))


@query
def patterns_report(spark, sf_dir):
    found = PT.patterns(P.metrics(spark, sf_dir), P.attempts(spark, sf_dir))
    return found.select("scope", "position", *W.KEY, r6("weight"), "hits")


def _advice(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col("flag") == flag).select(
        *W.KEY, big("runs"), "flag", "verdict", r6("requested"), r6("target"), r6("observed")
    )


def _ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition has nodes of 8, 16 and 24 cores."""
    jobs = P.acct_jobs(spark, sf_dir)
    return jobs.groupBy("cluster", F.col("partition_name").alias("partition")).agg(
        F.max(8 * (1 + F.col("node_id") % 3)).alias("max_cores")
    )


@query
def sizing_walltime(spark, sf_dir):
    return _advice(Z.advice(P.metrics(spark, sf_dir)), "--time")


@query
def sizing_memory(spark, sf_dir):
    return _advice(Z.advice(P.metrics(spark, sf_dir)), "--mem")


@query
def sizing_cpu(spark, sf_dir):
    rows = Z.advice(P.metrics(spark, sf_dir), ceilings=_ceilings(spark, sf_dir))
    return _advice(rows, "--cpus-per-task")


@query
def sizing_routing(spark, sf_dir):
    return Z.sizing_routing(Z.advice(P.metrics(spark, sf_dir)))


@query
def latest_request(spark, sf_dir):
    return Z.sizing_facts(P.metrics(spark, sf_dir)).select(
        *W.KEY, F.col("t_current").alias("timelimit"), F.col("m_current").alias("mem_limit"),
        F.round("c_current", 6).alias("cpus_per_task"),
    )


@query
def p95_nearest_rank(spark, sf_dir):
    items = P.table(spark, sf_dir, "lineitem")
    got = ordered.nearest_rank(items, ["l_returnflag"], "l_extendedprice", 0.95, 1000.0, "p95")
    return got.select("l_returnflag", r6("p95"))


@query
def findings_by_code(spark, sf_dir):
    return D.by_code(D.findings(P.metrics(spark, sf_dir)))


@query
def findings_worst_per_job(spark, sf_dir):
    worst = D.worst_per_job(D.findings(P.metrics(spark, sf_dir)))
    return worst.select(big("job_id"), "code", "severity", "findings")


@query
def findings_strict(spark, sf_dir):
    return D.strict_failure(D.findings(P.metrics(spark, sf_dir)))


@query
def hostlist_expand_count(spark, sf_dir):
    jobs = P.acct_jobs(spark, sf_dir)
    return explode_hosts(jobs.select("hosts"), "hosts").groupBy("node").agg(
        F.count("*").alias("placements")
    )


@query
def fold_names(spark, sf_dir):
    names = P.acct_jobs(spark, sf_dir).select("name").unionByName(
        P.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    )
    return names.groupBy(text.fold_name("name").alias("folded")).agg(
        F.count("*").alias("jobs"), F.count_distinct("name").alias("names")
    )


@query
def event_failure_runs(spark, sf_dir):
    events = P.table(spark, sf_dir, "events")
    runs = PT.event_runs(
        events, "user_id", ["event_id"], F.floor(F.col("event_id") / 65536), F.col("event_type") == "error"
    )
    return runs.select("user_id", *[big(c) for c in ("n_rows", "events", "event_runs", "longest_run")])


# -- sources and record handling -----------------------------------------------------------

def _clock(seconds: Column) -> Column:
    """Below an hour ``MM:SS.mmm``, else ``[D-]HH:MM:SS``."""
    minutes = F.floor(seconds / 60)
    short = F.format_string("%02d:%06.3f", minutes, seconds - minutes * 60)
    return F.when(seconds < 3600, short).otherwise(formats.walltime_flag(seconds))


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _record(fields: dict[str, Column]) -> Column:
    cells = [F.coalesce(fields.get(f, F.lit("")).cast("string"), F.lit("")) for f in dumps.FIELDS]
    return F.concat_ws(dumps.SAFE_DELIMITER, *cells)


def _dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounting tables as dump text: a job row, then its steps."""
    j, s = P.acct_jobs(spark, sf_dir), P.acct_steps(spark, sf_dir)
    odd = F.col("job_id") % 2 == 1
    job = _record(
        {
            "JobID": F.col("job_id"), "JobName": F.col("name"), "User": F.col("user_name"),
            "Cluster": F.col("cluster"), "Partition": F.col("partition_name"), "State": F.col("state"),
            "ExitCode": F.lit("0:0"), "Submit": _iso("submit_ts"), "Start": _iso("start_ts"),
            "End": F.coalesce(_iso("end_ts"), F.lit("Unknown")),
            "Elapsed": F.when(F.col("elapsed_s").isNotNull(), formats.walltime_flag("elapsed_s")),
            "ElapsedRaw": F.when(odd, F.col("elapsed_s")),
            "Timelimit": formats.walltime_flag("timelimit_s"),
            "ReqMem": F.format_string("%dGn", F.floor(F.col("mem_limit_bytes") / text.GIB)),
            "AllocTRES": F.when(F.col("gpus") > 0, F.format_string("cpu=%d,gres/gpu=%d,node=%d", "cpus", "gpus", "n_nodes")).otherwise(F.format_string("cpu=%d,node=%d", "cpus", "n_nodes")),
            "NCPUS": F.col("cpus"), "NNodes": F.col("n_nodes"), "NodeList": F.col("node_list"),
            "SubmitLine": F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("run a.sh"), F.lit("\n"), F.lit("  --second line"))),
        }
    )
    step = _record(
        {
            "JobID": F.concat(F.col("job_id").cast("string"), F.lit("."), F.col("step")),
            "State": F.lit("COMPLETED"), "NTasks": F.col("ntasks"),
            "TotalCPU": _clock(F.col("total_cpu_s")), "SystemCPU": _clock(F.col("system_cpu_s")),
            "MaxRSS": F.col("max_rss_bytes"), "AveRSS": F.col("ave_rss_bytes"),
            "MaxDiskRead": F.col("read_bytes"),
            "TRESUsageOutTot": F.when(F.col("write_bytes").isNotNull(), F.concat(F.lit("cpu=00:01:00,fs/disk="), F.col("write_bytes").cast("string"))),
        }
    )
    rows = j.select("job_id", F.lit(0).cast("long").alias("pos"), job.alias("value"))
    return rows.unionByName(s.select("job_id", "pos", step.alias("value")))


@query
def parse_roundtrip(spark, sf_dir):
    """Format the tables as dump files (compressed, as dumps are kept), read the files back, and roll the steps up."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/dump-{uuid.uuid4().hex}"
    lines = _dump_lines(spark, sf_dir)
    ordered_lines = lines.repartition("job_id").sortWithinPartitions("job_id", "pos")
    with shuffles_removed(spark):
        ordered_lines.select("value").write.option("compression", "gzip").text(path)
    records = dumps.read_records(spark, path)
    # Records are written when they are read: the dump is not needed beside them.
    store.remove(spark, path)
    t = pipeline.normalize_records(records)
    m = job_metrics(t.jobs, t.steps)
    longs = ["job_id", "cpu_count", "node_count", "gpu_count", "mem_limit", "max_rss", "read_bytes", "write_bytes", "step_count"]
    doubles = ["elapsed", "timelimit", "total_cpu", "system_cpu"]
    return m.select(
        *[big(c) for c in longs], *[r6(c) for c in doubles], "name", "user", "partition", "state", "node_list",
        ts("submit"), ts("start"), ts("end"), F.length("submit_line").cast("bigint").alias("submit_chars"),
    )


@query
def requeue_fold(spark, sf_dir):
    """Jobs and their earlier incarnations under one id, some by another user."""
    cols = ["job_id", "cluster", "state", "elapsed_s", "uid", "submit"]
    jobs = P.acct_jobs(spark, sf_dir).select(
        "*", F.lit("7").alias("uid"), F.col("submit_ts").alias("submit")
    ).select(*cols)
    foreign = (F.col("job_id") + F.col("attempt")) % 4 == 0
    tries = P.acct_attempts(spark, sf_dir).select(
        "*", F.when(foreign, "8").otherwise("7").alias("uid"),
        (F.col("end_ts") - F.expr("INTERVAL '10' DAY")).alias("submit"),
    ).select(*cols)
    rows = jobs.unionByName(tries).withColumns(
        {"user": F.lit(None).cast("string"), "src_file": F.lit("d"), "place": F.lit(0)}
    )
    return attach.fold_requeues(rows).select(big("job_id"), "role", big("attempt"), "state", big("elapsed_s"))


@query
def window_scan(spark, sf_dir):
    jobs = tables.jobs_in_window(
        P.jobs(spark, sf_dir), since="1998-01-01", until="1998-07-01T00:00:00",
        job_states=["failed", "timeout"], partition="p1",
    )
    steps = tables.steps_of(P.steps(spark, sf_dir), jobs).groupBy("alloc_id").agg(F.count("*").alias("steps"))
    return jobs.join(steps, "alloc_id").select(big("job_id"), "state", "steps")


@query
def refresh_changed(spark, sf_dir):
    """What a new listing says about stored records."""
    jobs = P.acct_jobs(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"), F.lit(0).alias("pos"), "state", F.col("end_ts").alias("end"),
        F.col("job_id").alias("n"),
    )
    old_state = F.when(F.col("n") % 11 == 0, "RUNNING").otherwise(F.col("state"))
    before = jobs.filter(F.col("n") % 17 != 0).withColumn("state", old_state)
    stored = refresh.fingerprints(before)
    return refresh.plan_refresh(jobs, stored).select(big("job_id"), "action")


@query
def live_reconcile(spark, sf_dir):
    """The queue still knows every second running job."""
    jobs = P.jobs(spark, sf_dir)
    queue = jobs.filter((F.col("state") == "RUNNING") & (text.id_primary("job_id") % 2 == 1))
    live = tables.live_jobs(queue.select(F.concat(F.lit(" "), F.col("job_id")).alias("value")))
    df = refresh.reconcile_live(jobs, live)
    return df.groupBy("state", "live", "open_ended").agg(F.count("*").alias("jobs"))


@query
def live_merge(spark, sf_dir):
    """Every tenth job is still running; its steps are read from live counters."""
    n = text.id_primary("job_id")
    jobs, steps = P.jobs(spark, sf_dir), P.steps(spark, sf_dir)
    jobs = jobs.withColumns(
        {
            "state": F.when(n % 10 == 0, "RUNNING").otherwise(F.col("state")),
            "end": F.when(n % 10 != 0, F.col("end")),
            "open_ended": (n % 10 == 0) | F.col("open_ended"),
        }
    )
    going = n % 10 == 0
    text_rows = steps.filter(going).select(
        F.col("step_id").alias("JobID"), F.col("max_rss").cast("string").alias("MaxRSS"),
        F.lit("").alias("MaxRSSNode"), F.lit("").alias("MaxRSSTask"), F.col("ave_rss").cast("string").alias("AveRSS"),
        F.lit("").alias("MaxVMSize"), F.lit("").alias("MaxPages"),
        _clock(F.col("total_cpu")).alias("AveCPU"), F.col("ntasks").cast("string").alias("NTasks"),
    )
    blank = {c: F.when(~going, F.col(c)) for c in ("max_rss", "ave_rss", "total_cpu", "system_cpu", "user_cpu")}
    steps = steps.withColumns({**blank, "state": F.when(going, "RUNNING")})
    live = tables.live_step_metrics(text_rows)
    m = pipeline.job_metrics(jobs, steps, live_steps=live, reader="u10").filter(F.col("state") == "RUNNING")
    return m.select(big("job_id"), r6("total_cpu"), big("max_rss"), big("ave_rss"), "live_metrics", "foreign_owner")


@query
def partition_ceiling(spark, sf_dir):
    nodes = P.table(spark, sf_dir, "supplier").select(
        F.lit("c1").alias("cluster"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("partition"),
        F.concat((F.col("s_suppkey") % 64 + 1).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("")).alias("cores"),
        F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise((F.col("s_suppkey") * 1000).cast("string")).alias("mem_mb"),
    )
    return tables.partition_ceilings(nodes).select("partition", big("max_cores"), big("max_mem_mb"))


@query
def job_report(spark, sf_dir):
    m = P.metrics(spark, sf_dir)
    report = sinks.job_report(m, P.steps(spark, sf_dir), D.findings(m))
    return report.select(
        F.col("identity.job_id").cast("bigint").alias("job_id"), F.col("outcome.state").alias("state"),
        F.round("timing.elapsed_seconds", 6).alias("elapsed"),
        F.coalesce(F.size("steps"), F.lit(0)).cast("bigint").alias("steps"),
        F.size("findings").cast("bigint").alias("findings"),
        F.get("findings", 0)["code"].alias("first_code"),
        F.get("steps", 0)["step_id"].alias("first_step"),
    )


# -- logs ----------------------------------------------------------------------------------------

def _log_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Jobs with a work directory, and a listing with logs for two of three jobs."""
    jobs = P.jobs(spark, sf_dir).withColumn("work_dir", F.concat(F.lit("/work/"), F.col("user")))
    n = text.id_primary("job_id")
    jobs = jobs.withColumn("std_err", F.when(n % 6 == 1, F.lit("logs/x-%10j.err")))
    named = F.when(n % 3 == 0, F.concat("work_dir", F.lit("/logs/slurm-"), "job_id", F.lit(".out"))).when(
        n % 6 == 1, F.concat("work_dir", F.lit("/logs/x-"), F.lpad("job_id", 10, "0"), F.lit(".err"))
    ).when(n % 6 == 4, F.concat("work_dir", F.lit("/run_"), "job_id", F.lit("_x.log")))
    files = jobs.filter(named.isNotNull()).select(
        named.alias("path"), F.col("end").cast("timestamp").alias("mtime"), n.alias("size")
    )
    return jobs, tables.with_location(files)


@query
def log_name_match(spark, sf_dir):
    jobs, files = _log_tree(spark, sf_dir)
    return logmatch.by_name(jobs, files).select(F.col("alloc_id").cast("bigint").alias("job_id"), "path")


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as jobs over the month of the events, events as files; ten directories."""
    key = F.col("o_orderkey")
    start = F.lit(1704067200000).cast("long") + (key * 7919) % 2592000 * 1000
    end = start + (60 + (key * 31) % 7200) * 1000
    intervals = P.table(spark, sf_dir, "orders").select(
        key.alias("iid"), (F.col("o_custkey") % 10).alias("grp"), (start - 60000).alias("lo"),
        end.alias("mid"), (end + 600000).alias("hi"), F.lit(0).alias("pref"),
    )
    points = P.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pid"), (F.col("user_id") % 10).alias("grp"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("pclass"), F.lit(0).alias("ptie"),
    )
    return intervals, points


@query
def time_window_match(spark, sf_dir):
    left, right = _windows(spark, sf_dir)
    return intervals.window_matches(left, right).select(
        F.col("iid").alias("job_id"), "candidates", F.col("pid").alias("event_id"), F.col("distance").alias("distance_ms")
    )


@query
def greedy_assign(spark, sf_dir):
    left, right = _windows(spark, sf_dir)
    return intervals.greedy_match(left, right).select(
        F.col("iid").alias("job_id"), F.col("pid").alias("event_id"), F.col("distance").alias("distance_ms")
    )


@query
def traceback_markers(spark, sf_dir):
    """Markers and excerpts of a log written for every job."""
    n = F.col("job_id")
    number = lambda m: (n % m).cast("string")
    trace = F.concat(
        F.lit("begin\nTraceback (most recent call last):\n  old\nOldError: x\n"),
        F.lit("[rank0]: Traceback (most recent call last):\n[rank0]:   File a.py, line "), number(50),
        F.lit("\n    one\n\n    two\n    three\n    four\n[rank0]: ImportError: No module named m"), number(7), F.lit("\nend\n"),
    )
    plain = F.concat(F.lit("a\nb  \n\nc\r\nCUDA out of memory "), number(9), F.lit("\nNCCL WARN "), number(5), F.lit("\nd\ne\n\n"))
    logs = P.acct_jobs(spark, sf_dir).select("job_id", F.when(n % 3 == 0, trace).otherwise(plain).alias("log"))
    low = F.lower("log")
    return logs.select(
        "job_id", logtext.has_marker(low, logtext.DEVICE_MEMORY).alias("device_memory"),
        logtext.has_marker(low, logtext.COLLECTIVE).alias("collective"),
        logtext.has_marker(low, logtext.IMPORT).alias("import_error"),
        logtext.traceback_tail("log").alias("traceback"), logtext.last_lines("log").alias("excerpt"),
    )


@query
def log_excerpts(spark, sf_dir):
    """Last lines and markers of every whole document."""
    docs = P.table(spark, sf_dir, "documents")
    low = F.lower("text")
    return docs.select(
        "doc_id", F.md5(logtext.last_lines("text")).alias("excerpt_md5"),
        logtext.has_marker(low, logtext.IMPORT).alias("import_error"),
    )


def queries() -> dict[str, Query]:
    from . import evidence  # noqa: F401  (registers its queries)

    return dict(_QUERIES)
