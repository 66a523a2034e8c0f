import pytest
from pyspark.sql import functions as F
from runledger.operators import findings as D
from runledger.operators import patterns, reliability, rollup, sizing, workloads
from runledger.operators.common import cut
from runledger.plans import pipeline
from runledger.sources import sinks

G = 2**30


def run(make_jobs, make_steps, jobs, steps=()):
    steps = list(steps) or [{"id": -1, "step": "x"}]
    return cut(rollup.job_metrics(make_jobs(jobs), make_steps(steps)))


def codes(metrics, **kw):
    out = {}
    for r in D.findings(metrics, **kw).orderBy("alloc_id", "position").collect():
        out.setdefault(r.job_id, []).append(r.code)
    return out


def test_rollup_rules(make_jobs, make_steps):
    jobs = [
        {"id": 1, "elapsed": 100, "alloc_cpus": 4, "req_mem_bytes": 50 * G, "req_mem_scope": "node"},
        {"id": 2, "elapsed": 100, "alloc_tres": "cpu=8,mem=16G,node=2", "total_cpu_alloc": 77},
        {"id": 3, "state": "RUNNING", "open_ended": True, "elapsed": 500, "total_cpu_alloc": 5},
        {"id": 4, "elapsed": 0, "req_mem_bytes": G, "req_mem_scope": "cpu", "ncpus": 4, "nnodes": 2},
    ]
    steps = [
        {"id": 1, "step": "batch", "max_rss": 4 * 2**20, "total_cpu": 1, "ntasks": 1, "max_disk_read": 5, "cpu_time": 1000},
        {"id": 1, "step": "extern", "max_rss": 3000 * G, "total_cpu": 900, "max_disk_read": 10**12, "max_rss_node": "nx"},
        {"id": 1, "step": "0", "max_rss": 8 * 2**20, "total_cpu": 2, "ntasks": 4, "ave_rss": 2**20, "tres_in_tot": "fs/disk=0", "max_disk_read": 9, "ave_cpu": 100, "min_cpu": 20, "min_cpu_node": "n2", "min_cpu_task": "3", "max_rss_node": "n1"},
        {"id": 2, "step": "extern", "max_rss": 9 * G, "max_disk_read": 4},
        {"id": 3, "step": "0", "state": "COMPLETED", "max_rss": 5, "total_cpu": 4},
        {"id": 3, "step": "1", "state": "RUNNING", "total_cpu": 0},
    ]
    j, s = make_jobs(jobs), make_steps(steps)
    m = {r.job_id: r for r in rollup.with_places(rollup.job_metrics(j, s), s).collect()}
    one, two, three, four = (m[k] for k in "1234")
    assert (one.total_cpu, one.max_rss, one.max_rss_node, one.cpu_time, one.read_bytes, one.task_count) == (3.0, 8 * 2**20, "n1", 1000.0, 5, 4)
    assert one.rss_step_spread == 2.0 and one.rss_task_imbalance == 8.0 and one.straggler_spread == pytest.approx(0.8)
    assert (one.slowest_node, one.slowest_task) == ("n2", "3")
    # Only the bookkeeping step measured anything: its peak is kept, above the limit.
    assert (two.max_rss, two.mem_limit, two.read_bytes, two.total_cpu, two.cpu_count) == (9 * G, 8 * G, 4, 77.0, 8)
    assert not two.peak_trustworthy and two.io_rate == 0.04
    assert (three.total_cpu, three.max_rss, three.peak_missing_reason) == (None, None, "in_progress_unflushed")
    assert (four.mem_limit_total, four.mem_limit, four.io_rate, four.core_hours) == (4 * G, 2 * G, None, 0.0)


def test_findings_fire(make_jobs, make_steps, spark):
    jobs = [
        {"id": 1, "state": "TIMEOUT", "elapsed": 1826, "timelimit": 1800, "alloc_tres": "gres/gpu=1", "alloc_cpus": 8},
        {"id": 2, "state": "OUT_OF_MEMORY", "elapsed": 600, "alloc_tres": "mem=40G", "alloc_cpus": 4},
        {"id": 3, "elapsed": 6769, "timelimit": 7200, "alloc_tres": "gres/gpu=3,mem=80G", "alloc_cpus": 3},
        {"id": 4, "state": "RUNNING", "open_ended": True, "elapsed": 5439075},
        {"id": 5, "state": "CANCELLED by 0", "uid": "7", "elapsed": 10},
        {"id": 6, "state": "FAILED", "exit_code": 1, "elapsed": 10},
        {"id": 7, "state": "FAILED", "exit_code": 137, "elapsed": 10},
        {"id": 8, "elapsed": 1000, "timelimit": 86400, "alloc_cpus": 16, "alloc_tres": "mem=100G"},
        {"id": 9, "state": "FAILED", "exit_code": 1, "elapsed": 50, "alloc_tres": "gres/gpu=2"},
        {"id": 10, "elapsed": 400, "alloc_cpus": 2, "alloc_tres": "gres/gpu=1"},
        {"id": 11, "state": "NODE_FAIL", "elapsed": 5, "signal": 15}, {"id": 12, "state": "BOOT_FAIL"}, {"id": 13, "state": "DEADLINE", "elapsed": 9},
        {"id": 14, "state": "PREEMPTED", "elapsed": 9}, {"id": 15, "state": "FAILED", "exit_code": 127, "elapsed": 1}, {"id": 16, "elapsed": 100, "alloc_cpus": 8},
    ]
    steps = [
        {"id": 1, "step": "batch", "total_cpu": 0.539}, {"id": 2, "step": "batch", "max_rss": 53741792 * 1024, "total_cpu": 500},
        {"id": 3, "step": "batch", "total_cpu": 19899, "max_rss": 60 * G}, {"id": 8, "step": "batch", "total_cpu": 200, "system_cpu": 90, "max_rss": G, "max_pages": 820000},
        {"id": 10, "step": "0", "total_cpu": 700, "tres_in_ave": "gres/gpuutil=3"},
        {"id": 16, "step": "0", "total_cpu": 700, "ntasks": 8, "ave_cpu": 3600, "min_cpu": 720, "max_disk_read": 200 * G, "max_rss": 4 * G, "ave_rss": G},
    ]
    m = run(make_jobs, make_steps, jobs, steps)
    logs = spark.createDataFrame([("9", "x\nCUDA out of memory\nnccl warn\nImportError: y\nlast")], "alloc_id string, log_text string")
    notes = spark.createDataFrame([("3", "node x fails")], "alloc_id string, node_note string")
    got = codes(m, logs=logs, notes=notes)
    assert got == {
        "1": ["timeout-hang"], "2": ["host-oom"], "3": ["node-history"], "4": ["open-record"], "5": ["cancelled-by-other"],
        "6": ["exit-nonzero-nolog"], "7": ["sigkill", "exit-nonzero-nolog"],
        "8": ["walltime-slack", "memory-slack", "cpu-overrequest", "system-cpu-heavy", "paging"],
        "9": ["cuda-oom", "nccl", "import-error", "log-tail"], "10": ["gpu-idle"], "11": ["node-failed"], "12": ["boot-failed"], "13": ["deadline"],
        "14": ["preempted"], "15": ["command-not-found", "exit-nonzero-nolog"], "16": ["io-heavy", "straggler", "task-memory-imbalance"],
    }
    worst = {r.job_id: r.code for r in D.worst_per_job(D.findings(m, logs=logs)).collect()}
    assert worst["7"] == "sigkill" and worst["8"] == "cpu-overrequest" and worst["9"] == "cuda-oom"
    assert D.strict_failure(D.findings(m)).first().any_critical


def oom_series():
    rows = [("CANCELLED by 1", 48)] + [("OUT_OF_MEMORY", g) for g in (32, 32, 17, 12, 12, 14, 16, 18)] + [("COMPLETED", 32)]
    return [{"id": 100 + i, "state": s, "elapsed": 60, "alloc_tres": f"mem={g}G", "name": f"fit{i}"} for i, (s, g) in enumerate(rows)]


def test_memory_search(make_jobs, make_steps):
    jobs = oom_series()
    for order in (jobs, jobs[::-1]):
        r = patterns.memory_searches(run(make_jobs, make_steps, order)).first()
        assert (r.code, r.severity, r.contradicting_job, r.oom_kills) == ("memory-search", "critical", "109", 8)
        assert r.walk == "32.0 GiB ×2 -> 17.0 GiB -> 12.0 GiB ×2 -> 14.0 GiB -> 16.0 GiB -> 18.0 GiB"
        assert not r.monotone
    same = [{**j, "alloc_tres": "mem=8G"} for j in jobs[1:5]]
    r = patterns.memory_searches(run(make_jobs, make_steps, same)).first()
    assert (r.code, r.severity, r.monotone) == ("memory-unchanged", "warning", True)


def test_repeat_failures_and_label(make_jobs, make_steps):
    jobs = [{"id": 200 + i, "state": "TIMEOUT", "elapsed": 1826, "timelimit": 1800, "name": f"{i}", "alloc_tres": "gres/gpu=1", "start": f"2026-01-{i + 1:02d} 00:00:00"} for i in range(12)]
    steps = [{"id": 200 + i, "step": "batch", "total_cpu": 0.5} for i in range(12)]
    r = patterns.repeat_failures(run(make_jobs, make_steps, jobs, steps)).first()
    assert (r.failures, r.hung, r.dominant_state, r.shared_timelimit, r.severity, r.label) == (12, 12, "TIMEOUT", "00:30:00", "critical", "11 +11")
    assert r.array_job is None and "hung" in r.action
    array = [{**j, "id": f"77_{i}"} for i, j in enumerate(jobs)]
    assert patterns.repeat_failures(run(make_jobs, make_steps, array)).first().array_job == "77"
    assert patterns.repeat_failures(run(make_jobs, make_steps, jobs[:4])).count() == 0


def test_requeues_and_remainder(make_jobs, make_steps):
    jobs = [{"id": 10 * w + i, "name": f"w{'abcdef'[w]}", "elapsed": 10} for w in range(6) for i in range(4)]
    tries = [{"id": j["id"], "state": "NODE_FAIL", "elapsed": 100 + w, "end": "2026-01-01 00:00:00"} for w, j in enumerate(jobs)]
    tries += [{"id": 0, "state": "PREEMPTED", "elapsed": 999999}]
    m, a = run(make_jobs, make_steps, jobs), make_jobs(tries)
    found = patterns.requeues(m, a)
    assert found.count() == 6 and found.filter("workload_name = 'wa'").first().attempts == 4
    report = patterns.patterns(m, a).filter("scope = 'requeue'").orderBy("position").collect()
    assert [r.code for r in report] == ["requeue-repeat"] * 4 + ["requeue-repeat-more"] and report[-1].hits == 8


def test_workloads_and_totals(make_jobs, make_steps):
    jobs = [
        {"id": 1, "name": "a1", "elapsed": 3600, "alloc_cpus": 2, "alloc_tres": "gres/gpu=2", "start": "2026-01-01 00:00:00", "end": "2026-01-01 01:00:00"},
        {"id": 2, "name": "a2", "state": "FAILED", "elapsed": 3600, "alloc_cpus": 2, "alloc_tres": "gres/gpu=1", "start": "2026-01-02 00:00:00", "end": "2026-01-02 01:00:00"},
        {"id": 3, "name": "a3", "state": "RUNNING", "open_ended": True, "elapsed": 5, "alloc_tres": "gres/gpu=1"},
        {"id": 4, "name": "b", "elapsed": None}, {"id": 5, "name": "b", "state": "REVOKED", "elapsed": 4},
    ]
    m = run(make_jobs, make_steps, jobs)
    rows = {r.workload_name: r for r in workloads.workloads(m).collect()}
    a = rows["a#"]
    assert (a.runs, a.failed, a.excluded, a.gpu_hours, a.wasted_gpu_hours, a.cost, a.failure_rate, a.severity) == (2, 1, 1, 3.0, 1.0, 52.0, 0.5, "warn")
    assert (rows["b"].runs, rows["b"].failure_rate, rows["b"].label) == (1, None, "b")
    g = workloads.goodput(m).first()
    assert (g.jobs, g.completed, g.failed, g.unclassified, g.excluded_open_records, g.excluded_no_elapsed) == (3, 1, 1, 1, 1, 1)
    assert g.gpu_goodput == pytest.approx(2 / 3) and g.completion_rate == 0.5
    assert workloads.span_concurrency(m).first().span_hours == 25.0
    assert workloads.goodput(m.filter("false")).first().gpu_goodput is None

    def found(q, mode="all"):
        return {r.workload_name for r in workloads.filter_workloads(workloads.workloads(m, q), mode).collect()}

    assert found("A2") == {"a#"} and found("2026-01-02") == {"a#"} and found("gpu") == {"a#", "b"} and found("", "failed") == {"a#"}
    order = [r.workload_name for r in workloads.sort_workloads(workloads.workloads(m), "recent").collect()]
    assert order == ["a#", "b"]
    tail = workloads.tail_share(workloads.workloads(m), 1).first()
    assert (tail.shown, tail.hidden, tail.hidden_runs) == (1, 1, 1)
    assert workloads.headline(workloads.goodput(m)).first().headline == "1 of 3 jobs failed"
    assert workloads.workload_of(m, workloads.workloads(m), "2").first().workload_name == "a#"


def test_sizing(make_jobs, make_steps, spark):
    jobs = [{"id": i, "elapsed": 1000 + 10 * i, "timelimit": 36000, "alloc_cpus": 32, "alloc_tres": "mem=100G"} for i in range(4)]
    steps = [{"id": i, "step": "0", "total_cpu": 2000, "max_rss": 10 * G} for i in range(4)]
    m = run(make_jobs, make_steps, jobs, steps)
    rows = {r.flag: r for r in sizing.advice(m).collect()}
    assert (rows["--time"].verdict, rows["--time"].suggestion, rows["--time"].target) == ("lower", "00:25:00", 1500.0)
    assert (rows["--mem"].verdict, rows["--mem"].suggestion) == ("lower", "13G")
    assert (rows["--cpus-per-task"].verdict, rows["--cpus-per-task"].suggestion) == ("lower", "3")
    assert sorted(r.line for r in sizing.directive_lines(sizing.advice(m)).collect())[0] == "#SBATCH --cpus-per-task=3"
    site = spark.createDataFrame([("c", True, 600)], "cluster string, from_cgroup boolean, sampling_seconds int")
    assert "Thinly sampled" in {r.flag: r for r in sizing.advice(m, site).collect()}["--mem"].caution
    hung = [{"id": i, "state": "TIMEOUT", "elapsed": 7200, "timelimit": 7200} for i in range(4)]
    quiet = [{"id": i, "step": "0", "total_cpu": 0.1} for i in range(4)]
    assert {r.flag: r.verdict for r in sizing.advice(run(make_jobs, make_steps, hung, quiet)).collect()}["--time"] == "unknown"
    killed = [{**j, "state": "OUT_OF_MEMORY"} for j in jobs]
    assert {r.flag: r.suggestion for r in sizing.advice(run(make_jobs, make_steps, killed)).collect()}["--mem"] == "130G"
    busy = run(make_jobs, make_steps, jobs, [{"id": i, "step": "0", "total_cpu": 32 * 1000} for i in range(4)])
    limit = spark.createDataFrame([("c", "gpu", 32)], "cluster string, partition string, max_cores long")
    assert {r.flag: r.verdict for r in sizing.advice(busy, ceilings=limit).collect()}["--cpus-per-task"] == "capped"
    assert {r.verdict for r in sizing.advice(run(make_jobs, make_steps, jobs[:2])).collect()} == {"unknown"}


def test_nodes_and_notes(make_jobs, make_steps):
    jobs = [{"id": 1000 * n + i, "state": "FAILED" if (i % 10 < (6 if n == 1 else 1)) else "COMPLETED", "elapsed": 60, "node_list": f"n{n}"} for n in range(4) for i in range(60)]
    jobs += [{"id": 9000 + i, "state": "CANCELLED", "elapsed": 60, "node_list": "n2"} for i in range(50)]
    m = run(make_jobs, make_steps, jobs)
    rates = reliability.node_rates(m)
    got = {r.node: (r.verdict, r.trials) for r in rates.collect()}
    assert got["n1"] == ("worse", 60) and got["n2"][1] == 60
    ex = reliability.suggest_exclude(rates).first()
    assert (ex.exclude, ex.shown, ex.left_out) == ("n1", 1, 0)
    notes = reliability.node_notes(m)
    assert notes.count() == 60 and notes.first().node_note.startswith("n1: 36 of 60 placements failed")
    assert reliability.dominant_workload(m, "failure").first().label == "train"
    assert reliability.node_notes(m.limit(15), m.limit(15)).count() == 0


def test_job_report(make_jobs, make_steps, spark, tmp_path):
    jobs = make_jobs([{"id": 1, "state": "FAILED", "exit_code": 1, "elapsed": 10, "work_dir": "/w", "std_err": "logs/%j.err"}])
    steps = make_steps([{"id": 1, "step": "batch", "total_cpu": 3}, {"id": 1, "step": "0", "total_cpu": 4}])
    m = rollup.job_metrics(jobs, steps)
    files = spark.createDataFrame([("/w/logs/9.err", "/w/logs", "9.err", None, 5, "x")], "path string, dir string, name string, mtime timestamp, size long, tail string")
    report = pipeline.post_mortem(m, steps, m, files=files)
    r = report.first()
    assert [s.step_id for s in r.steps] == ["1.batch", "1.0"] and r.outcome.state == "FAILED" and r.memory.peak_bytes is None
    assert [f.code for f in r.findings] == ["exit-nonzero-nolog"] and (r.log_expected.path, r.log_expected.status) == ("/w/logs/1.err", "absent")
    sinks.write_json(report, str(tmp_path / "j"))
    assert '"peak_bytes":null' in spark.read.text(str(tmp_path / "j")).first().value
    assert sum(len(v) for v in sinks.SECTIONS.values()) + 1 >= 95 and len(sinks.STEP_FIELDS) == 40


def test_workloads_without_a_stamp_are_the_tail_of_recent(spark):
    rows = [("a", None, 5.0), ("b", "2026-01-02 00:00:00", 1.0), ("c", "2026-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "workload_name string, last_seen string, cost double").withColumns(
        {"last_seen": F.col("last_seen").cast("timestamp_ntz"), **{k: F.lit("x") for k in workloads.KEY if k != "workload_name"}, "runs": F.lit(1), "failed": F.lit(0), "problems": F.lit(0)}
    )
    assert [r.workload_name for r in workloads.sort_workloads(df, "recent").collect()] == ["b", "c", "a"]
    marked = workloads.mark_top(df, workloads.workload_order("recent"), 2)
    assert {r.workload_name for r in marked.filter("shown").collect()} == {"b", "c"}


def test_steps_are_dealt_before_they_are_aggregated(make_steps):
    """Adaptive execution would bring them into one task by their compressed size."""
    steps = make_steps([{"id": i, "step": s, "max_rss": 10 * i + s, "total_cpu": 1.0} for i in range(1, 41) for s in (0, 1, 2)])
    rolled = rollup.step_rollup(steps)
    assert rolled.rdd.getNumPartitions() > 1
    assert [tuple(r) for r in rolled.select("alloc_id", "step_count", "s_peak", "s_total_cpu").collect()].count(("7", 3, 72, 3.0)) == 1


def test_findings_of_some_codes(make_jobs, make_steps):
    jobs = make_jobs([
        {"id": 1, "state": "CANCELLED by 0", "uid": "5", "elapsed": 9000.0, "timelimit": 20000.0, "alloc_cpus": 8},
        {"id": 2, "state": "FAILED", "exit_code": 137, "elapsed": 9000.0, "alloc_cpus": 8},
        {"id": 3, "elapsed": 9000.0, "timelimit": 90000.0, "alloc_cpus": 8},
    ])
    m = rollup.job_metrics(jobs, make_steps([{"id": 3, "step": "0", "total_cpu": 5000.0}]))
    codes = ["cancelled-by-other", "sigkill"]
    told = ["job_id", "code", "severity", "title", "evidence", "action"]
    want = sorted(tuple(r) for r in D.findings(m).filter(F.col("code").isin(codes)).select(*told).collect())
    some = D.findings(m, codes=codes)
    assert want and sorted(tuple(r) for r in some.select(*told).collect()) == want
    # The texts of other rules are not formed.
    assert "Most cores were idle" not in some._jdf.queryExecution().optimizedPlan().toString()
