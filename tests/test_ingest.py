import os
import re

import pytest
from conftest import record
from pyspark.sql import functions as F
from runledger import schema
from runledger.operators import attach, common, refresh, rollup, store
from runledger.plans import pipeline
from runledger.sources import dumps, tables
from runledger.streaming import ingest

D = dumps.SAFE_DELIMITER


def job(jid, **kw):
    base = {"JobName": "n", "User": "ann", "UID": "5", "Cluster": "c1", "State": "COMPLETED", "Submit": "2026-01-01T00:00:00", "Start": "2026-01-01T00:01:00", "End": "2026-01-01T01:01:00", "Elapsed": "01:00:00"}
    return record(JobID=jid, **{**base, **kw})


DUMP = "\n".join(
    [
        "preamble that is no record",
        record(JobID="10.0", TotalCPU="00:07.000"),  # before any allocation row of its id
        job("10", SubmitLine="sbatch a.sh\n--second line\n", ReqMem="4Gn", TimelimitRaw="120", Reserved="00:10"),
        record(JobID="10.batch", TotalCPU="00:05.500", MaxRSS="100K"),
        "continued text",
        job("11", Submit="2026-01-01T00:00:00", State="NODE_FAIL"),
        record(JobID="11.0", TotalCPU="00:01.000"),
        job("11", Submit="2026-01-02T00:00:00", State="COMPLETED"),
        record(JobID="11.0", TotalCPU="00:02.000"),
        job("12", Submit="2026-01-01T00:00:00", UID="9", User="bob"),
        job("12", Submit="2026-01-03T00:00:00", UID="5"),
        job("13") + D + "extra",
        "14" + D + "raw" + D + "short",
        record(JobID="15.0", TotalCPU="1"),  # no allocation row at all
        job("16", State="RUNNING", End="Unknown", Elapsed="62-22:51:15"),
        job("17", State="FAILED"),
        job("17", State="OUT_OF_ME+"),  # the same allocation again: replaces it
        "",
    ]
)


@pytest.fixture(scope="module")
def tables_(spark, dump_dir):
    return pipeline.normalize(spark, dump_dir({"a.txt": DUMP}))


def test_records_and_rejects(tables_):
    jobs = {r.job_id: r for r in tables_.jobs.collect()}
    assert set(jobs) == {"10", "11", "12", "14", "16", "17"}
    assert jobs["10"].submit_line.startswith("sbatch a.sh\n--second line")
    assert (jobs["10"].timelimit, jobs["10"].req_mem_bytes, jobs["10"].req_mem_scope, jobs["10"].queue_wait) == (7200.0, 4 * 2**30, "node", 10.0)
    assert jobs["14"].state is None and jobs["14"].name == "short"
    assert jobs["16"].open_ended and jobs["16"].end is None and not jobs["10"].open_ended
    assert jobs["17"].state == "OUT_OF_MEMORY"
    assert [(r.reason, r.records) for r in dumps.reject_counts(tables_.rejects).collect()] == [("extra_fields", 1)]


def test_steps_follow_their_allocation(tables_):
    steps = {(r.step_id, str(r.submit)): r.total_cpu for r in tables_.steps.collect()}
    assert steps == {
        ("10.0", "2026-01-01 00:00:00"): 7.0, ("10.batch", "2026-01-01 00:00:00"): 5.5,
        ("11.0", "2026-01-01 00:00:00"): 1.0, ("11.0", "2026-01-02 00:00:00"): 2.0,
    }


def test_requeue_folds_and_recycled_id_does_not(tables_):
    assert [(r.job_id, r.state, r.attempt) for r in tables_.attempts.collect()] == [("11", "NODE_FAIL", 1)]
    assert [(r.job_id, r.user) for r in tables_.others.collect()] == [("12", "bob")]


def test_metrics_use_the_newest_run(tables_):
    m = {r.job_id: r for r in rollup.job_metrics(tables_.jobs, tables_.steps).collect()}
    assert m["10"].total_cpu == 12.5 and m["11"].total_cpu == 2.0 and m["12"].total_cpu is None
    assert m["10"].max_rss == 102400


@pytest.mark.parametrize("split", ["40", "900", "100000"])
def test_records_do_not_depend_on_splits(spark, dump_dir, split):
    """Records with line breaks and carriage returns inside, cut at any byte, as a plain reading gives them."""
    odd = "junk before\n" + DUMP.replace("\n", "\r\n", 3) + "\n" + record(JobID="77", SubmitLine="a\rb\n\n  c\r\n d") + "\n"
    folder = dump_dir({"a.txt": odd, "b.txt": DUMP.replace("10", "20"), "c.txt": "no record\nat all", "d.txt": ""})
    opens = re.compile(r"[ \t]*[0-9][^\s\x1f]*[ \t]*\x1f")
    want = []
    for name in "abcd":
        text = open(f"{folder}/{name}.txt", newline="").read()
        held = None
        for line in text.split("\n")[: None if not text.endswith("\n") else -1]:
            if opens.match(line):
                held = len(want)
                want.append((name, line))
            elif held is not None:
                want[held] = (name, want[held][1] + "\n" + line)
    want = [(n, r.removesuffix("\r")) for n, r in want]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = dumps.read_records(spark, folder).orderBy("src_file", "src_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.src_file[-5], r.record) for r in rows] == want
    assert len({(r.src_file, r.src_pos) for r in rows}) == len(rows)


def test_later_dump_replaces_earlier(spark, dump_dir):
    first = "\n".join([job("1", State="RUNNING", End="Unknown"), record(JobID="1.0", TotalCPU="1")])
    second = "\n".join([job("1"), record(JobID="1.0", TotalCPU="9"), record(JobID="1.1", TotalCPU="9")])
    t = pipeline.normalize(spark, dump_dir({"d1.txt": first, "d2.txt": second}))
    assert [r.state for r in t.jobs.collect()] == ["COMPLETED"]
    assert sorted(r.total_cpu for r in t.steps.collect()) == [9.0, 9.0]


def test_the_file_written_later_wins_whatever_its_name(spark, dump_dir):
    folder = dump_dir({"dump-9.txt": job("1", State="RUNNING", End="Unknown"), "dump-10.txt": job("1")})
    os.utime(f"{folder}/dump-9.txt", (1_000_000, 1_000_000))
    assert [r.state for r in pipeline.normalize(spark, folder).jobs.collect()] == ["COMPLETED"]


def test_two_clusters_share_an_id_and_a_submit_stamp(spark, dump_dir):
    lines = [
        job("1", Cluster="a", User="ann"), record(JobID="1.0", TotalCPU="1", Cluster="a"), job("1", Cluster="b", User="bob"),
        record(JobID="1.0", TotalCPU="9", Cluster="b"), record(JobID="1.1", TotalCPU="9", Cluster="a"),
    ]
    t = pipeline.normalize(spark, dump_dir({"d.txt": "\n".join(lines)}))
    found = {r.cluster: r.alloc_id for df in (t.jobs, t.others) for r in df.collect()}
    assert set(found) == {"a", "b"} and len(set(found.values())) == 2
    steps = sorted((r.alloc_id, r.step_id, r.total_cpu) for r in t.steps.collect())
    assert steps == sorted([(found["a"], "1.0", 1.0), (found["a"], "1.1", 9.0), (found["b"], "1.0", 9.0)])


def test_schema_resolution():
    assert dumps.resolve_fields() == dumps.FIELDS
    some = dumps.resolve_fields({"jobid", "planned", "state"})
    assert "Planned" in some and "Reserved" not in some and "MaxRSS" in some and "StdOut" not in some


def test_renamed_field_is_read(spark, dump_dir):
    fields = ["JobID", "State", "Planned"]
    t = pipeline.normalize(spark, dump_dir({"a": "7|COMPLETED|00:30\n"}), fields, "|")
    assert t.jobs.first().queue_wait == 30.0


def test_streaming_ingest(spark, dump_dir, tmp_path):
    out = str(tmp_path / "out")
    q = ingest.start_ingest(spark, dump_dir({"a.txt": DUMP}), out, str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    got = ingest.read_tables(spark, out)
    assert got["jobs"].count() == 6 and got["attempts"].count() == 1 and spark.read.parquet(f"{out}/rejects").count() == 1


def test_batches_fold_as_one_run_does(spark, dump_dir, tmp_path):
    """A requeue in a later batch, a later dump of an earlier job, a step that comes late, and a batch replayed."""
    first = "\n".join([job("1", State="NODE_FAIL"), record(JobID="1.0", TotalCPU="1"), job("2", State="RUNNING", End="Unknown"), job("9", UID="8", User="eve")])
    second = "\n".join([job("1", Submit="2026-01-02T00:00:00"), record(JobID="1.0", TotalCPU="5"), job("2"), record(JobID="2.batch", TotalCPU="3"), job("9", Submit="2026-01-04T00:00:00")])
    folder = dump_dir({"d1.txt": first, "d2.txt": second, "d3.txt": job("7", Submit="2026-01-09T00:00:00")})
    for i in (1, 2, 3):
        os.utime(f"{folder}/d{i}.txt", (1_000_000 * i, 1_000_000 * i))
    out = str(tmp_path / "out")

    def fold(number):
        ingest.fold_batch(spark, dumps.read_records(spark, f"{folder}/d{number}.txt"), out, number)

    def listed(df):
        return sorted(map(repr, df.select(sorted(df.columns)).collect()))

    fold(1)
    kept = store.manifest(spark, f"{out}/jobs").days
    fold(2), fold(3), fold(2)
    want, got = pipeline.normalize(spark, folder), ingest.read_tables(spark, out)
    for name in ingest.TABLES:
        assert listed(got[name]) == listed(getattr(want, name)), name
    assert got["attempts"].count() == 1 and got["others"].count() == 1 and kept


def test_a_replayed_batch_is_not_folded_again_and_absent_fields_take_no_place(spark, dump_dir, tmp_path, monkeypatch):
    """A batch is marked when it is folded: with the same records it is in the tables, with others it is folded anew.
    Columns that no batch has a field for are in no file, and NULL when they are read; a later batch may have them."""
    folds, attach_ = [], ingest.attach.attach
    monkeypatch.setattr(ingest.attach, "attach", lambda rows: folds.append(rows.columns) or attach_(rows))
    few = ["JobID", "Cluster", "State", "Submit"]
    folder = dump_dir({"a": "1|c|FAILED|2026-01-01T00:00:00\n1.0|c|COMPLETED|\n", "b": "2|c|COMPLETED|2026-01-02T00:00:00\n", "c": "3|c|COMPLETED|2026-01-01T00:00:00|train\n"})
    out = str(tmp_path / "out")

    def fold(name, number, fields=few):
        ingest.fold_batch(spark, dumps.read_records(spark, f"{folder}/{name}", "|"), out, number, fields, "|")

    fold("a", 0), fold("b", 1), fold("a", 0)
    assert len(folds) == 2 and "name" not in folds[0] and len(folds[0]) < 30
    t = ingest.read_tables(spark, out)
    assert {r.job_id: (r.state, r.name, r.live) for r in t["jobs"].collect()} == {"1": ("FAILED", None, None), "2": ("COMPLETED", None, None)}
    assert t["jobs"].columns == schema.JOBS.names and t["steps"].columns == schema.STEPS.names and t["steps"].count() == 1
    days = store.manifest(spark, f"{out}/jobs")
    assert "name" not in days.written and "name" not in spark.read.parquet(days.days["2026-01-01"]).columns
    fold("c", 2, [*few, "JobName"])
    assert {r.job_id: r.name for r in ingest.read_tables(spark, out)["jobs"].collect()} == {"1": None, "2": None, "3": "train"}
    fold("b", 0)
    assert len(folds) == 4


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They would lie on disk beside those of all later steps."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before = {f.getName() for f in _files(disk)}
    table = common.cut(spark.range(1000).repartition(3, "id"))
    assert not [f.getName() for f in _files(disk) if f.getName().startswith("shuffle") and f.getName() not in before and f.length()]
    assert table.count() == 1000 and spark.conf.get(common._CLEANUP, "false") == "false"


def _files(disk):
    found = disk.getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_records_are_dealt_by_job_before_they_are_typed(spark, dump_dir):
    """Text is shuffled once, not ninety columns, and gives the same entries."""
    records = dumps.read_records(spark, dump_dir({"a": DUMP}))
    plain, dealt = (attach.attach(dumps.entries(records, by_job=b)[0], b) for b in (False, True))
    assert sorted(map(repr, dealt.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(job_id")
    assert len(plan) == 2 and "record" in plan[1] and "max_rss" not in plan[1]


def test_window_and_bounds(spark, make_jobs, make_steps):
    jobs = make_jobs([
        {"id": 1, "start": "2026-01-01 00:00:00", "end": "2026-01-02 00:00:00", "state": "FAILED"},
        {"id": 2, "start": "2026-01-05 00:00:00", "end": "2026-01-06 00:00:00", "user": "bob"},
        {"id": 3, "start": "2026-01-05 00:00:00", "state": "RUNNING", "open_ended": True},
    ])

    def ids(**kw):
        return sorted(r.job_id for r in tables.jobs_in_window(jobs, **kw).collect())

    assert ids(since="2026-01-03") == ["2", "3"]
    assert ids(until="2026-01-03") == ["1"]
    assert ids(users=["bob"]) == ["2"] and ids(job_states=["failed"]) == ["1"] and ids(job_ids=[1, 2]) == ["1", "2"]
    steps = make_steps([{"id": 1, "step": "0"}, {"id": 2, "step": "0"}, {"id": 2, "step": "1"}])
    assert tables.steps_of(steps, jobs.filter("job_id = '2'")).count() == 2
    gap = spark.range(1).select((tables.time_bound("now") - tables.time_bound("-7days")).alias("d")).first().d
    assert abs(gap.total_seconds() - 7 * 86400) < 5


def test_live_queue_and_reconcile(spark, make_jobs):
    lines = spark.createDataFrame([(" 5 ",), ("900_[5-7%2]",), ("",)], "value string")
    live = tables.live_jobs(lines)
    assert sorted(r.job_id for r in live.collect()) == ["5", "900_5", "900_6", "900_7", "900_[5-7%2]"]
    jobs = make_jobs([{"id": 5, "state": "RUNNING", "open_ended": True}, {"id": 6, "state": "RUNNING", "open_ended": True}, {"id": 7}])
    got = {r.job_id: (r.live, r.open_ended) for r in refresh.reconcile_live(jobs, live).collect()}
    assert got == {"5": (True, True), "6": (False, True), "7": (None, False)}
    assert refresh.reconcile_live(jobs, None) is jobs


def test_live_metrics(spark, make_jobs, make_steps):
    raw = spark.createDataFrame(
        [("5.0", "10K", "n1", "0", "5K", "", "", "00:10:00", "3"), ("5.batch", "", "", "", "", "", "", "9999-00:00:00", ""), ("5", "1K", "", "", "", "", "", "", ""), ("6.0", "1K", "", "", "", "", "", "", "")],
        "JobID string, MaxRSS string, MaxRSSNode string, MaxRSSTask string, AveRSS string, MaxVMSize string, MaxPages string, AveCPU string, NTasks string",
    )
    live = tables.live_step_metrics(raw)
    assert sorted(r.step_id for r in live.collect()) == ["5.0", "6.0"]
    jobs = make_jobs([{"id": 5, "state": "RUNNING", "open_ended": True, "elapsed": 900, "alloc_cpus": 4}, {"id": 6, "state": "RUNNING", "user": "bob"}])
    steps = make_steps([
        {"id": 5, "step": "0", "state": "RUNNING", "total_cpu": 0}, {"id": 5, "step": "1", "state": "COMPLETED", "max_rss": 2**40},
        {"id": 6, "step": "0", "state": "RUNNING"},
    ])
    m = {r.job_id: r for r in pipeline.job_metrics(jobs, steps, live_steps=live, reader="ann").collect()}
    assert (m["5"].total_cpu, m["5"].max_rss, m["5"].live_metrics, m["5"].peak_source) == (1800.0, 10240, True, "live reading")
    assert (m["6"].foreign_owner, m["6"].max_rss, m["6"].peak_missing_reason) == (True, None, "foreign_owner")


def test_site_and_ceilings(spark):
    rows = [("c1", "JobAcctGatherType", "jobacct_gather/cgroup"), ("c1", "AccountingStorageTRES", "cpu,gres/gpu,gres/gpuutil"), ("c1", "JobAcctGatherFrequency", "network=60,task=30"), ("c2", "JobAcctGatherFrequency", "45"), ("c3", "JobAcctGatherFrequency", "(null)"), ("c3", "JobAcctGatherType", "jobacct_gather/linux")]
    site = {r.cluster: r for r in tables.site_config(spark.createDataFrame(rows, "cluster string, key string, value string")).collect()}
    assert (site["c1"].sampling_seconds, site["c1"].from_cgroup, site["c1"].tracks_gpu, site["c1"].tracks_gpu_utilization) == (30, True, True, True)
    assert (site["c2"].sampling_seconds, site["c2"].from_cgroup, site["c2"].tracks_gpu) == (45, None, None)
    assert (site["c3"].sampling_seconds, site["c3"].from_cgroup) == (None, False)
    nodes = spark.createDataFrame([("c", "p", "64+", "1000"), ("c", "p", "48", "n/a"), ("c", "q", "x", "")], "cluster string, partition string, cores string, mem_mb string")
    got = {r.partition: (r.max_cores, r.max_mem_mb) for r in tables.partition_ceilings(nodes).collect()}
    assert got == {"p": (64, 1000), "q": (None, None)}


def test_refresh(spark, make_jobs, tmp_path):
    listing = spark.createDataFrame([("1", 0, "COMPLETED", "a"), ("2", 0, "FAILED", "b"), ("3", 0, "RUNNING", None), ("4", 0, "COMPLETED", "d")], "job_id string, pos int, state string, end string")
    prints = refresh.fingerprints(listing)
    old = make_jobs([{"id": 1, "end": "2026-01-01 00:00:00"}, {"id": 2, "state": "RUNNING", "end": "2026-01-01 00:00:00"}, {"id": 9, "end": "2026-01-02 00:00:00"}])
    changed = refresh.fingerprints(listing.replace("FAILED", "RUNNING", ["state"]).unionByName(listing.limit(1).withColumn("job_id", F.lit("9"))))
    # A listing without clusters is of one cluster, as is the store it belongs to.
    old = old.withColumn("cluster", F.lit(None).cast("string"))
    stored = old.join(changed.drop("cluster"), "job_id")
    actions = {r.job_id: r.action for r in refresh.plan_refresh(listing, stored).collect()}
    assert actions == {"1": "reuse", "2": "changed", "3": "new", "4": "new"}
    fresh = make_jobs([{"id": 2, "state": "FAILED", "end": "2026-01-03 00:00:00"}, {"id": 3, "state": "RUNNING", "open_ended": True}, {"id": 4, "end": "2026-01-03 00:00:00"}]).withColumn("cluster", F.lit(None).cast("string"))
    content = refresh.refresh(listing, stored, fresh)
    assert sorted((r.job_id, r.state) for r in content.collect()) == [("1", "COMPLETED"), ("2", "FAILED"), ("4", "COMPLETED"), ("9", "COMPLETED")]
    assert prints.count() == 4


def _listing(spark, rows):
    return spark.createDataFrame(rows, "cluster string, job_id string, pos int, state string, end string")


def test_refresh_store(spark, make_jobs, tmp_path):
    path = str(tmp_path / "s")
    first = [("c", "1", 0, "COMPLETED", "a"), ("c", "2", 0, "COMPLETED", "b"), ("c", "3", 0, "RUNNING", None)]
    jobs = [{"id": 1, "end": "2026-01-01 10:00:00"}, {"id": 2, "end": "2026-01-02 10:00:00"}, {"id": 3, "state": "RUNNING", "open_ended": True}]
    assert refresh.read_store(spark, path) is None
    assert refresh.refresh_store(spark, path, _listing(spark, first), make_jobs(jobs)) == ["2026-01-01", "2026-01-02"]
    before = store.manifest(spark, path)
    # 1 moves to another day, 3 ends; 2 is as it was, and its day keeps its files.
    second = [("c", "1", 0, "COMPLETED", "z"), ("c", "2", 0, "COMPLETED", "b"), ("c", "3", 0, "FAILED", "q")]
    jobs[0]["end"], jobs[2] = "2026-01-03 10:00:00", {"id": 3, "state": "FAILED", "end": "2026-01-03 11:00:00"}
    assert refresh.refresh_store(spark, path, _listing(spark, second), make_jobs(jobs)) == ["2026-01-01", "2026-01-03"]
    after = store.manifest(spark, path)
    assert after.version == 2 and set(after.days) == {"2026-01-02", "2026-01-03"} and after.days["2026-01-02"] == before.days["2026-01-02"]
    rows = {r.job_id: (r.state, str(r.end)) for r in refresh.read_store(spark, path).collect()}
    assert rows == {"1": ("COMPLETED", "2026-01-03 10:00:00"), "2": ("COMPLETED", "2026-01-02 10:00:00"), "3": ("FAILED", "2026-01-03 11:00:00")}
    assert [r.job_id for r in refresh.read_store(spark, path, until="2026-01-02").collect()] == ["2"]
    # The same listing again changes no day; an old version can still be read until it is cleared away.
    assert refresh.refresh_store(spark, path, _listing(spark, second), make_jobs(jobs)) == []
    assert store.read(spark, path, version=1).count() == 2
    assert [f for f in store.vacuum(spark, path, keep=1)] == sorted([before.days["2026-01-01"]])
    assert refresh.read_store(spark, path).count() == 3


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_is_never_broadcast(spark, make_jobs, monkeypatch):
    # A table's files tell little of its rows: millions of stored jobs may take a few megabytes.
    listing = _listing(spark, [("c", str(i), 0, "COMPLETED", "a") for i in range(5)])
    stored = common.cut(make_jobs([{"id": i, "cluster": "c"} for i in range(5)]).join(refresh.fingerprints(listing), ["cluster", "job_id"]))
    assert "Broadcast" in _physical(listing.join(stored.select("job_id"), "job_id", "left"))
    assert "Broadcast" not in _physical(refresh.plan_refresh(listing, stored))
    for few, broadcast in ((5, True), (4, False)):
        monkeypatch.setattr(common, "FEW_ROWS", few)
        assert ("Broadcast" in _physical(refresh._added(refresh.plan_refresh(listing, stored), stored.drop("fingerprint")))) == broadcast


def test_refresh_store_tells_clusters_apart(spark, make_jobs, tmp_path):
    path = str(tmp_path / "s")
    both = [("a", "1", 0, "COMPLETED", "x"), ("b", "1", 0, "COMPLETED", "x")]
    jobs = [{"id": 1, "cluster": "a", "user": "ann", "end": "2026-01-01 10:00:00"}, {"id": 1, "cluster": "b", "user": "bob", "end": "2026-01-01 10:00:00"}]
    refresh.refresh_store(spark, path, _listing(spark, both), make_jobs(jobs))
    jobs[0]["user"] = "eve"
    refresh.refresh_store(spark, path, _listing(spark, [("a", "1", 0, "COMPLETED", "y"), both[1]]), make_jobs(jobs[:1]))
    assert sorted((r.cluster, r.user) for r in refresh.read_store(spark, path).collect()) == [("a", "eve"), ("b", "bob")]


def test_a_store_has_one_writer_per_version(spark, make_jobs, tmp_path):
    path = str(tmp_path / "s")
    jobs = make_jobs([{"id": 1, "end": "2026-01-01 10:00:00"}])
    store.replace(spark, path, jobs, jobs, ["job_id"], F.col("end"))
    found = store.manifest(spark, path)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(spark, path, found)
    assert store.manifest(spark, path) == found
    # All records of a day gone, and none left at all: an empty table with the columns of the store.
    assert store.replace(spark, path, jobs.limit(0), jobs, ["job_id"], F.col("end")) == ["2026-01-01"]
    assert store.read(spark, path).count() == 0 and store.read(spark, path).columns == jobs.columns


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_windows_carry_few_columns(spark, dump_dir):
    """A window over ninety columns copies each of them for every row, in code too long for the JIT."""
    records = dumps.read_records(spark, dump_dir({"a": DUMP}))
    typed, _ = dumps.entries(records)
    attached = attach.attach(typed)
    for df in (attached, attach.job_tables(common.cut(attached))[0]):
        widths = [n.output().size() for n in _nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
        assert widths and max(widths) <= 20


def test_attachment_is_dealt(spark, dump_dir):
    """Adaptive execution joins partitions by compressed bytes, and rows become many times as wide in a sort."""
    typed, _ = dumps.entries(dumps.read_records(spark, dump_dir({"a": DUMP})))
    plan = attach.attach(typed)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[job_id#\d+\], \d+", plan)


def test_lines_pass_through_python_once(spark, dump_dir):
    records = dumps.read_records(spark, dump_dir({"a": DUMP}))
    assert "MapInArrow" not in records._jdf.queryExecution().optimizedPlan().toString()
