import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from runledger.functions import logpath as lp
from runledger.functions import logtext
from runledger.operators import logmatch
from runledger.plans import evidence
from runledger.sources import tables


@pytest.fixture(scope="module")
def jobs(make_jobs):
    t = "2026-01-01 {}:00".format
    return make_jobs([
        {"id": 1, "std_err": "%x-%4a_%j.err", "work_dir": "/w", "start": t("10:00"), "end": t("11:00")},
        {"id": "60_4", "job_id_raw": "64", "work_dir": "/w", "start": t("10:00"), "end": t("11:00")},
        {"id": 3, "work_dir": "/w/", "start": t("10:00"), "end": t("11:00")},
        {"id": 400, "work_dir": "/w", "name": "mesh", "start": t("12:00"), "end": t("13:00")},
        {"id": 5, "work_dir": "/w", "name": "zz", "start": t("12:00"), "end": t("13:05")},
        {"id": 6, "work_dir": "/w", "name": "Fluid", "start": t("20:00"), "end": t("21:00")},
        {"id": 7, "work_dir": "/none", "submit_line": "sbatch -o 'my out.log' --error=e%A.err x.sh", "start": t("20:00"), "end": t("21:00")},
        {"id": 8, "work_dir": "/w", "start": t("23:00")},
    ])


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("/w/train-0000_1.err", "10:30", 5), ("/w/logs/slurm-60.out", "09:00", 5), ("/w/logs/run_60_4.out", "09:00", 1),
        ("/w/a_3_b.log", "08:00", 5), ("/w/a_33_b.err", "08:00", 5), ("/w/out/x.log", "13:04", 5), ("/w/out/y.err", "13:00", 0),
        ("/w/slurm-any.log", "12:58", 9), ("/w/fluid-run.log", "21:09", 5), ("/w/other.log", "21:00", 5), ("/none/e7.err", "01:00", 5),
        ("/w/late.log", "21:30", 5),
    ]
    df = spark.createDataFrame([(p, f"2026-01-01 {t}:00", s) for p, t, s in rows], "path string, t string, size long")
    return tables.with_location(df.withColumn("mtime", F.col("t").cast("timestamp")).withColumn("tail", F.lit("text")))


def test_assignment(jobs, files):
    got = {r.alloc_id: (r.path, r.inferred) for r in logmatch.assign_logs(jobs, files).collect()}
    assert got == {
        "1": ("/w/train-0000_1.err", False),
        "60_4": ("/w/logs/slurm-60.out", False),  # the conventional name comes before an id in the name
        "3": ("/w/a_3_b.log", False),
        "400": ("/w/out/y.err", True),  # a trusted directory comes first, even when empty
        "5": ("/w/out/x.log", True),
        "6": ("/w/fluid-run.log", True),
        "7": ("/none/e7.err", False),
        "8": (None, False),
    }


def test_given_directory_is_trusted(jobs, files):
    best = {r.alloc_id: r.path for r in logmatch.by_time(jobs.filter("job_id = '6'"), files, ["/w/"]).collect()}
    assert best == {"6": "/w/other.log"}


def test_paths_and_status(jobs, files, values):
    rows = jobs.withColumn("v", lp.pattern_values()).select("job_id", lp.recorded_paths("v").alias("p")).collect()
    paths = {r.job_id: r.p for r in rows}
    assert paths["1"] == ["/w/train-0000_1.err"] and paths["7"] == ["/none/e7.err", "/none/my out.log"] and paths["3"] == []
    assert values(["/a//b/./c/../d", "x/./y", "/"], lp.normal_path("c")) == ["/a/b/d", "x/y", "/"]
    assert values(["a -e x --output=y -ozz -e q", "a -o 'b", "a --output --x", "-e '' -o v"], F.array_join(lp.submit_patterns("c"), "|")) == ["q|x|zz|y", "", "", "v"]
    table = F.create_map(*[F.lit(x) for x in ("j", "12", "u", "", "%", "%", "x", "n")])
    assert values(["a%j", "%5j", "%%j", "%u", "%3x", "50%", ""], lp.expand_pattern("c", table)) == ["a12", "00012", "%j", None, "n", "50%", None]


def test_log_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b+c.out").write_bytes(b"x\r\ny\rz\xff\n")
    (tmp_path / "d" / "b.txt").write_text("no log")
    (tmp_path / "d" / "e.err").write_text("")
    (tmp_path / "d" / "c.log").write_bytes(b"NCCL WARN early\n" + b"h" * 300_000 + b"END")
    rows = {r.name: r for r in tables.log_files(spark, str(tmp_path)).collect()}
    # Spark's file sources skip empty files.
    assert set(rows) == {"a b+c.out", "c.log"}
    assert rows["a b+c.out"].log.excerpt == "x\ny\nz\ufffd" and rows["a b+c.out"].dir == str(tmp_path / "d")
    # However long ago: the whole file counts.
    assert rows["c.log"].log.collective and not rows["c.log"].log.blank and rows["c.log"].size == 300_019
    assert rows["c.log"].log.excerpt.endswith("END")


TRACE = """[rank0]: Traceback (most recent call last):
[rank0]:   File a.py, line 3

    one
    two
    three
    four
[rank0]: ValueError: x
after
"""


@pytest.mark.parametrize("split", ["7", "60", "1000000"])
def test_digests_do_not_depend_on_splits(spark, tmp_path, values, split):
    """Tracebacks over the edges of splits, cut off, repeated, followed by more; as the one-string reading says."""
    logs = {
        "a.log": "begin\n" + TRACE + "x\n" * 20 + TRACE.replace("ValueError", "KeyError") + "\n\ntail 1\ntail 2",
        "b.log": "Traceback (most recent call last):\n  cut off", "c.log": "only\nlines\r\nof\x0ctext  \n\n",
        "d.log": "\n", "e.log": "Traceback (most recent call last):\nImportError: y\nno module named q\nTraceback (most recent call last):\n  a\n  b\nE: z\n",
    }
    for name, text in logs.items():
        (tmp_path / name).write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.name: r.log for r in tables.log_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = values(list(logs.values()), logtext.digest("c"))
    assert got == dict(zip(logs, want, strict=True))


def test_directories_of_a_job(spark):
    """Normal forms are found once per directory, and are those of whole paths."""
    roots = ["/w/", "/", ".", "./a/..", "a//b/.", "/w/logs", "/a/../../b", "x.y", "..", ""]
    df = spark.createDataFrame([(r,) for r in roots], "work_dir string")
    whole = F.array(*[lp.normal_path(F.concat("work_dir", F.lit(f"/{s}" if s else ""))) for s in lp.SUBDIRS])
    got = df.select("work_dir", whole.alias("whole"), lp.searched_dirs([]).alias("own"), lp.scanned_dirs(["/w//logs"]).alias("scanned")).collect()
    for r in got:
        assert r.own == (r.whole if r.work_dir else [])
        rest = [] if not r.work_dir else [(d, bool(s)) for d, s in zip(r.whole, lp.SUBDIRS, strict=True) if d != "/w/logs"]
        assert [tuple(x) for x in r.scanned] == [("/w/logs", True), *rest]


def test_only_groups_with_files_are_swept(jobs, files):
    intervals, points = logmatch.time_sides(jobs, files)
    assert {r.grp for r in intervals.collect()} <= {r.grp for r in points.collect()}
    assert {r.iid for r in intervals.collect()} >= {"5", "6", "400"}


def test_a_log_in_parts_reads_like_one_file(spark, tmp_path):
    text = "a\nTraceback (most recent call last):\n  File x\n    b\nValueError: y\nCUDA out of memory\nlast\n"
    parts = text.splitlines(keepends=True)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "p.txt").write_text(text)
    (tmp_path / "many").mkdir()
    for i, part in enumerate(parts):
        (tmp_path / "many" / f"part-{i:05}.txt").write_text(part)
    rows = {r.name: r for r in tables.log_files(spark, str(tmp_path), "*.txt", in_parts=True).collect()}
    assert rows["one"].log == rows["many"].log and rows["many"].log.traceback.endswith("ValueError: y")
    assert rows["one"].size == rows["many"].size == len(text)


def test_no_task_writes_a_whole_log(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(evidence._written_logs(spark, str(tmp_path)).removeprefix("file:"))
    for shard in range(evidence.SHARDS):
        files = sorted((folder / f"shard={shard}").glob("*.txt"))
        assert len(files) > 1
        lines = "".join(f.read_text() for f in files)
        assert lines.count("some text") == 500
