import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runledger import schema  # noqa: E402
from runledger.sources import dumps  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt")))
        # Tables here are tiny: compiling a plan costs more than interpreting it.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column expression over a list of strings."""

    def run(texts, expression):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
        return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]

    return run


def _typed(spark, rows, struct, defaults):
    rows = [{**defaults, **r} for r in rows]
    names = [f.name for f in struct.fields]
    text = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows]
    df = spark.createDataFrame(text, ", ".join(f"`{n}` string" for n in names))
    return schema.conform(df.coalesce(1), struct)


@pytest.fixture(scope="session")
def make_jobs(spark):
    def build(rows):
        base = {"state": "COMPLETED", "open_ended": False, "live_metrics": False, "foreign_owner": False, "cluster": "c", "name": "train", "user": "ann", "partition": "gpu"}
        rows = [{**r, "job_id": r["id"], "alloc_id": str(r["id"])} for r in rows]
        return _typed(spark, rows, schema.JOBS, base)

    return build


@pytest.fixture(scope="session")
def make_steps(spark):
    def build(rows):
        rows = [
            {**r, "job_id": r["id"], "alloc_id": str(r["id"]), "step_id": f"{r['id']}.{r['step']}", "pos": r.get("pos", i)}
            for i, r in enumerate(rows)
        ]
        return _typed(spark, rows, schema.STEPS, {})

    return build


def record(delimiter=dumps.SAFE_DELIMITER, **fields):
    unknown = set(fields) - set(dumps.FIELDS)
    assert not unknown, unknown
    return delimiter.join(str(fields.get(f, "")) for f in dumps.FIELDS)


@pytest.fixture(scope="session")
def dump_dir(tmp_path_factory):
    def write(files):
        folder = tmp_path_factory.mktemp("dump")
        for name, text in files.items():
            (folder / name).write_text(text, newline="")
        return str(folder)

    return write


__all__ = ["F", "record"]
