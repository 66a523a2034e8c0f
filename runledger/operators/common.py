"""Joins, top-N with a remainder, and lineage cuts shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"):
    """Equi join in which NULL keys meet, keeping the left side's key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


#: Rows of a written table that a join may broadcast.
FEW_ROWS = 100_000


def by_rows(df: DataFrame) -> DataFrame:
    """``df``, a table that is cheap to read, as one side of a join: broadcast if it has few rows, otherwise never.

    Spark takes a table's size from its files and the share of its columns that are read.  Many columns without
    values and repeated texts make millions of rows look like a few megabytes, which the driver would then collect."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over the session's number of shuffle partitions, which adaptive execution leaves as it is.

    It joins partitions up to a size of compressed bytes.  Rows that compress well and become wide, like buffers of many
    aggregates, then make groups by the million and a gigabyte in one task."""
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def mark_top(df: DataFrame, order: list[Column], n: int, name: str = "shown") -> DataFrame:
    """Flag the first ``n`` rows of a total order (ascending, ties broken by the caller).

    ``orderBy().limit()`` keeps n rows per task; the n-th row's key then splits the
    rest, so neither the ranking nor the remainder passes through one task.
    """
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    edge = keyed.select("_key").orderBy("_key").limit(n).agg(F.max("_key"))
    return keyed.withColumn(name, F.col("_key") <= edge.scalar()).drop("_key")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"):
    """First ``n`` rows per group.  Spark trims each task to n rows per group before
    the shuffle (window group limit), so a hot group stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, shared by driver and executors.

    Only a session whose executors are threads of the driver (master ``local``) may do
    without: it gets a temporary folder.  Any other session raises ``ValueError``, as each
    executor would write to its own disk and later reads would miss the rows.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written herein removes its shuffle files when it has ended.  Otherwise they stay until the driver happens
    to collect its garbage: those of all steps of a long query lie on disk together."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The result no longer depends on the plan that made it, so it is computed once and
    a lost executor does not replay it.  A written table keeps column pruning and file
    statistics, which lets joins against a small result be broadcast by their size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
