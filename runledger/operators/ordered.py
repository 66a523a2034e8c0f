"""Ordered analytics over groups of any size.

A window over a group that holds a third of all rows would sort that group in one
task.  Here the order of a group is cut into *chunks* that follow the order (blocks
of ids, days of time); windows run inside a chunk, and only one summary row per
chunk is compared across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe_join

UNBOUNDED = Window.unboundedPreceding


def running_count(df: DataFrame, keys: list[str], chunk: str, order: list[str], n: str, name: str):
    """Sum of ``n`` over all rows up to and including this one, in (chunk, order)."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(UNBOUNDED, 0)
    totals = df.groupBy(*keys, chunk).agg(F.sum(n).alias("_chunk_n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(UNBOUNDED, -1)
    offsets = totals.select(
        *keys, chunk, F.coalesce(F.sum("_chunk_n").over(before), F.lit(0)).alias("_offset")
    )
    local = df.withColumn("_local", F.sum(n).over(inner))
    joined = null_safe_join(local, offsets, [*keys, chunk])
    return joined.withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset")


def value_runs(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, edge: int = 8
) -> DataFrame:
    """Run-length encoding of ``value`` along the order of each group.

    Gives, per group: ``n_rows``, ``n_runs``, ``n_decreases``, and ``walk_runs``: an
    array of (value, n) that is complete when ``n_runs <= edge`` and otherwise starts
    with the first and ends with the last ``edge`` runs.
    """
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(*order)
    marked = df.select(*keys, chunk, *order, F.col(value).alias("_v")).withColumn(
        "_prev", F.lag("_v").over(in_chunk)
    )
    first_row = F.col("_prev").isNull()
    marked = marked.withColumn("_start", (first_row | (F.col("_v") != F.col("_prev"))).cast("int"))
    marked = marked.withColumn(
        "_run", F.sum("_start").over(in_chunk.rowsBetween(UNBOUNDED, 0))
    ).withColumn("_down", F.coalesce(F.col("_v") < F.col("_prev"), F.lit(False)).cast("int"))
    # One row per run inside a chunk; a chunk is bounded, so this stays local.
    runs = marked.groupBy(*keys, chunk, "_run").agg(
        F.max("_v").alias("_v"), F.count("*").alias("_n"), F.sum("_down").alias("_down")
    )
    whole = Window.partitionBy(*keys, chunk)
    runs = runs.withColumn("_runs", F.max("_run").over(whole)).withColumn(
        "_near", (F.col("_run") <= edge + 1) | (F.col("_run") > F.col("_runs") - edge - 1)
    )
    chunks = runs.groupBy(*keys, chunk).agg(
        F.max("_runs").alias("_runs"),
        F.sum("_n").alias("_rows"),
        F.sum("_down").alias("_down"),
        F.min_by("_v", "_run").alias("_first"),
        F.max_by("_v", "_run").alias("_last"),
        F.array_sort(
            F.collect_list(F.when(F.col("_near"), F.struct("_run", "_v", "_n")))
        ).alias("_kept"),
    )
    # Across chunks: at most 2 * (edge + 1) runs per chunk remain.
    across = Window.partitionBy(*keys).orderBy(chunk)
    chunks = chunks.withColumn("_before", F.lag("_last").over(across)).withColumn(
        "_merges", F.coalesce(F.col("_first") == F.col("_before"), F.lit(False)).cast("int")
    )
    totals = chunks.groupBy(*keys).agg(
        F.sum("_rows").alias("n_rows"),
        (F.sum("_runs") - F.sum("_merges")).alias("n_runs"),
        (
            F.sum("_down")
            + F.sum(F.coalesce(F.col("_first") < F.col("_before"), F.lit(False)).cast("int"))
        ).alias("n_decreases"),
    )
    edges = chunks.select(*keys, chunk, "_merges", F.explode("_kept").alias("_r")).select(
        *keys, chunk, F.col("_r._run").alias("_run"), F.col("_r._v").alias("_v"),
        F.col("_r._n").alias("_n"),
        F.when((F.col("_r._run") == 1) & (F.col("_merges") == 1), 0).otherwise(1).alias("_start"),
    )
    order_edges = Window.partitionBy(*keys).orderBy(chunk, "_run").rowsBetween(UNBOUNDED, 0)
    stitched = (
        edges.withColumn("_id", F.sum("_start").over(order_edges))
        .groupBy(*keys, "_id")
        .agg(F.max("_v").alias("value"), F.sum("_n").alias("n"))
    )
    last = Window.partitionBy(*keys)
    stitched = stitched.withColumn("_max", F.max("_id").over(last)).filter(
        (F.col("_id") <= edge) | (F.col("_id") > F.col("_max") - edge)
    )
    listed = stitched.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_id", "value", "n"))).alias("walk_runs")
    )
    return null_safe_join(totals, listed, keys)


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, fraction: float, width: float, name: str
) -> DataFrame:
    """Exact nearest-rank percentile per group, without holding a group in memory.

    Pass one counts rows per value bucket and finds the bucket that holds the wanted
    rank; pass two counts values inside that bucket only.
    """
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_bucket")
    )
    buckets = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_bucket").rowsBetween(UNBOUNDED, 0)
    wanted = F.greatest(F.ceil(F.lit(fraction) * F.sum("_n").over(whole)), F.lit(1).cast("long"))
    target = (
        buckets.withColumn("_want", wanted)
        .withColumn("_upto", F.sum("_n").over(upto))
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(*keys, "_bucket", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_want"))
    )
    values = null_safe_join(rows, target, [*keys, "_bucket"]).groupBy(*keys, "_v", "_want").agg(
        F.count("*").alias("_n")
    )
    seen = Window.partitionBy(*keys).orderBy("_v").rowsBetween(UNBOUNDED, 0)
    return (
        values.withColumn("_upto", F.sum("_n").over(seen))
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(*keys, F.col("_v").alias(name))
    )


def id_chunk(primary: Column, width: int = 65536) -> Column:
    """Blocks of consecutive numeric ids: an order-preserving, bounded chunk."""
    return F.floor(primary / width)
