"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's key hash.  It starts with one bucket;
a bucket whose rows exceed the byte limit is split on one more bit, all others stay, until
every bucket fits.  Here all splits of one round are worked out from byte sums per cell
(a cell is a prefix a few bits finer than needed); only cells that are still too large are
cut finer in a further round.  A bucket of one single key cannot be split by its hash: its
rows are dealt over overflow pages by running byte sums.

Nulls: a null key hashes as the empty string, a null text has no bytes.  An empty table
gives no rows.  Repeated keys and rows go to one bucket (or its pages).  A row larger than
the limit is a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import cut

#: Bits of the key hash in use.
HASH_BITS = 60
#: Cells are this many bits finer than an even spread would need.
SPARE_BITS = 3
#: A row's bytes besides its text.
ROW_BYTES = 16


def key_hash(key: str) -> Column:
    """The first 60 bits of the key's MD5, as a long."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def row_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")) + ROW_BYTES


def _prefix(depth) -> Column:
    return F.expr(f"shiftright(_hash, {HASH_BITS} - ({depth}))")


def _round(rows: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """One row per cell of ``depth`` bits: the depth of its bucket, or null if even the cell is too large."""
    cells = rows.groupBy(_prefix(depth).alias("_cell")).agg(
        F.sum("_bytes").alias("_bytes"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high")
    )
    cells = cut(cells)
    levels = (
        cells.withColumn("_depth", F.explode(F.sequence(F.lit(base), F.lit(depth))))
        .groupBy("_depth", F.expr(f"shiftright(_cell, {depth} - _depth)").alias("_prefix"))
        .agg(F.sum("_bytes").alias("shard_bytes"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        .filter((F.col("shard_bytes") <= limit) | (F.col("_low") == F.col("_high")))
    )
    # Sums only shrink with depth, so a cell's bucket is its shallowest prefix that is settled.
    settled = (
        cells.select("_cell")
        .withColumn("_depth", F.explode(F.sequence(F.lit(base), F.lit(depth))))
        .withColumn("_prefix", F.expr(f"shiftright(_cell, {depth} - _depth)"))
        .join(levels.select("_depth", "_prefix", "shard_bytes"), ["_depth", "_prefix"])
        .groupBy("_cell")
        .agg(F.min(F.struct("_depth", "_prefix", "shard_bytes")).alias("_bucket"))
    )
    return cut(cells.select("_cell", F.col("_bytes").alias("_cell_bytes")).join(settled, "_cell", "left"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Deal the rows of single-key buckets over pages of at most ``limit`` bytes.

    Running sums are taken per bucket and input partition and shifted by the partitions
    before, so a key with most of the rows is not gathered in one task."""
    local = Window.partitionBy("_bucket", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    small = F.when(F.col("_bytes") * 2 <= limit, F.col("_bytes")).otherwise(0)
    shares = rows.groupBy("_bucket", "_part").agg(F.sum(small).alias("_sum"))
    shares = shares.select("_bucket", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_local", F.coalesce(F.sum(small).over(local), F.lit(0))).join(shares, ["_bucket", "_part"])
    # Half the limit plus one row of at most half the limit fits; a larger row has a page of its own.
    page = F.when(
        F.col("_bytes") * 2 <= limit, F.floor((F.col("_before") + F.col("_local")) / F.lit(max(1, limit // 2))).cast("long")
    ).otherwise(-1 - F.col("_row"))
    return placed.withColumn("page", page).drop("_local", "_before")


def shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 64 << 20, carry: bool = False) -> DataFrame:
    """Assign every row of ``df`` to a shard of at most ``limit`` bytes; ``carry`` adds the row itself as ``_whole``.

    Returns the key, ``shard`` (the bucket's hash prefix as bits; empty if one bucket holds
    all), ``depth``, ``page`` (null outside overflow pages; negative for a row larger than
    half the limit in such a bucket), ``n_bytes`` and ``shard_bytes`` (of the bucket).
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole")] if carry else []
    rows = df.select(
        F.col(key), *whole, key_hash(key).alias("_hash"), row_bytes(text).alias("_bytes"),
        F.monotonically_increasing_id().alias("_row"), F.spark_partition_id().alias("_part"),
    )
    rows = cut(rows)
    total = rows.agg(F.sum("_bytes")).first()[0]
    if total is None:
        return rows.select(
            key, *rows.columns[1:-4], F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("page"),
            F.col("_bytes").alias("n_bytes"), F.col("_bytes").alias("shard_bytes"),
        )
    base, open_rows, found = 0, rows, None
    largest = total
    while True:
        need = max(0, math.ceil(math.log2(max(1.0, largest / limit))))
        depth = min(HASH_BITS, base + need + SPARE_BITS)
        cells = _round(open_rows, base, depth, limit)
        joined = open_rows.withColumn("_cell", _prefix(depth)).join(cells.drop("_cell_bytes"), "_cell").drop("_cell")
        done = joined.filter(F.col("_bucket").isNotNull())
        found = done if found is None else found.unionByName(done)
        largest = cells.filter(F.col("_bucket").isNull()).agg(F.max("_cell_bytes")).first()[0]
        if largest is None:
            break
        open_rows = cut(joined.filter(F.col("_bucket").isNull()).drop("_bucket"))
        base = depth
    over = F.col("_bucket.shard_bytes") > limit
    plain = found.filter(~over).withColumn("page", F.lit(None).cast("long"))
    paged = _pages(found.filter(over), limit)
    bits = F.when(F.col("_bucket._depth") == 0, F.lit("")).otherwise(
        F.lpad(F.conv(F.col("_bucket._prefix").cast("string"), 10, 2), F.col("_bucket._depth"), F.lit("0"))
    )
    return plain.unionByName(paged).select(
        key, *rows.columns[1:-4], bits.alias("shard"), F.col("_bucket._depth").alias("depth"), "page",
        F.col("_bytes").alias("n_bytes"), F.col("_bucket.shard_bytes").alias("shard_bytes"),
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> None:
    """Write ``df`` with one folder per shard and page; each fits the limit, so one task writes it.

    The folder columns are ``_shard`` and ``_page``; all columns of ``df`` are kept as they are."""
    assigned = shards(df, key, text, limit, carry=True)
    named = assigned.select(
        "_whole.*", F.concat(F.lit("b"), "shard").alias("_shard"), F.coalesce("page", F.lit(0)).alias("_page")
    )
    named.repartition("_shard", "_page").write.partitionBy("_shard", "_page").parquet(path)
