"""Connected components of an undirected graph in Spark.

Every node points to the smallest node it knows.  A round gives each node the smallest
label of its neighbours' labels and then the label of its label (pointer jumping), so long
chains shrink by more than half per round.  Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes of ``edges``; the component is its smallest node.

    Alternates two contractions until nothing changes: every node's larger neighbours are
    linked to its smallest one, then every node and its smaller neighbours are (large-star
    and small-star).  Both keep components and end in stars.  A node's neighbours are never
    gathered: only minima are aggregated and joined back."""
    links = cut(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        large = (
            both.filter(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .filter("u != v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("low").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                )
            ).alias("e")
        ).select("e.*").filter("u != v").distinct()
        links = cut(small)
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cut(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))


def _mark(links: DataFrame) -> tuple:
    """Number of links and two digests of them all: equal for equal sets, and for others with a chance of 2**-120."""
    digests = [F.expr(f"bit_xor(xxhash64(u, v, {i}))").alias(f"d{i}") for i in (1, 2)]
    return tuple(links.agg(F.count(F.lit(1)).alias("n"), *digests).first())
