"""Host lists: ``rack[01-03,07]-ib,login1`` <-> one row per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memo import memo
from .text import as_col, digits_to_long

#: Hosts of a range that are listed at a time.
_BLOCK = 1 << 16
#: An array lists no wider range; ``explode_hosts`` lists every one.
WIDEST_IN_ARRAY = 10_000_000


def _range_or_literal(part: Column) -> Column:
    low = F.substring_index(part, "-", 1)
    high = F.when(part.contains("-"), F.regexp_extract(part, r"^[^-]*-(.*)$", 1))
    first, last = digits_to_long(low), digits_to_long(high)
    width = F.length(low)
    numbers = F.transform(
        F.sequence(first, last),
        lambda v: F.lpad(
            v.cast("string"), F.greatest(width, F.length(v.cast("string"))), F.lit("0")
        ),
    )
    return F.when((first <= last) & (last - first < WIDEST_IN_ARRAY), numbers).otherwise(F.array(part))


def _choices(token: Column) -> Column:
    body = F.split(F.regexp_replace(token, r"^\[|\]$", ""), ",")
    parts = F.filter(F.transform(body, lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    ranged = F.flatten(F.transform(parts, _range_or_literal))
    return F.when(token.rlike(r"^\[.+\]$"), ranged).otherwise(F.array(token))


def _expand_one(chunk: Column) -> Column:
    tokens = F.regexp_extract_all(chunk, F.lit(r"(\[[^\[\]]+\]|[^\[\]]+|[\[\]])"), F.lit(1))

    def extend(heads: Column, token: Column) -> Column:
        tails = _choices(token)
        return F.flatten(F.transform(heads, lambda h: F.transform(tails, lambda t: F.concat(h, t))))

    return F.aggregate(tokens, F.array(F.lit("")), extend)


def _chunks(c: Column) -> Column:
    return F.filter(F.split(c, r",(?![^\[]*\])"), lambda p: F.length(p) > 0)


def _no_hosts(c: Column) -> Column:
    return c.isNull() | c.startswith("None") | (F.length(c) == 0)


_BRACKET = r"^([^\[]*(?:\[(?![^\[\]]+\])[^\[]*)*)\[([^\[\]]+)\](.*)$"


def explode_hosts(df: DataFrame, column: str, name: str = "node") -> DataFrame:
    """One row per host of ``column`` in ``name``, besides the other columns; rows without hosts give none.

    A list is never held expanded: brackets are resolved one after the other, ranges in blocks
    of numbers, so the product of many wide brackets is only rows that stream by.  The number of
    passes is the largest number of brackets in a name (one figure over the column)."""
    c = F.col(column)
    kept = [F.col(f"`{x}`") for x in df.columns if x not in (column, name)]
    named = df.filter(~_no_hosts(c))
    depth = named.agg(F.max(F.size(F.regexp_extract_all(c, F.lit(r"(\[[^\[\]]+\])"), F.lit(1))))).first()[0] or 0
    rows = named.select(*kept, F.explode(F.when(~c.rlike(r"[\[,]"), F.array(c)).otherwise(_chunks(c))).alias("_rest"), F.lit("").alias("_host"))
    for _ in range(depth):
        open_ = F.col("_rest").rlike(_BRACKET)
        body = F.split(F.regexp_extract("_rest", _BRACKET, 2), ",")
        parts = F.filter(F.transform(body, lambda p: F.trim(p)), lambda p: F.length(p) > 0)
        # A name without a bracket passes as it is.
        whole = F.array(F.lit(None).cast("string"))
        # Names are taken apart before their hosts are listed: once a name, not once a host.
        head = F.when(open_, F.concat("_host", F.regexp_extract("_rest", _BRACKET, 1))).otherwise(F.concat("_host", "_rest"))
        tail = F.when(open_, F.regexp_extract("_rest", _BRACKET, 3)).otherwise(F.lit(""))
        rows = rows.select(*kept, head.alias("_head"), tail.alias("_tail"), F.explode(F.when(open_, parts).otherwise(whole)).alias("_part"))
        part = F.col("_part")
        low = F.substring_index(part, "-", 1)
        first = digits_to_long(low)
        last = digits_to_long(F.when(part.contains("-"), F.regexp_extract(part, r"^[^-]*-(.*)$", 1)))
        ranged = F.coalesce(first <= last, F.lit(False))
        blocks = F.when(ranged, F.sequence(F.lit(0).cast("long"), F.expr(f"(_last - _first) div {_BLOCK}"))).otherwise(F.array(F.lit(None).cast("long")))
        rows = rows.withColumns({"_first": first, "_last": last, "_width": F.length(low), "_ranged": ranged}).withColumn("_block", F.explode(blocks))
        start = F.col("_first") + F.col("_block") * _BLOCK
        numbers = F.when(F.col("_ranged"), F.sequence(start, F.least(start + (_BLOCK - 1), F.col("_last")))).otherwise(F.array(F.lit(None).cast("long")))
        rows = rows.withColumn("_number", F.explode(numbers))
        digits = F.col("_number").cast("string")
        value = F.when(F.col("_ranged"), F.lpad(digits, F.greatest(F.col("_width"), F.length(digits)), F.lit("0"))).otherwise(F.col("_part"))
        rows = rows.select(*kept, F.col("_tail").alias("_rest"), F.concat("_head", F.coalesce(value, F.lit(""))).alias("_host"))
    return rows.select(*kept, F.concat("_host", "_rest").alias(name))


@memo
def expand_hosts(node_list) -> Column:
    """Array of the host names, for lists that a row can hold: a range of ``WIDEST_IN_ARRAY`` or more stays as
    written (``explode_hosts`` has no such bound).  NULL and "None ..." give an empty array."""
    c = as_col(node_list)
    chunks = _chunks(c)
    expanded = F.flatten(F.transform(chunks, _expand_one))
    # The common list is one plain name: skip the token machinery for it.
    return (
        F.when(_no_hosts(c), F.array().cast("array<string>"))
        .when(~c.rlike(r"[\[,]"), F.array(c))
        .otherwise(expanded)
    )


@memo
def first_host(node_list) -> Column:
    """The first name of a list, whatever its length."""
    c = as_col(node_list)
    tokens = F.regexp_extract_all(F.get(_chunks(c), F.lit(0)), F.lit(r"(\[[^\[\]]+\]|[^\[\]]+|[\[\]])"), F.lit(1))

    def choice(token: Column) -> Column:
        body = F.split(F.regexp_replace(token, r"^\[|\]$", ""), ",")
        part = F.get(F.filter(F.transform(body, lambda p: F.trim(p)), lambda p: F.length(p) > 0), F.lit(0))
        low = F.substring_index(part, "-", 1)
        last = digits_to_long(F.when(part.contains("-"), F.regexp_extract(part, r"^[^-]*-(.*)$", 1)))
        return F.when(~token.rlike(r"^\[.+\]$"), token).when(digits_to_long(low) <= last, low).otherwise(part)

    name = F.aggregate(tokens, F.lit(""), lambda head, t: F.concat(head, choice(t)))
    return F.when(~_no_hosts(c), F.when(~c.rlike(r"[\[,]"), c).otherwise(name))


def compress_hosts(df: DataFrame, by: list[str], host: str, name: str = "node_list") -> DataFrame:
    """Distinct hosts per ``by`` as one bracketed list (consecutive runs merged)."""
    hosts = df.select(*by, F.col(host).alias("_host")).distinct().select(
        *by,
        "_host",
        F.regexp_replace("_host", r"[0-9]+$", "").alias("_prefix"),
        F.length(F.regexp_extract("_host", r"([0-9]+)$", 1)).alias("_width"),
        digits_to_long(F.regexp_extract("_host", r"([0-9]+)$", 1)).alias("_n"),
    )
    series = [*by, "_prefix", "_width"]
    # A numbered series holds at most the hosts of one machine room.
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*series).orderBy("_n"))
    runs = (
        hosts.filter(F.col("_n").isNotNull())
        .withColumn("_island", island)
        .groupBy(*series, "_island")
        .agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    )

    def padded(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.lpad(text, F.greatest(F.col("_width"), F.length(text)), F.lit("0"))

    span = F.when(F.col("_lo") == F.col("_hi"), padded("_lo")).otherwise(
        F.concat(padded("_lo"), F.lit("-"), padded("_hi"))
    )
    bracketed = (
        runs.groupBy(*series)
        .agg(
            F.array_sort(F.collect_list(F.struct("_lo", span.alias("_span")))).alias("_spans"),
            F.max(F.col("_hi") - F.col("_lo")).alias("_widest"),
        )
        .select(
            *by,
            F.lit(1).alias("_kind"),
            "_prefix",
            "_width",
            F.when(
                (F.size("_spans") == 1) & (F.col("_widest") == 0),
                F.concat("_prefix", F.col("_spans")[0]["_span"]),
            )
            .otherwise(
                F.concat(
                    "_prefix",
                    F.lit("["),
                    F.array_join(F.transform("_spans", lambda s: s["_span"]), ","),
                    F.lit("]"),
                )
            )
            .alias("_part"),
        )
    )
    plain = hosts.filter(F.col("_n").isNull()).select(
        *by, F.lit(0).alias("_kind"), F.col("_host").alias("_prefix"), F.lit(0).alias("_width"),
        F.col("_host").alias("_part"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_kind", "_prefix", "_width", "_part")))
    return (
        plain.unionByName(bracketed)
        .groupBy(*by)
        .agg(F.array_join(F.transform(ordered, lambda s: s["_part"]), ",").alias(name))
    )
