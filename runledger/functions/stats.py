"""Closed-form statistics as column expressions.

Spark has no log-gamma.  Binomial log-probabilities are computed with the
saddle-point form (a Stirling remainder plus a deviance term), which keeps full
precision for counts in the billions where differences of log-gammas would not.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import memo
from .text import as_col

Z = 1.96
FDR_ALPHA = 0.05

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_TABLE_SIZE = 16
# ln n! minus Stirling's main term, exact for small n.
_SMALL_REMAINDERS = [0.0] + [
    math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI for n in range(1, _TABLE_SIZE)
]
# Bernoulli coefficients of the remainder series 1/(12n) - 1/(360n^3) + ...
_SERIES = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680]


@memo
def wilson(successes, trials, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a proportion, clamped to [0, 1]; (0, 1) without trials."""
    n = as_col(trials).cast("double")
    p = as_col(successes) / n
    denom = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / denom
    margin = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / denom
    known = n > 0
    low = F.when(known, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0)
    high = F.when(known, F.least(F.lit(1.0), centre + margin)).otherwise(1.0)
    return low, high


def _stirling_remainder(n: Column) -> Column:
    inv = 1.0 / F.greatest(n, F.lit(1.0))
    inv2 = inv * inv
    series = F.lit(_SERIES[-1])
    for coefficient in reversed(_SERIES[:-1]):
        series = F.lit(coefficient) + series * inv2
    table = F.array(*[F.lit(v) for v in _SMALL_REMAINDERS])
    return F.when(n < _TABLE_SIZE, F.get(table, n.cast("int"))).otherwise(series * inv)


def _deviance(x: Column, mean: Column) -> Column:
    delta = x - mean
    return x * F.log1p(delta / mean) - delta


def _log_binomial_of(x: Column, n: Column, p: Column) -> Column:
    q = 1.0 - p
    body = (
        _stirling_remainder(n)
        - _stirling_remainder(x)
        - _stirling_remainder(n - x)
        - _deviance(x, n * p)
        - _deviance(n - x, n * q)
        - 0.5 * (F.log(x) + F.log1p(-x / n))
        - _HALF_LOG_2PI
    )
    return (
        F.when(n == 0, 0.0)
        .when(x == 0, n * F.log1p(-p))
        .when(x == n, n * F.log(p))
        .otherwise(body)
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside one expression.

    A column used five times is five copies in the plan, and copies of copies grow
    exponentially.  A one-element ``transform`` evaluates it once and keeps the plan
    linear in the formula.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_binomial(k: Column, n: Column, p: Column) -> Column:
    return let(
        F.struct(k.alias("k"), n.alias("n"), p.alias("p")),
        lambda v: _log_binomial_of(v["k"], v["n"], v["p"]),
    )


def hypergeometric_log_pmf(k, total, marked, drawn) -> Column:
    """log P(k marked among ``drawn`` of ``total``), as a ratio of three binomials."""
    named = [as_col(c).cast("double").alias(n) for n, c in zip("ktmd", (k, total, marked, drawn), strict=True)]

    def ratio(v: Column) -> Column:
        p = v["d"] / v["t"]
        return (
            _log_binomial(v["k"], v["m"], p)
            + _log_binomial(v["d"] - v["k"], v["t"] - v["m"], p)
            - _log_binomial(v["d"], v["t"], p)
        )

    return let(F.struct(*named), ratio)


_REACH_SIGMAS = 12
_REACH_EXTRA = 40


@memo
def fisher_tail(bad, trials, other_bad, other_trials, direction) -> Column:
    """One-sided exact test of an entity against the rest.

    Direction ``worse`` sums the hypergeometric tail upward from ``bad``, any other
    downward.
    The first term is exact, each next one follows by its ratio.  Terms further than
    12 standard deviations (plus 40 for sparse counts) past both the start and the
    mode are below double precision of the sum, so the walk ends there.
    """
    names = ("a", "n", "ob", "on")
    raw = [as_col(c).cast("long").alias(k) for k, c in zip(names, (bad, trials, other_bad, other_trials), strict=True)]
    margins = let(
        F.struct(*raw, (as_col(direction) == "worse").alias("up")),
        lambda v: F.struct(
            v["a"].alias("a"), v["n"].alias("n"), v["on"].alias("on"), v["up"].alias("up"),
            (v["n"] + v["on"]).alias("total"), (v["a"] + v["ob"]).alias("marked"),
        ),
    )
    return let(margins, _tail_of_margins)


def _tail_of_margins(v: Column) -> Column:
    zero = F.lit(0).cast("long")
    n, total, marked = v["n"], v["total"], v["marked"]
    low = F.greatest(zero, n - (total - marked))
    high = F.least(n, marked)
    share = marked / total.cast("double")
    mode = n * share
    sigma = F.sqrt(mode * (1 - share) * (v["on"] / total.cast("double")))
    bounds = F.struct(
        low.alias("low"), high.alias("high"), mode.alias("mode"),
        F.ceil(_REACH_SIGMAS * sigma + _REACH_EXTRA).cast("long").alias("reach"),
        F.least(F.greatest(v["a"], low), high).alias("start"),
    )

    def walk(b: Column) -> Column:
        start = b["start"]
        up_end = F.least(b["high"], F.greatest(start, F.ceil(b["mode"])) + b["reach"])
        down_end = F.greatest(b["low"], F.least(start, F.floor(b["mode"])) - b["reach"])
        none = F.array().cast("array<bigint>")
        steps = F.when(
            v["up"], F.when(start < up_end, F.sequence(start, up_end - 1))
        ).otherwise(F.when(start > down_end, F.sequence(start, down_end + 1, F.lit(-1).cast("long"))))

        def step(acc: Column, k: Column) -> Column:
            spare = (total - marked - n + k).cast("double")
            ratio = F.when(
                v["up"], (marked - k) * (n - k) / ((k + 1) * (spare + 1))
            ).otherwise(k * spare / ((marked - k + 1) * (n - k + 1).cast("double")))
            return let(
                acc["term"] * ratio,
                lambda t: F.struct(t.alias("term"), (acc["tail"] + t).alias("tail")),
            )

        first = F.exp(hypergeometric_log_pmf(start, total, marked, n))
        seed = let(first, lambda f: F.struct(f.alias("term"), f.alias("tail")))
        return F.aggregate(F.coalesce(steps, none), seed, step)["tail"]

    degenerate = (n <= 0) | (v["on"] <= 0) | (marked <= 0) | (marked >= total)
    return F.when(degenerate, 1.0).otherwise(F.least(F.lit(1.0), let(bounds, walk)))


def two_sided_price(one_sided: Column) -> Column:
    """A direction read off the data costs a factor of two."""
    return F.least(F.lit(1.0), 2.0 * one_sided)
