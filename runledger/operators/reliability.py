"""Which entity really fails more often?  Rates with intervals, exact tests, FDR.

``entity_rates`` knows nothing of schedulers: it takes a row per trial, the entity
column, a boolean hit and optional stratum columns.  The node functions below feed
it job placements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, states, stats, text
from ..functions.hostlist import compress_hosts, explode_hosts
from .common import cut, null_safe_join, top_per_group

MIN_TRIALS = 10
MIN_HISTORY = 20
EXCLUDE_LIMIT = 8
_RANK_BLOCK = 65536


def entity_counts(df: DataFrame, entity: str, hit: Column, stratum: Sequence[str] = ()):
    """Trials and hits per entity; partial aggregation makes hot entities cheap."""
    return df.groupBy(*stratum, entity).agg(
        F.count("*").alias("trials"), F.count_if(hit).alias("bad")
    )


def _totals(counts: DataFrame, stratum: list[str], min_trials: int) -> DataFrame:
    enough = F.col("trials") >= min_trials
    return counts.groupBy(*stratum).agg(
        F.coalesce(F.sum("trials"), F.lit(0)).alias("all_trials"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("all_hits"),
        F.count_if(enough).alias("tested"),
        F.count_if(~enough).alias("skipped"),
    )


_TOTALS = ["all_trials", "all_hits", "tested", "skipped"]


def _with_totals(counts: DataFrame, totals: DataFrame, stratum: list[str]) -> DataFrame:
    if stratum:
        return null_safe_join(counts, totals, stratum)
    one = counts.withColumn("_t", totals.select(F.struct(*_TOTALS)).scalar())
    return one.select("*", "_t.*").drop("_t")


def rates_from_counts(
    counts: DataFrame,
    entity: str,
    stratum: Sequence[str] = (),
    min_trials: int = MIN_TRIALS,
    alpha: float = stats.FDR_ALPHA,
) -> DataFrame:
    """One row per entity with enough trials, compared with all others of its stratum.

    The comparison is leave-one-out (stratum totals minus own counts) and includes
    entities below the minimum.  Verdicts need both false-discovery control over the
    stratum and an interval clear of the comparison.
    """
    strata = list(stratum)
    totals = _totals(counts, strata, min_trials)
    rows = _with_totals(counts.filter(F.col("trials") >= min_trials), totals, strata)
    other_trials = F.col("all_trials") - F.col("trials")
    other_hits = F.col("all_hits") - F.col("bad")
    low, high = stats.wilson("bad", "trials")
    rows = rows.select(
        *strata, entity, "bad", "trials",
        (F.col("bad") / F.col("trials")).alias("rate"),
        low.alias("ci_low"), high.alias("ci_high"),
        F.try_divide(other_hits, other_trials).alias("comparison"),
        other_trials.alias("other_trials"), other_hits.alias("other_hits"),
        "all_trials", "all_hits", "tested",
    )
    direction = F.when(F.col("rate") > F.col("comparison"), "worse").when(
        F.col("rate") < F.col("comparison"), "better"
    )
    price = stats.two_sided_price(
        stats.fisher_tail("bad", "trials", "other_hits", "other_trials", "direction")
    )
    rows = rows.withColumn("direction", direction).withColumn(
        "p_value", F.when(F.col("direction").isNull(), 1.0).otherwise(price)
    )
    rows = _step_up(rows, strata, alpha)
    confirmed = F.coalesce(F.col("_rejected"), F.lit(False))
    verdict = (
        F.when(F.col("comparison").isNull(), "unknown")
        .when(confirmed & (F.col("direction") == "worse") & (F.col("ci_low") > F.col("comparison")), "worse")
        .when(confirmed & (F.col("direction") == "better") & (F.col("ci_high") < F.col("comparison")), "better")
        .otherwise("inconclusive")
    )
    return rows.withColumn("verdict", verdict).select(
        *strata, entity, "bad", "trials", "rate", "ci_low", "ci_high", "comparison",
        "other_trials", "direction", "p_value", "verdict", "all_trials", "all_hits",
    )


def _step_up(rows: DataFrame, strata: list[str], alpha: float) -> DataFrame:
    """Benjamini-Hochberg without sorting all p-values in one task.

    A p-value passes at rank k when p <= alpha*k/m, so each row *needs* a smallest
    rank.  With C(v) = rows that need at most v, the step-up cut is the largest
    needed rank v with C(v) >= v; rows needing at most that are rejected.  C is a
    histogram prefix sum, taken per block of ranks and then over blocks.
    """
    m = F.col("tested")

    def passes(p: Column, k: Column) -> Column:
        return p <= F.lit(alpha) * k / m

    def smallest(v: Column) -> Column:
        p, k = v["p"], v["k"]
        # The quotient may be off by one ulp: settle it with the test itself.
        rank = F.when((k > 1) & passes(p, k - 1), k - 1).when(passes(p, k), k).otherwise(k + 1)
        return F.least(rank, m + 1)

    guess = F.greatest(F.ceil(F.col("p_value") * m / alpha), F.lit(1).cast("long"))
    need = stats.let(F.struct(F.col("p_value").alias("p"), guess.alias("k")), smallest)
    rows = rows.withColumn("_need", need)
    # Ranks that rows need, in blocks of at most _RANK_BLOCK distinct values.
    blocks = (
        rows.groupBy(*strata, "_need")
        .agg(F.count("*").alias("_n"))
        .groupBy(*strata, F.floor(F.col("_need") / _RANK_BLOCK).alias("_block"))
        .agg(
            F.array_sort(F.collect_list(F.struct("_need", "_n"))).alias("_bars"),
            F.sum("_n").alias("_block_n"),
        )
    )
    # The running sum passes one small row per block; the blocks' bars stay where they are.
    before = Window.partitionBy(*strata).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_block_n").over(before), F.lit(0))
    offsets = blocks.select(*strata, "_block", offset.alias("_offset"))

    def climb(acc: Column, bar: Column) -> Column:
        upto = acc["upto"] + bar["_n"]
        cut_at = F.when(upto >= bar["_need"], bar["_need"]).otherwise(acc["cut"])
        return F.struct(upto.alias("upto"), cut_at.alias("cut"))

    seed = F.struct(F.col("_offset").alias("upto"), F.lit(0).cast("long").alias("cut"))
    cuts = (
        null_safe_join(blocks, offsets, [*strata, "_block"])
        .groupBy(*strata)
        .agg(F.max(F.aggregate("_bars", seed, climb)["cut"]).alias("_cut"))
    )
    if strata:
        rows = null_safe_join(rows, cuts, strata, "left")
    else:
        rows = rows.withColumn("_cut", cuts.select("_cut").scalar())
    return rows.withColumn("_rejected", F.col("_need") <= F.col("_cut"))


def entity_rates(
    df: DataFrame,
    entity: str,
    hit: Column,
    stratum: Sequence[str] = (),
    min_trials: int = MIN_TRIALS,
    alpha: float = stats.FDR_ALPHA,
) -> DataFrame:
    """Counts are written out once; the statistics then run over one row per entity."""
    counts = cut(entity_counts(df, entity, hit, stratum))
    return rates_from_counts(counts, entity, stratum, min_trials, alpha)


def entity_rates_summary(
    df: DataFrame,
    entity: str,
    hit: Column,
    stratum: Sequence[str] = (),
    min_trials: int = MIN_TRIALS,
    alpha: float = stats.FDR_ALPHA,
) -> DataFrame:
    """One row per stratum: totals, entities tested and skipped, and how many were
    held back (inconclusive although their interval excludes the baseline)."""
    strata = list(stratum)
    counts = cut(entity_counts(df, entity, hit, strata))
    rates = rates_from_counts(counts, entity, strata, min_trials, alpha)
    base = F.try_divide(F.col("all_hits"), F.col("all_trials"))
    held = rates.groupBy(*strata).agg(
        F.count_if(
            (F.col("verdict") == "inconclusive")
            & ((F.col("ci_low") > base) | (F.col("ci_high") < base))
        ).alias("held_back"),
        F.count_if(F.col("verdict") == "worse").alias("worse"),
        F.count_if(F.col("verdict") == "better").alias("better"),
    )
    totals = _totals(counts, strata, min_trials)
    if strata:
        joined = null_safe_join(totals, held, strata, "left")
    else:
        joined = totals.withColumn("_h", held.select(F.struct("held_back", "worse", "better")).scalar())
        joined = joined.select("*", "_h.*").drop("_h")
    zero = F.lit(0).cast("long")
    return joined.select(
        *strata,
        base.alias("baseline"),
        F.col("all_trials").alias("trials"),
        F.col("all_hits").alias("hits"),
        "tested", "skipped",
        F.coalesce("held_back", zero).alias("held_back"),
        F.coalesce("worse", zero).alias("worse"),
        F.coalesce("better", zero).alias("better"),
        F.lit(0.95).alias("confidence_level"),
        F.lit(alpha).alias("fdr_alpha"),
    )


# -- job placements ------------------------------------------------------------------

WORKLOAD = ["workload_name", "workload_user"]


def informative(metric: str) -> Column:
    """Outcomes that say something about the machine: for failures neither a
    cancellation nor an exhausted memory limit does."""
    if metric == "hang":
        return F.lit(True)
    return ~F.col("is_cancelled") & ~states.is_state("state", "OUT_OF_MEMORY")


def _event(metric: str) -> Column:
    return F.col("is_noop") if metric == "hang" else F.col("is_failed")


def placements(metrics: DataFrame, metric: str = "failure", keep: Sequence[str] = ()) -> DataFrame:
    """One row per usable, informative job and host it ran on (repeats kept)."""
    rows = metrics.filter(states.usable() & informative(metric)).select(
        F.col("folded_name").alias("workload_name"),
        F.col("user").alias("workload_user"),
        *keep,
        _event(metric).alias("hit"),
        "node_list",
    )
    return explode_hosts(rows, "node_list")


def in_stratum(df: DataFrame, name: str, user: str | None = None) -> DataFrame:
    """Rows of one workload; no user given means any user."""
    df = df.filter(F.col("workload_name") == text.fold_name(F.lit(name)))
    return df if user is None else df.filter(F.col("workload_user") == user)


def node_rates(metrics: DataFrame, metric: str = "failure", controlled: bool = True, **kw):
    """Per-node rates; ``controlled`` looks only at the dominant workload."""
    rows = placements(metrics, metric)
    if controlled:
        pick = dominant_workload(metrics, metric).select(*WORKLOAD)
        rows = null_safe_join(rows, pick, WORKLOAD, "left_semi")
    return entity_rates(rows, "node", F.col("hit"), **kw)


def node_rates_by_workload(metrics: DataFrame, metric: str = "failure", **kw) -> DataFrame:
    return entity_rates(placements(metrics, metric), "node", F.col("hit"), WORKLOAD, **kw)


def dominant_workload(metrics: DataFrame, metric: str | None = None) -> DataFrame:
    """One row: the (folded name, user) with most events, then most runs.

    Ties go to the smaller key.  ``label`` is a real name when the fold kept no letter.
    """
    told = F.lit(True) if metric is None else informative(metric)
    event = F.lit(False) if metric is None else (_event(metric) & told)
    newest = F.struct("stamp", "id_primary", "id_task", "job_id")
    per = (
        metrics.filter(states.usable())
        .groupBy(F.col("folded_name").alias("workload_name"), F.col("user").alias("workload_user"))
        .agg(
            F.count_if(event).alias("events"),
            F.count_if(told).alias("runs"),
            F.count("*").alias("all_runs"),
            F.max_by("name", F.when(F.length("name") > 0, newest)).alias("_newest"),
        )
    )
    return (
        per.orderBy(
            F.desc("events"), F.desc("runs"), F.desc("all_runs"), "workload_name", "workload_user"
        )
        .limit(1)
        .select(
            *WORKLOAD,
            F.when(text.fold_erased("workload_name"), F.coalesce("_newest", "workload_name"))
            .otherwise(F.col("workload_name"))
            .alias("label"),
            "events", "runs",
        )
    )


def suggest_exclude(
    rates: DataFrame, entity: str = "node", stratum: Sequence[str] = (), limit: int = EXCLUDE_LIMIT
) -> DataFrame:
    """The worst confirmed entities (at most ``limit``), how many more there are, and
    the shown ones as one compressed list per stratum."""
    strata = list(stratum)
    bad = cut(rates.filter(F.col("verdict") == "worse"))
    if strata:
        shown = top_per_group(bad, strata, [F.desc("rate"), F.col(entity)], limit)
    else:
        shown = bad.orderBy(F.desc("rate"), entity).limit(limit)
    listed = compress_hosts(shown.select(*strata, entity), strata, entity, "exclude")
    counts = bad.groupBy(*strata).agg(
        F.least(F.count("*"), F.lit(limit)).alias("shown"),
        F.greatest(F.count("*") - limit, F.lit(0)).alias("left_out"),
    )
    if strata:
        return null_safe_join(counts, listed, strata)
    return counts.withColumn("exclude", listed.select("exclude").scalar())


def note_text(label: Column | None = None) -> Column:
    """A sentence on a flagged row, with the size of the comparison when it is small."""
    against = F.format_string("%.1f%%", formats.printed(F.col("comparison") * 100, 1))
    small = F.col("other_trials") < F.col("trials")
    against = F.when(
        small, F.concat(against, F.format_string(" (%d placements)", F.col("other_trials")))
    ).otherwise(against)
    head = F.format_string(
        "%s: %d of %d placements failed, %.1f%%", "node", "bad", "trials", formats.printed(F.col("rate") * 100, 1)
    )
    body = F.concat(
        head, F.lit(" [95% interval "), formats.percent_range_text("ci_low", "ci_high"),
        F.lit("]; all other nodes "), against,
    )
    return body if label is None else F.concat(body, F.lit(", within "), label)


def node_notes(metrics: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Per job, the worst flagged node among its hosts, judged inside the job's own
    workload.  Empty unless the history holds more than MIN_HISTORY usable records."""
    history = metrics if history is None else history
    worse = node_rates_by_workload(history).filter(F.col("verdict") == "worse")
    names = (
        history.filter(states.usable())
        .groupBy(F.col("folded_name").alias("workload_name"), F.col("user").alias("workload_user"))
        .agg(F.min(F.coalesce("name", F.lit(""))).alias("_lo"), F.max(F.coalesce("name", F.lit(""))).alias("_hi"))
    )
    worse = null_safe_join(worse, names, WORKLOAD)
    hosts = metrics.select(
        "alloc_id", "job_id", "name",
        F.col("folded_name").alias("workload_name"),
        F.col("user").alias("workload_user"),
        "node_list",
    )
    hosts = explode_hosts(hosts, "node_list")
    enough = history.filter(states.usable()).agg(F.count("*") > MIN_HISTORY)
    hit = null_safe_join(hosts, worse, [*WORKLOAD, "node"])
    label = F.when(
        text.fold_erased("workload_name") | (F.col("_lo") == F.col("_hi")), F.col("name")
    ).otherwise(F.col("workload_name"))
    return (
        hit.withColumn("note", note_text(label))
        .groupBy("alloc_id", "job_id")
        .agg(
            F.max_by("note", F.struct("rate", "node")).alias("node_note"),
            F.max_by("node", F.struct("rate", "node")).alias("noted_node"),
        )
        .filter(enough.scalar())
    )
