"""Incremental refresh of terminal records, and reconciliation with the live queue.

A record is known by its cluster and job id: two clusters may use one id.  A listing or queue
that does not name clusters is of one cluster, and its ids alone count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states
from . import store
from .common import by_rows, cut, null_safe_join

KEY = ("cluster", "job_id")


def _keyed(df: DataFrame) -> DataFrame:
    return df if "cluster" in df.columns else df.withColumn("cluster", F.lit(None).cast("string"))


def fingerprints(listing: DataFrame) -> DataFrame:
    """Ordered (state, end) list per cluster and job id from a cheap listing ([cluster,] job_id, pos, state, end)."""
    seen = F.array_sort(F.collect_list(F.struct("pos", "state", "end")))
    return _keyed(listing).groupBy(*KEY).agg(
        F.transform(seen, lambda x: F.struct(x["state"].alias("state"), x["end"].alias("end"))).alias("fingerprint")
    )


def is_storable():
    """Only closed records are kept: an end, not open, not in progress."""
    return F.col("end").isNotNull() & ~F.col("open_ended") & ~states.in_progress("state", "live")


def plan_refresh(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Per listed job: reuse the stored record, or read it again because it is new,
    changed or was never closed.  ``stored`` has the key and the fingerprint."""
    now = fingerprints(listing)
    # The whole history: its files are small for their rows, so that Spark might broadcast it.
    old = _keyed(stored).select(*KEY, F.col("fingerprint").alias("_stored")).hint("merge")
    df = null_safe_join(now, old, list(KEY), "left")
    action = (
        F.when(F.col("_stored").isNull(), "new")
        .when(F.col("_stored") == F.col("fingerprint"), "reuse")
        .otherwise("changed")
    )
    return df.select(*KEY, "fingerprint", action.alias("action"))


def refresh(listing: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The new content of the store: kept records plus storable fresh ones.

    ``stored`` and ``fresh`` share the jobs schema; ``stored`` also has the fingerprint.
    Records outside the listing stay untouched.
    """
    stale = cut(plan_refresh(listing, stored).filter(F.col("action") != "reuse"))
    kept = null_safe_join(stored, by_rows(stale.select(*KEY)), list(KEY), "left_anti")
    return kept.unionByName(_added(stale, fresh).select(*kept.columns))


def _added(stale: DataFrame, fresh: DataFrame) -> DataFrame:
    # Of a store that is being filled, everything is stale, and neither side may be broadcast.
    return null_safe_join(_keyed(fresh).filter(is_storable()), by_rows(stale.select(*KEY, "fingerprint")), list(KEY))


def refresh_store(spark: SparkSession, path: str, listing: DataFrame, fresh: DataFrame, grain: str = store.DAYS) -> list[str]:
    """Bring the store at ``path`` up to a listing: records that are new or changed there are taken from
    ``fresh`` (which only they need to be read for), all others stay as they are.  Days of the end date
    that no such record leaves or enters keep their files.  Returns the days that were rewritten."""
    stored = store.read(spark, path)
    if stored is None:
        known = fingerprints(listing.limit(0))
    else:
        known = stored.select(*KEY, "fingerprint")
    stale = cut(plan_refresh(listing, known).filter(F.col("action") != "reuse"))
    return store.replace(spark, path, _added(stale, fresh), stale, KEY, F.col("end"), grain)


def read_store(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame | None:
    """The stored records (of some end dates), or None before the first write."""
    return store.read(spark, path, since, until)


def reconcile_live(jobs: DataFrame, live: DataFrame | None) -> DataFrame:
    """Mark running or open records with whether the queue knows them.

    No snapshot (None) leaves everything as it is; an empty one means nothing runs.
    The snapshot holds the ids queued right now (with ``cluster`` if it is of several); adaptive
    execution broadcasts it when its measured size allows.
    """
    if live is None:
        return jobs
    where = {"_home": F.col("cluster")} if "cluster" in live.columns else {}
    known = live.select(F.col("job_id").alias("_base"), *[c.alias(n) for n, c in where.items()]).distinct().withColumn("_known", F.lit(True))
    df = jobs.withColumns({"_base": F.substring_index("job_id", ".", 1), **where}).join(known, ["_base", *where], "left")
    asked = states.is_state("state", "RUNNING") | F.col("open_ended")
    return df.withColumns(
        {
            "live": F.when(asked, F.coalesce("_known", F.lit(False))).otherwise(F.col("live")),
            "open_ended": asked | F.col("open_ended"),
        }
    ).drop("_base", "_known", *where)


_FILLED = ["max_rss", "ave_rss", "max_vmsize", "max_pages", "max_rss_node", "max_rss_task"]


def merge_live(
    jobs: DataFrame, steps: DataFrame, live: DataFrame, reader: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fill unmeasured fields of running steps from live counters.

    Another owner's job cannot be read: it is flagged ``foreign_owner`` instead.  Only
    NULL fields are filled; the CPU total is the task average times the task count.
    Counters of several clusters name theirs in ``cluster``.
    """
    going = states.in_progress("state", "live")
    if reader is None:
        foreign = F.lit(False)
    else:
        numeric = F.col("user").rlike("^[0-9]+$")
        foreign = F.coalesce(
            (numeric == F.lit(reader.isdigit())) & (F.lower("user") != reader.lower()), F.lit(False)
        )
    key = ["cluster", "job_id"] if "cluster" in live.columns else ["job_id"]
    readable = jobs.filter(going & ~foreign).select("alloc_id", *key)
    mine = live.join(readable.select(*key).distinct(), key, "left_semi")
    measured = mine.select(*key).distinct().withColumn("_has", F.lit(True))
    jobs = jobs.join(measured, key, "left").withColumns(
        {
            "live_metrics": F.when(going & F.coalesce("_has", F.lit(False)), True).otherwise(F.col("live_metrics")),
            "foreign_owner": F.when(going & foreign, True).otherwise(F.col("foreign_owner")),
        }
    ).drop("_has")
    named = mine.select(
        "step_id", *key[:-1], *[F.col(c).alias(f"_l_{c}") for c in [*_FILLED, "ave_cpu", "ntasks"]]
    )
    target = steps.join(readable.select("alloc_id").withColumn("_mine", F.lit(True)), "alloc_id", "left")
    df = null_safe_join(target, named, ["step_id", *key[:-1]], "left")
    fill = F.coalesce("_mine", F.lit(False)) & states.step_in_progress("state")
    cpu_unread = F.coalesce(F.col("total_cpu") == 0, F.lit(True)) & (F.col("_l_ave_cpu") > 0)
    tasks = F.greatest(
        F.coalesce(F.nullif("_l_ntasks", F.lit(0).cast("long")), F.nullif("ntasks", F.lit(0).cast("long")), F.lit(1).cast("long")),
        F.lit(1).cast("long"),
    )
    updates = {c: F.when(fill, F.coalesce(c, f"_l_{c}")).otherwise(F.col(c)) for c in _FILLED}
    updates["total_cpu"] = F.when(fill & cpu_unread, F.col("_l_ave_cpu") * tasks).otherwise(F.col("total_cpu"))
    updates["ave_cpu"] = F.when(fill & cpu_unread, F.col("_l_ave_cpu")).otherwise(F.col("ave_cpu"))
    return jobs, df.withColumns(updates).select(*steps.columns)
