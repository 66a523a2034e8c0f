"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from runledger.plans import contract

HEADLINE = [
    "entity_rates_supplier", "entity_rates_supplier_stratified", "job_metrics_cpu", "job_metrics_memory",
    "workload_rollup", "goodput", "repeat_failures", "memory_search_walk", "requeue_pattern",
    "entity_rates_biased", "node_notes", "sizing_walltime", "findings_by_code", "findings_worst_per_job",
    "hostlist_expand_count", "event_failure_runs", "p95_nearest_rank", "time_window_match",
    "log_name_match", "refresh_changed", "parse_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Parsing a hundred columns makes methods the JIT refuses; Spark then splits them.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = contract.queries()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        begin = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - begin, 3)

    spark.range(1000).selectExpr("sum(id)").collect()
    # The job_metrics table that the reports read, written once.
    timed("job_metrics_table", lambda: contract.P.metrics(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda q=queries[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
