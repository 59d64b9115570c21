"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from registry import QUERIES

HEADLINE = (
    "top_statements", "top_processes", "top_logged_queries", "message_size_cdf",
    "message_log_cdf", "service_time_cdf", "counter_delta", "resample_linear", "load_vs_cpu",
    "concurrency", "concurrency_with_lookback", "asof_parent", "effective_dated_lookup_per_row",
    "interval_join", "event_delta_report", "ingest_pipe_access_log", "ingest_message_log",
    "rollup_by_fingerprint", "chunk_text", "running_stats_upsert", "progress",
    "definition_mismatch", "stream_status_transitions",
)


def main() -> None:
    with tempfile.TemporaryDirectory() as shared:  # of one machine: the bench runs on a local master
        measure(shared)


def measure(shared: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the JVM and of code generation is not what is measured
    QUERIES[HEADLINE[0]](spark, sf_dir).collect()
    only = os.environ.get("BENCH_QUERIES")
    times = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
