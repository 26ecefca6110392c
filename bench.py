"""Headline queries, timed.  Prints one line of JSON.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run once to warm up and then three times, to the end, into a sink
that keeps nothing; its time is the median.  The phases of a key-value store
benchmark follow, with their throughput.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

HEADLINE = [
    "kv_latest",
    "kv_snapshot_as_of",
    "kv_history",
    "kv_multi_get",
    "kv_get",
    "kv_range_scan",
    "kv_scan_n",
    "kv_reverse_scan",
    "kv_next_prev",
    "kv_seek",
    "compaction_survivors",
    "route_fragment",
    "fragment_load",
    "split_equi_load",
    "hot_keys",
    "overlap_counts",
    "overlap_components",
    "approx_sizes",
    "latency_percentiles",
    "counter_deltas",
    "place_power_of_d",
    "replica_repair",
    "xor_parity",
    "bulk_load",
    "crc32c_checksums",
    "store_round_trip",
]

#: Phases on a store of BENCH_RECORDS records (default 500,000), in operations a second.
PHASES = ("fillseq", "overwrite", "compact", "readseq", "readreverse", "readrandom", "readmissing", "readhot", "seekrandom", "deleterandom")


def main() -> None:
    from pyspark.sql import SparkSession

    from keelson.plans import catalog
    from keelson.plans.db_bench import Bench

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 4)
    with tempfile.TemporaryDirectory() as where:
        phases = Bench(spark, f"file://{where}/store", int(os.environ.get("BENCH_RECORDS", "500000"))).run(PHASES)
    rates = {name: round(n / t) for name, (n, t) in phases.items()}
    spark.stop()
    print(json.dumps({"metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "ops_per_sec": rates}))


if __name__ == "__main__":
    main()
