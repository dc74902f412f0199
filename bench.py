"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the data folder and BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f08_basic_profile", "f10_full_profile", "f14_cascade", "f14_cascade_large_sets", "j01_rules_as_of",
    "a07_all_hits", "a08_processed", "a14_evaluate", "w01_count_windows", "w04_sliding_zero_tail", "w05_cma",
    "w10_classic_detector", "w11_sliding_detector", "w13_escalation", "t01_stream_cascade",
    "t02_stream_sliding_counts", "t04_stream_cma", "t05_stream_count_windows",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("flowguard-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from flowguard.plans.catalog import queries, traffic

    runs = queries()
    # Start the JVM's and Python's workers before the clock does.
    warm = traffic(spark, folder)
    warm.write.format("noop").mode("overwrite").save()
    warm.select("packet_id").mapInArrow(lambda batches: batches, "packet_id bigint").count()
    packets = warm.count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": total, "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "packets": packets,
        "packets_per_sec": {name: round(packets / s) for name, s in seconds.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
