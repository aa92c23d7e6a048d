"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "select_hosts", "orient_hosts", "index_flows", "sessionize", "count_windows", "count_windows_lineitem", "time_windows",
    "dynamic_windows", "rolling_features", "block_features", "state_counts", "replay_visits", "replay_machines",
    "baseline_any", "quantile_detector", "state_lof", "state_kde", "confusion", "verdicts", "entity_lof", "pattern_error",
    "summary",
]


def main() -> None:
    from pyspark.sql import SparkSession

    import workload

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = workload.all_queries()
    wanted = sys.argv[1:] or HEADLINE
    found["select_hosts"](spark, sf).write.format("noop").mode("overwrite").save()  # start the engine
    seconds = {}
    for name in wanted:
        begin = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
