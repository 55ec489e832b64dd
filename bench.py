"""Time the headline jobs, a line for each on the error stream, and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from weirworks.catalog import load
from weirworks.session import build_session

HEADLINE = (
    "cleaning_job",
    "clean_pipeline",
    "removal_breakdown",
    "cleaning_metrics",
    "strategy_summary",
    "numeric_profile",
    "categorical_profile",
    "quality_score_dataset",
    "load_and_explore",
    "group_stats_company",
    "group_stats_part",
    "summary_metrics",
    "histogram",
    "eda_report",
    "before_after",
    "batch_predict",
    "cluster_metrics",
    "train_regressor",
    "grid_search",
)
#: Seconds that a query may take before its jobs are cancelled; all have ``BENCH_TOTAL_S`` together.
LIMIT_S, TOTAL_S = float(os.environ.get("BENCH_LIMIT_S", 900)), float(os.environ.get("BENCH_TOTAL_S", 1500))


def timed(spark, run, limit: float) -> float | None:
    """Seconds of ``run``, or None where the limit ended it."""
    over = threading.Event()

    def watch() -> None:
        while not over.wait(limit if time.perf_counter() - started < limit else 1):
            spark.sparkContext.cancelAllJobs()  # again and again: a search goes on with its next job

    started = time.perf_counter()
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        run()
        return round(time.perf_counter() - started, 3)
    except Exception as error:
        if time.perf_counter() - started < limit:
            raise
        print(f"stopped after {limit:.0f} s: {type(error).__name__}", file=sys.stderr, flush=True)
        return None
    finally:
        over.set()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "weirworks-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start-up is not timed
    seconds, stopped, began = {}, [], time.perf_counter()
    for name in HEADLINE:
        left = TOTAL_S - (time.perf_counter() - began)
        if left < 5:
            stopped.append(name)
            continue
        took = timed(spark, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save(), min(LIMIT_S, left))
        print(f"{name} {took}", file=sys.stderr, flush=True)
        if took is None:
            stopped.append(name)
        else:
            seconds[name] = took
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
    print(json.dumps(line | ({"stopped": stopped} if stopped else {})), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
