"""Headline timings: one JSON line.

``BENCH_SF_DIR`` is the folder of tables (default sf0.1), ``BENCH_CPUS`` the number of local cores.
Every result row is produced (written to the no-op sink).  The ``preset_*`` entries run the whole
ladder on generated data of the standard small, medium and large sizes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from encircle.catalog.queries import EPSILON, QUERIES, K
from encircle.plans.greedy import greedy_solution
from encircle.sources.generate import PRESETS, generate_preset

HEADLINE = [
    "covered_points",
    "marginal_gains",
    "set_coverage",
    "first_candidate",
    "stratified_sample",
    "uniform_sample",
    "cell_density",
    "gen_points",
    "circle_ordinal",
    "segment_by_marker",
    "latest_run",
    "guess_series",
    "run_snapshot",
    "stream_snapshot",
    "worker_utilisation",
    "active_apps",
    "coverage_pairs",
    "coverage_by_circle",
    "greedy_single_tau",
    "greedy_solution",
]


def drain(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["cell_density"](spark, folder))  # start-up, not timed

    timings: dict[str, float] = {}

    def measure(name, build) -> None:
        started = time.perf_counter()
        drain(build())
        timings[name] = round(time.perf_counter() - started, 3)

    for name in HEADLINE:
        measure(name, lambda name=name: QUERIES[name](spark, folder))
    for name in PRESETS:
        measure(
            f"preset_{name}",
            lambda name=name: greedy_solution(*generate_preset(spark, name), K, EPSILON),
        )
    result = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
