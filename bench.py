"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Each query runs once
to warm up and then three times; the median counts, including the time to plan.
``scaled`` repeats the readings 100 times to show throughput.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gaugework as gw
from checks import fixtures
from checks.catalog import QUERIES
from checks.testdata import readings
from gaugework.session import local_session

HEADLINE = (
    "latest_values",
    "raw_data_stats",
    "continuous_eval",
    "failed_executions",
    "whatif_scenarios",
    "scalar_domain",
    "window_readings",
    "windowed_sum",
    "windowed_avg",
    "windowed_last",
    "executions_latest",
    "executions_summary",
    "batch_stats",
)
COPIES = 100


def timed(query, spark: SparkSession, folder: str, runs: int = 3) -> float:
    times = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times[1:]), 3)


def continuous_scaled(spark: SparkSession, folder: str) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")
    rows = readings(spark, folder).repartition(spark.sparkContext.defaultParallelism)
    many = rows.select("*", copies).withColumn("id", F.col("id") * COPIES + F.col("copy"))
    return gw.evaluate(many.drop("copy"), fixtures.table(spark, fixtures.CONTINUOUS))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "gaugework-bench")
    queries = {name: timed(QUERIES[name], spark, folder) for name in HEADLINE}
    scaled = timed(continuous_scaled, spark, folder, runs=1)
    rows = readings(spark, folder).count() * COPIES
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "scaled": {"continuous_eval_sec": scaled, "readings": rows},
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
