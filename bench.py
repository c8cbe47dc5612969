"""Headline stages on the driver's tables; prints one JSON line.

Every stage starts from the raw tables or from the written samples of an
earlier stage, as in production, and is forced through a full write or count.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from symptra.plans import inputs, pipeline, registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
DRAWS = int(os.environ.get("BENCH_DRAWS", "1000"))
OPERATORS = ["prevalence_cells", "demographics_table", "add_row_id", "delay_cells", "per_capita_bands", "prevalence_summary"]


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("symptra-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.maxConcurrentOutputFileWriters", "64")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    for name in OPERATORS:
        timed(name, lambda: consume(registry.QUERIES[name](spark, SF_DIR)))
    with tempfile.TemporaryDirectory(prefix="symptra-bench-") as out:
        stages = pipeline.Pipeline(
            spark,
            inputs.submissions_raw(spark, SF_DIR),
            inputs.population(spark, SF_DIR),
            inputs.search_trends(spark, SF_DIR),
            out,
            DRAWS,
        )
        for name in stages.STAGES:
            timed(f"stage_{name}_{DRAWS}", getattr(stages, name))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "draws": DRAWS,
            }
        )
    )


if __name__ == "__main__":
    main()
