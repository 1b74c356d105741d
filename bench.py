"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "markdown_full", "markdown_dom", "markdown_auto", "markdown_front_matter", "page_metadata_given",
    "candidates", "extraction_decision", "clean_text", "resolve_links", "decode_responses",
    "meaningful_pages", "select_capture", "page_stats", "output_collisions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str, directory: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    # Starting the JVM's and Python's workers is not part of any query.
    seconds("markdown_full", sf_dir)
    timings = {name: round(seconds(name, sf_dir), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "total seconds over headline queries",
        "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "pages": spark.read.parquet(f"{sf_dir}/pages.parquet").count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
