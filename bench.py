"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query
is run once to warm the workers and then timed, its rows written to a null sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lexloom.plans import queries as core

HEADLINE = [
    "count_tokens",
    "count_tokens_o200k",
    "count_by_lang",
    "pretok_cl100k",
    "encode_batch_sums",
    "offsets_byte",
    "decode_roundtrip",
    "truncate_tokens",
    "count_with_specials",
    "estimate_count",
    "page_html_count",
    "conversation_tokens",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Small inputs still use every core.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, seconds = core.queries(), {}
    for name in HEADLINE:
        query = registered[name]
        query(spark, folder).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
