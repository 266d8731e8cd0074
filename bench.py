"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores. Each query
is run twice over its whole tables and the shorter time counts. The run whose rate is reported
comes last, in a JVM that is warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerprep.session import TUNING  # noqa: E402
from workloads.catalog import QUERIES  # noqa: E402

HEADLINES = [
    "run_kpis", "tax_id_check", "iban_check", "address_split", "text_clean",
    "mm_rules", "bom_rules", "routing_rules", "cost_deviation", "margin_impact", "abc_class", "inventory_kpis",
    "exact_duplicates", "type_profile", "exact_key_groups", "fuzzy_pairs_indel", "leader_clusters", "merge_fields",
    "clean_and_material_rules",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in TUNING.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        spent = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(min(spent), 3)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("part", "customer", "lineitem")}
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "rows": rows,
                "rows_per_sec_clean_and_material_rules": round(rows["part"] / seconds["clean_and_material_rules"]),
                "rows_per_sec_fuzzy_dedupe": round(rows["part"] / seconds["leader_clusters"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
