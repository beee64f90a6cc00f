"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "r7_suffix_matrix", "a11_suffix_aggregate", "a12_serving_aggregate", "a18_generated_features",
    "a17_contract_aggregate", "r2_flatten_nested", "r3_flatten_stacked", "r4_feature_matrix",
    "b2_fine_class_report", "b4_fine_bins", "v1_auc", "v4_stability", "w1_group_count", "w4_back_fill",
    "o2_top_values", "a20_type_aggregate",
)


def session():
    from pyspark.sql import SparkSession

    from strataform.session import SETTINGS

    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("strataform")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from battery import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - start)
        took[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
