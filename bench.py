"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR names the dataset directory, BENCH_CPUS the number of local cores. Each query
is planned and run in full twice on the same table definitions; the second (warm) run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from aislelens.plans import catalog  # noqa: E402
from aislelens.sources.retail import RetailTables  # noqa: E402

HEADLINE = [
    "cohort_avg_retention",
    "cohort_month_change",
    "rfm_fixed_bins",
    "rfm_ntile_segments",
    "customer_lifetime_value",
    "customer_category_basket",
    "next_product_symmetry",
    "next_category_propensity",
    "next_category_demand",
    "product_reorder_gap",
    "late_penalty",
    "delay_vs_next_value",
    "delivery_timing_feedback",
    "hourly_delivery_feedback",
    "monthly_negative_rank",
    "qoq_growth",
    "quarterly_performance",
    "monthly_category_contribution",
    "monthly_top5_products",
    "area_product_rank",
    "order_value_audit",
    "iqr_inliers",
    "dup_feedback_customer",
    "null_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("aislelens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = RetailTables(spark, sf_dir)
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.JOBS[name](tables).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
