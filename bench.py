"""Time the headline queries; prints one JSON line.

Every query is timed from the parquet files: fitted sets are dropped before each
run, so a question about a set includes finding the set.  One untimed pass over
the smallest data warms the JVM.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from catalog import queries as catalogue

HEADLINE = [
    "pattern_compaction",
    "itemset_counts_3",
    "lookahead_objective_d3",
    "root_histogram",
    "root_histogram_lineitem",
    "root_histogram_d3",
    "histogram_depth5",
    "tree_paths",
    "predict_tree",
    "majority_vote",
    "correct_counts",
    "reliance_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("grovelight-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            catalogue.CATALOGUE[name](spark, warm).write.format("noop").mode("overwrite").save()

    def large(mult: float):
        """The number of trees of a wide depth-4 set over 9 features."""
        found = catalogue.model(spark, sf_dir, "ord_score", lambda_reg=0.01, depth_budget=4, rashomon_mult=mult)
        return int(found.count_trees().first()[0])

    timings = {}
    for name in HEADLINE:
        catalogue.forget()
        start = time.perf_counter()
        catalogue.CATALOGUE[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    sets = {}
    for name, mult in (("large_set_mult_0.5", 0.5), ("large_set_mult_1.0", 1.0)):
        catalogue.forget()
        start = time.perf_counter()
        counted = large(mult)
        timings[name] = round(time.perf_counter() - start, 3)
        sets[name] = {"trees": counted, "trees_per_sec": round(counted / timings[name]), "features": 9, "depth": 4, "lookahead": 1, "mult": mult}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "near_optimal_tree_sets_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "rows": {"orders": catalogue.rows(spark, sf_dir, "orders"), "lineitem": catalogue.rows(spark, sf_dir, "lineitem")},
                "cores": int(cpus),
                "sets": sets,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
