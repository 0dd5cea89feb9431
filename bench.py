"""Time the headline queries; prints one JSON line.

Every query is built and fully evaluated (all columns, through the no-op sink) once
to warm up and once timed. The groups follow the kinds of work the package does.
"""

from __future__ import annotations

import json
import os
import time

HEADLINES = [
    # row-wise
    "custom_formula", "regex_replace", "extract_domain_of_text", "date_parts_default", "filter_greater", "log_transform",
    # one aggregate, then row-wise
    "fill_null_mean", "min_max_scale_many", "standardize", "group_mean", "filter_group_sort",
    # exact order statistics
    "fill_null_median", "robust_scale", "cap_clip", "detect_iqr", "remove_outliers_iqr", "binning_equal_frequency",
    # schema from data
    "one_hot_encode", "label_encode_many_values", "pivot_mean", "split_column",
    # row order
    "ffill", "bfill", "interpolate", "rolling_mean", "drop_rows_index", "sort_ascending",
    # distinct rows and samples
    "remove_duplicates", "deduplicate_subset_first", "sample_fraction_size",
    # profiles
    "column_statistics", "describe", "histogram_profile", "correlation_matrix", "duplicate_rows", "unique_values",
    # chart data
    "chart_box", "chart_histogram_auto", "chart_hexbin", "chart_kde", "chart_top_n",
    # models
    "split_sizes", "linear_regression", "naive_bayes", "nearest_neighbors", "decision_tree_regressor", "random_forest_classifier",
    "gradient_boosting_regressor", "adaboost_classifier", "kmeans", "dbscan", "clustering_metrics", "silhouette_all_rows",
    "chart_violin", "csv_round_trip",
    # two tables
    "heavy_key_join", "overlapping_orders", "asof_last_view", "band_join_orders",
    # groups and order
    "cube_orders", "distinct_lines", "rank_quantities", "neighbours_of_events", "sessions_of_users", "turns_from_json",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tablewright.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINES:
        run(name)
        times[name] = round(run(name), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
