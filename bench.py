"""Time the headline queries; prints one JSON line.

``queries`` is the run as in use: it starts without stored results, and an intermediate table that several queries share
(customer features, scaled features, rows per period) is made by the first query that needs it and counts in its time.
``cold`` has queries from the tables, with nothing stored before them, for as long as BENCH_COLD seconds (150) last.
"""

from __future__ import annotations

import json
import os
import time

from shoplens.plans.registry import registered_queries
from shoplens.plans.workspace import close_workspaces
from shoplens.session import build_session

HEADLINE = (
    "late_deliveries", "recent_deliveries", "high_revenue_sellers", "new_engaged_sellers", "worst_postcodes",
    "postcode_review_map", "rfm_features", "satisfaction_features", "behavior_features", "combined_features",
    "features_with_dates", "correlation_matrix", "feature_box_stats", "column_summary", "density_histogram",
    "outlier_summary_all_methods", "transform_features", "inverse_transform", "pca_projection", "kmeans_fit",
    "elbow_table", "inertia_by_k", "silhouette_samples", "stratified_sample", "silhouette_euclidean_sample",
    "kmeans_feature_importance", "importance_fixed_centers", "intercluster_distances", "bootstrap_stability",
    "pairwise_ari", "temporal_stability", "cluster_migration", "cross_period_stability", "cluster_stats",
    "cluster_metrics_table", "segment_actions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "shoplens-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered_queries()

    def timed(name: str) -> float:
        started = time.perf_counter()
        # The no-op sink runs the whole plan without moving rows to the driver.
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    for name in ("rfm_features", "transform_features"):
        queries[name](spark, folder).collect()
    close_workspaces()
    shared = {name: timed(name) for name in HEADLINE}
    close_workspaces()
    cold = {}
    began = time.perf_counter()
    for name in HEADLINE:
        if time.perf_counter() - began > float(os.environ.get("BENCH_COLD", "150")):
            break
        cold[name] = timed(name)
        close_workspaces()
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(shared.values()), 3),
                      "unit": "sec", "queries": shared, "cold": cold, "cold_value": round(sum(cold.values()), 3),
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
