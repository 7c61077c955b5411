"""Time the headline queries; prints one JSON line.

Each query is read to the end with a ``noop`` sink after one small warm-up
query, so that JVM start-up is not charged to the first one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vicinity.queries import catalogue  # noqa: E402
from vicinity.session import build_session  # noqa: E402

HEADLINE = [
    "near_event_counts", "proximity_edges", "neighbor_counts", "fire_features", "crime_features", "permits_features",
    "density_regularized", "neighborhood_score", "weather_lookback", "event_timeline", "label_generation",
    "panel_means_changes", "owner_counts", "area_rate_year", "area_rate_months", "multi_category_pivot",
    "crosstab_total", "frequent_levels", "score_ranks", "percentile_of_score", "top_share_ties", "top_per_group",
    "drop_all_repeats", "list_overlap", "dataset_assembly", "median_impute", "standard_scale", "column_profile",
    "precision_at_ignore_nas", "precision_curve", "roc_auc", "points_in_areas", "incremental_edges",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    known = catalogue()
    known["crosstab_total"][0](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        known[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
