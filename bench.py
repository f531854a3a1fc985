"""Headline queries timed at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "src01_read_wide",
    "nrm02_log1p_cpm",
    "nrm05_centre_unit_rows",
    "aln01_align",
    "aln11_collapse_features",
    "agg10_mean_vectors",
    "agg13_union_length",
    "agg16_exact_percentile",
    "win06_top_k",
    "met01_auroc_large_groups",
    "met05_spearman",
    "met18_imputation_summary",
    "sta02_random_effects",
    "sta05_bootstrap_interval",
    "vec02_exact_knn",
    "vec05_centroid_scores",
    "vec13_coexpression",
    "spl03_stratified_group_kfold",
    "ml01_leave_one_cohort_out",
    "entry1_atlas_match",
    "entry2_prepare_corpus",
    "entry3_leaderboard",
]


def main() -> None:
    from exprlake.plans.catalog import REGISTRY
    from exprlake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before timing
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
