"""Headline queries on the given tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from kinfold.plans import registry
from kinfold.session import local_session

HEADLINE = [
    "m1_roc_auc", "m4_repeat_metrics", "k1_model_selection", "a11_class_strata", "m5_multiclass_metrics", "m14_spearman",
    "g1_connected_blocks", "g7_holdout_candidates", "b1_pairwise_auc_groups", "b2_macro_f1_difference", "b7_component_inference",
    "i2_knn_completion", "c1_feature_concordance", "a2_cohort_flow", "a16_attribution_rollup", "l1_random_forest", "l2_gradient_boosting",
    "l3_kernel_svm", "l4_mlp_resampled", "x1_tree_attribution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry.load()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the JVM's first job outside the clock
    seconds = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
