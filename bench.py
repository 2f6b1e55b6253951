"""Time headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose input and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from telltale import catalog
from telltale.session import create_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "label_windows", "prepare_dataset", "rule_confusion", "rule_score", "ema_span10", "rolling_burst", "rolling_std",
    "process_baseline", "parent_normalize", "child_tree_join", "percentile_rank", "global_jump", "process_stats",
    "period_summary", "balance_classes", "stratified_split", "evaluate_models", "roc_auc", "top_metrics_per_row",
    "attack_lookup", "robust_scale", "smote_neighbours", "gbt_primary", "training_features",
]


def main() -> None:
    spark = create_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
                           spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths on the smallest tables, so the first query is not charged for them
    catalog.QUERIES["rolling_std"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
