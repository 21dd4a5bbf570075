"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evalloom.queries import QUERIES  # noqa: E402
from evalloom.session import local_session  # noqa: E402

HEADLINE = [
    "fold_support", "count_features", "order_count_experiment", "document_experiment", "paired_bootstrap", "rank_blend", "auc_of_lines",
    "fused_labels", "key_overlap_audit", "duplicate_groups", "multi_window_schedule", "ordered_slices", "attention_scores", "event_stack_features",
    "exact_quantiles", "cell_checks", "wide_experiment", "wide_reduced_heads",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
