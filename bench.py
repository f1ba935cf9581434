"""Time the headline reports and print one JSON line.

Tables come from $BENCH_SF_DIR, cores from $BENCH_CPUS. Each report runs once to warm up
and then three times; the median counts. All rows and columns are produced (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from holdfast.plans.catalogue import CATALOGUE  # noqa: E402
from holdfast.session import local_session  # noqa: E402

HEADLINE = [
    "risk_band_summary",
    "mrr_at_risk",
    "scored_customers",
    "clean_zero",
    "clean_median",
    "table_shape",
    "missing_counts",
    "profile_all",
    "profile_numeric",
    "median_exact",
    "median_approx",
    "churn_by_contract",
    "leaving_rate_by_contract",
    "leaver_tenure_histogram",
    "leaver_tenure_density",
    "charges_box_by_churn",
    "score_box_by_contract",
    "tenure_charges_grid",
    "category_labels",
    "category_index",
    "assembled_features",
    "train_test_split",
    "model_scores",
    "auc_exact",
    "recall_threshold",
    "customer_view",
    "complaints_deduplicated",
    "billing_cycles",
    "look_ahead_labels",
    "complaint_text_features",
    "usage_by_user",
    "usage_by_day",
]


def once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    CATALOGUE[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names:
        once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(once(spark, name, sf_dir) for _ in range(3)), 4)
    print(
        json.dumps(
            {
                "metric": "total median seconds of headline reports",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
