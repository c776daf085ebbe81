"""Benchmark: one JSON line with seconds per headline query.

Environment: ``BENCH_SF_DIR`` (data folder), ``BENCH_CPUS`` (local cores),
``BENCH_QUERIES`` (comma-separated names, optional). Every query runs once to
warm up and once measured; the whole result is computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "scan_filter",
    "dataset_profile",
    "full_profile",
    "column_counts",
    "numeric_stats",
    "string_lengths",
    "top_values",
    "value_patterns",
    "auto_rules",
    "rule_set",
    "rule_unique_multi",
    "rule_fk_table",
    "rule_consistency",
    "rule_accuracy",
    "failing_samples",
    "dataset_score",
    "score_drift",
    "text_duplicates",
    "near_duplicates",
    "document_profile",
    "table_cells",
    "semantic_types",
    "redact_text",
    "completion_cache",
    "image_profile",
)


def main() -> None:
    from plumbob.plans.queries import QUERIES
    from plumbob.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("plumbob-bench", os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
