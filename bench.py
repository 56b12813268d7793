"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is first run untimed on the smallest test tables (same plan
shapes, so the JVM JIT and Spark's generated-code cache are warm), then timed
once at the requested scale with its result written to Spark's ``noop`` sink
(every row is computed, nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wren.plans.catalog import load_all  # noqa: E402
from wren.session import get_session  # noqa: E402

HEADLINE = [
    "top_topics", "top_authors", "engagement_stats", "feature_importance", "pipeline_status",
    "iqr_outliers", "cluster_top_tags", "cap_per_author", "landing_flatten", "upsert_features",
    "insert_new_posts", "feedback_match", "variation_metrics", "epsilon_update", "valid_requests",
    "in_flight", "reuse_scored", "lexicon_sentiment", "extract_topics", "preprocess_text",
    "stream_admission_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    queries = load_all()
    warm_dir = "/root/testdata/sf0.001"
    timings: dict[str, float] = {}
    for name in names:
        if os.path.isdir(warm_dir):
            queries[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        df = queries[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
