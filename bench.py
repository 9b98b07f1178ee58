"""Times the headline queries once each and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cargolens.plans.queries import QUERIES  # noqa: E402
from cargolens.session import local_session  # noqa: E402

HEADLINES = [
    "dashboard_kpis", "supplier_scorecard", "supplier_trend", "performance_decline",
    "order_list", "answer_questions", "supplier_search", "delay_spikes", "value_outliers",
    "quantity_outliers", "isolation_forest", "delay_features", "median_impute",
    "stratified_split", "delay_model_scores", "delay_metrics", "chunk_sections",
    "tfidf_weights", "retrieve_topk", "dense_topk", "extractive_answers", "qa_evaluation",
    "instruction_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, shuffle_partitions=int(cores))
    # The session's first job pays for start-up; it belongs to no query.
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        # The noop sink computes every row and column without collecting them.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)),
            }
        )
    )


if __name__ == "__main__":
    main()
