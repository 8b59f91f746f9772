"""Time the headline queries at one scale and print a single JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "row_features", "entity_history_events", "entity_history_lineitem", "split_history_summary", "frequency_encoding",
    "enrich_documents", "missingness_report", "category_rates", "numeric_summary", "chi_square_test", "rank_test",
    "psi_lineitem", "ranking_metrics", "cost_sweep", "reliability_table", "top_reasons", "narratives",
    "document_chunks", "groundedness", "cosine_top_k", "csv_round_trip", "time_ordered_fact_table",
]


def main() -> None:
    from causalrisk import build_session
    from causalrisk.catalog import all_queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = [q for q in HEADLINE if not sys.argv[1:] or q in sys.argv[1:]]
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    taken: dict[str, float] = {}
    for name in chosen:
        seconds = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        taken[name] = round(statistics.median(seconds[1:]), 3)
        print(f"{name} {taken[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, median wall time summed", "value": round(sum(taken.values()), 3), "unit": "sec",
        "queries": taken, "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
