"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stopover.plans import registry
from stopover.session import get_spark

# One query per product: retrieval, evaluation, network, walking, routing, evidence.
HEADLINE = [
    "knn_exact", "knn_all", "knn_approx", "knn_ndcg", "rule_stats", "embed_ngram", "exact_search",
    "build_stations", "reachable", "reach_from", "detour_stations", "suggest_reach_first",
    "snap_to_network", "station_place_walks", "connected_components", "stations_near_places", "match_area",
    "route_posts_v1", "topic_accuracy", "bcubed", "post_context", "evidence_scores", "changed_texts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", cores=cpus)
    queries = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
