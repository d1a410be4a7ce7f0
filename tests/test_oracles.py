"""Registered queries against their SQL; tools/check.py runs all of them."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import rows_of

from stopover.plans import registry

NAMES = [
    "build_ride_edges", "build_stations", "build_transfers", "walk_graph", "snap_to_network", "driving_distance",
    "reachable", "detour_stations", "detour_spots", "isochrone_bands", "suggest_reach_first", "station_place_walks",
    "knn_exact", "knn_ndcg", "knn_all", "knn_approx", "common_threshold", "rule_stats", "best_f1_threshold",
    "exact_search", "embed_ngram", "kappa", "weighted_kappa", "agreement_bands", "percentile_rounded", "auc", "best_threshold",
    "topic_accuracy", "bcubed", "bcubed_strict", "reply_chains", "post_context", "nearest_post", "merge_chunks",
    "evidence_scores", "apply_changes", "finalise_questions", "validate_evidence", "match_area", "line_area_crossings",
    "station_exits", "cover_trails", "timetable_coverage", "geojson_roundtrip", "collapse_places", "upsert", "changed_texts",
    "stream_merge_chunks",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(registry.oracles()[name])
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
