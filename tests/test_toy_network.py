"""Two lines, ten stations, one transfer, with minutes worked out by hand.

Line A (40 km/h, conventional) has stations A1..A5, line B B1..B5, both spaced so that a
platform takes no measurable time and a hop takes a known number of minutes. A3 and B3 share
group GX. The arcs are given in minutes directly, so every expected value is a small sum.
"""

import pytest
from pyspark.sql import functions as F

from stopover.operators import graph, network, reach
from stopover.operators.network import Network


def _station(code, name, group, line, a, b, lon, lat):
    return (code, name, group, line, int(a), int(a), int(b), float(lon), float(lat))


STATION = "station_code string, station_name string, group_code string, line_id long, edge_id long, node_a long, node_b long, lon double, lat double"


@pytest.fixture(scope="module")
def net(spark):
    rows, arcs = [], []
    # nodes: line 1 uses 10..19, line 2 uses 20..29; platform i has ends 2i and 2i+1, 1 minute apart
    for line, base, names in ((1, 10, ["A1", "A2", "X", "A4", "A5"]), (2, 20, ["B1", "B2", "X", "B4", "B5"])):
        for i, n in enumerate(names):
            group = "GX" if n == "X" else f"G{n}"
            rows.append(_station(f"S{line}{i}", n, group, line, base + 2 * i, base + 2 * i + 1, 139.5 + 0.05 * i, 35.5 + 0.05 * line))
            arcs.append((base + 2 * i, base + 2 * i + 1, 1000))
            if i:
                arcs.append((base + 2 * i - 1, base + 2 * i, 6000))
    rows.append(_station("S30", "Far", "GF", 3, 90, 91, 140.5, 36.5))  # unreachable
    rows.append(_station("S31", "A1", "GOTHER", 3, 92, 93, 140.5, 36.5))  # same name far away
    st = spark.createDataFrame(rows, STATION)
    edges = spark.createDataFrame(arcs, "source long, target long, c long")
    lines = spark.createDataFrame([(1, "op", "A"), (2, "op", "B"), (3, "op", "C")], "line_id long, operator string, line_name string")
    return Network(lines, st, network.both_ways(edges, F.col("c")).unionByName(network.transfer_arcs(st)))


def test_reach_from_adds_wait_except_at_origin(net):
    got = {r["group_code"]: r["t_min"] for r in reach.reach_from(net, "GA1", 60).collect()}
    # A1's far end is a start too, so A2 is one hop of 6; X is 6+1+6; B4 changes at X (node_a to node_a, 10).
    assert got["GA1"] == 0
    assert got["GA2"] == 6 + 5
    assert got["GX"] == 6 + 1 + 6 + 5
    assert got["GB2"] == 13 + 10 + 6 + 5
    assert got["GB4"] == 13 + 10 + 1 + 6 + 5
    assert "GF" not in got


def test_reachable_rounds_filters_and_drops_ends(net):
    rows = {r["group_code"]: r for r in reach.reachable(net, "GA1", "GA5", 60, 10).collect()}
    assert "GA1" not in rows and "GA5" not in rows
    x = rows["GX"]
    assert (x["t1_min"], x["t2_min"]) == (18, 18)
    assert x["slack_min"] == 60 - 10 - 36
    with_ends = {r["group_code"] for r in reach.reachable(net, "GA1", "GA5", 60, 10, include_ends=True).collect()}
    assert {"GA1", "GA5"} <= with_ends


def test_detour_roles_and_route(net):
    rows = {r["group_code"]: r for r in reach.detour_stations(net, "GA1", "GA5", 60).collect()}
    assert rows["GA1"]["role"] == "origin" and rows["GA5"]["role"] == "dest" and rows["GA2"]["role"] == "via"
    assert rows["GA1"]["t1_min"] == 0 and rows["GA5"]["t2_min"] == 0
    route = reach.detour_route(net, "GA1", "GB5").orderBy("seq").collect()
    assert [r["group_code"] for r in route] == ["GA1", "GA2", "GX", "GB4", "GB5"]
    assert route[0]["t1_min"] == 0
    assert route[-1]["t1_min"] == 13 + 10 + 1 + 6 + 1 + 6 + 5


def test_unreachable_route_is_empty(net):
    assert reach.detour_route(net, "GA1", "GF").count() == 0


def test_station_names(net):
    with pytest.raises(graph.StationNotFound):
        graph.resolve_station(net.stations, "nowhere")
    with pytest.raises(graph.AmbiguousStation):
        graph.resolve_station(net.stations, "A1")
    with pytest.raises(graph.AmbiguousStation):
        graph.resolve_station(net.stations, "A1", 1500.0)
    assert graph.resolve_station(net.stations, "X").count() == 1


def test_transfers_join_different_lines_only(spark):
    """A line with two platforms in a group: its platforms are joined through a third line only."""
    st = spark.createDataFrame(
        [_station(f"S{i}", "n", "G", line, 10 * i, 10 * i + 1, 0, 0) for i, line in enumerate([7, 7, 8, 9], 1)], STATION
    )
    seeds = st.select(F.col("station_code").alias("origin"), F.col("node_a").alias("node"), F.lit(0).alias("cost"))
    cost = {(r["origin"], r["node"]): r["cost"] for r in graph.shortest_costs(network.transfer_arcs(st), seeds, 60000).collect()}
    assert cost[("S1", 30)] == 10000 and cost[("S3", 40)] == 10000
    assert cost[("S1", 20)] == 20000
    pairs = network.build_transfers(st).count()
    counted = network.transfer_counts(st).first()["transfers"]
    assert pairs == counted == 5


def test_speed_override_and_missing_station(spark):
    lines = spark.createDataFrame([(1, "op", "A")], "line_id long, operator string, line_name string")
    st = spark.createDataFrame([_station("a", "a", "a", 1, 1, 2, 0, 0), _station("b", "b", "b", 1, 4, 5, 0, 0)], STATION)
    edges = spark.createDataFrame([(i, 1, i, i + 1, 100.0) for i in range(1, 6)], "edge_id long, line_id long, source long, target long, length_m double")
    asked = spark.createDataFrame(
        [(1, "op", "A", "a", "b", 60.0), (2, "op", "A", "a", "a", 70.0), (3, "op", "A", "a", "zz", 80.0)],
        "id int, operator string, line_name string, from_station string, to_station string, speed_kmh double",
    )
    chosen, missing = graph.resolve_overrides(asked, lines, st, edges)
    assert {r["edge_id"] for r in chosen.where("speed_kmh = 60").collect()} == {1, 2, 3}
    assert [r["id"] for r in missing.collect()] == [3]


def test_detour_areas_follow_the_greedy_order(spark):
    """Leaders by rank; a station joins the first leader that reaches it, not the nearest."""
    step = 0.012  # about 1.09 km of longitude at this latitude
    rows = [(f"G{i}", f"n{i}", "l", 10.0, 10.0, float(s), "via", 139.0 + step * i, 35.0) for i, s in enumerate([20, 40, 30, 25, 60])]
    rows.append(("GO", "o", "l", 0.0, 18.0, 100.0, "origin", 120.0, 30.0))
    st = spark.createDataFrame(rows, "group_code string, station_name string, lines string, t1_min double, t2_min double, slack_min double, role string, lon double, lat double")
    spots = spark.createDataFrame([(1, "sample", "p", "G2", 20.0), (2, "wikidata", "q", "G0", 15.0)], "spot_id int, source string, name string, via_group string, stay_min double")
    got = {r["area"]: r for r in reach.detour_areas(st, spots).collect()}
    # G2 leads by its voiced place and takes G1 and G3; G0 has a place and is too far from G2; G4 is alone.
    assert set(got) == {"G2", "G0", "G4", "GO"}
    assert got["G2"]["members"] == 3 and got["G2"]["stay"] == 40 and got["G2"]["detour"] == 2


def test_impact_of_another_walking_table(spark):
    from stopover.operators import suggest

    walk = "group_code string, spot_id int, walk_min double"
    before = [("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 2.0), ("b", 1, 8.0), ("b", 4, 4.0), ("b", 4, 6.0)]
    after = [("a", 1, 1.0), ("a", 2, 9.5), ("b", 1, 8.0), ("b", 4, 9.0), ("b", 5, 3.0), ("c", 5, 7.0)]
    a, b = spark.createDataFrame(before, walk), spark.createDataFrame(after, walk)
    r = suggest.impact_report(a, b, k=2).first().asDict()
    # Nearest walks: 1: 5 -> 1, 2: 9 -> 9.5, 4: 4 -> 9; 3 is lost, 5 is gained.
    assert (r["pairs"], r["nearer"], r["farther"], r["same"]) == (3, 1, 1, 1)
    assert (r["p20"], r["p50"], r["p80"]) == (-4.0, 0.5, 5.0) and abs(r["mean_delta"] - 0.5) < 1e-12
    # Pairs: a3 gone, b5 and c5 come, four stay.
    assert (r["pairs_both"], r["pairs_gone"], r["pairs_come"], r["pairs_churn"]) == (4, 1, 2, 3 / 7)
    # Two nearest places: a: 3, 1 -> 1, 2; b: 4, 1 -> 5, 1; c: none -> 5.
    assert (r["stations"], r["stations_changed"], r["top_both"], r["top_gone"], r["top_come"], r["top_moved"]) == (3, 3, 2, 2, 3, 1)


def test_delta_matrix_of_six_variants(spark):
    import itertools
    import random

    from stopover.operators import suggest

    rng = random.Random(4)
    rows = [(v, g, s, rng.randrange(0, 40) / 4) for v in "abcdef" for g in "xyz" for s in range(20) for _ in range(rng.randrange(0, 3))]
    got = {(r["a"], r["b"]): r for r in suggest.delta_matrix(spark.createDataFrame(rows, "variant string, group_code string, spot_id int, walk_min double")).collect()}
    least = {}
    for v, g, s, m in rows:
        least[v, g, s] = min(m, least.get((v, g, s), m))
    assert len(got) == 15
    for a, b in itertools.combinations("abcdef", 2):
        d = sorted(least[b, g, s] - least[a, g, s] for v, g, s in least if v == a and (b, g, s) in least)
        r = got[a, b]
        assert (r["pairs"], r["nearer"], r["farther"]) == (len(d), sum(x <= -3 for x in d), sum(x >= 3 for x in d))
        assert r["same"] == len(d) - r["nearer"] - r["farther"] and abs(r["mean_delta"] - sum(d) / len(d)) < 1e-9
        assert r["p50"] == d[min(len(d) - 1, round(0.5 * (len(d) - 1)))] or r["p50"] in d
