"""What a step moves, keeps or sends round does not outgrow its input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stopover.functions.geo import LINE
from stopover.operators import graph, network, places, spatial, vectors


def test_arcs_are_dealt_once_and_hubs_stay_in_chunks(spark):
    arcs = spark.range(5000).select(F.lit(1).cast("long").alias("source"), F.col("id").alias("target"), (F.col("id") % 7 + 1).alias("cost"))
    arcs = arcs.unionByName(arcs.withColumn("cost", F.lit(3).cast("long"))).unionByName(spark.sql("select 2L as source, 1L as target, 5L as cost"))
    packed = graph.adjacency(arcs)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan
    rows = packed.collect()
    assert max(len(r["out"]) for r in rows) < 2 * graph.ADJACENCY_CHUNK
    best = {(r["node"], a["target"]): a["cost"] for r in rows for a in r["out"]}
    assert best == {**{(1, i): min(i % 7 + 1, 3) for i in range(5000)}, (2, 1): 5}
    assert sum(len(r["out"]) for r in rows) == 5001


def test_stations_need_no_adjacency(spark):
    line = F.array(F.struct(F.col("x").alias("lon"), F.lit(35.0).alias("lat")), F.struct((F.col("x") + 0.001).alias("lon"), F.lit(35.0).alias("lat"))).cast(LINE)
    platforms = spark.createDataFrame([("L", "S1", 139.0), ("L", "S2", 139.001), ("M", "S3", 139.0)], "line_name string, station_code string, x double").select(
        F.lit("O").alias("operator"), "line_name", F.lit("11").alias("rail_class"), F.lit("4").alias("operator_type"),
        "station_code", F.col("station_code").alias("station_name"), F.lit("G").alias("group_code"), line.alias("line"))
    net = network.build_network(platforms, platforms.select("operator", "line_name", "rail_class", "operator_type", "line"))
    assert net.stations.count() == 3 and "adj" not in vars(net)
    assert network.transfer_counts(net.stations).first()["transfers"] == 2 and "adj" not in vars(net)
    a = net.stations.where("station_code = 'S1'").select(F.lit("o").alias("origin"), F.col("node_a").alias("node"), F.lit(0).alias("cost"))
    assert graph.shortest_costs(net.arcs, a, None, adj=net.adj).count() > 4 and net.adj is net.adj


def _vectors(spark, n, seed, key):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)], f"{key} long, embedding array<double>")


def test_products_are_taken_in_slices(spark, monkeypatch):
    items = _vectors(spark, 150, 5, "item_id")
    queries = items.withColumnRenamed("item_id", "qid")
    cells = items.select(F.lit("g").alias("g"), F.col("item_id").alias("id"), "embedding")

    def both():
        rows = vectors.knn_exact(items, queries, 4).unionByName(vectors.knn_exact(items, queries, 4, exclude_self=True))
        inside = vectors.knn_within(cells, cells.withColumnRenamed("id", "qid"), "g", 4)
        return sorted(map(tuple, rows.select("qid", "rank", "id").collect())), sorted(map(tuple, inside.select("g", "qid", "rank", "id").collect()))

    want = both()
    for block in (vectors.QUERY_BLOCK, 40):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "SCORES", 600)
        assert max(hi - lo for lo, hi in vectors._slices(150, 40)) == 15
        assert both() == want


@pytest.mark.parametrize("blocks", [None, 30])
def test_searches_by_best_vector_hand_on_items_not_vectors(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
        monkeypatch.setattr(vectors, "CORPUS_BLOCK", blocks)
        monkeypatch.setattr(vectors, "SCORES", 100)
    names = _vectors(spark, 120, 6, "normalized_name")
    link = names.select("normalized_name", F.when(F.col("normalized_name") % 13 != 5, F.col("normalized_name") % 13).alias("item_id"))
    queries = _vectors(spark, 25, 7, "qid")
    sims = vectors.similarities(queries, names, "normalized_name").join(link, "normalized_name").groupBy("qid", "item_id").agg(F.max("score").alias("score"))
    want = [(r["qid"], r["rank"], r["item_id"]) for r in vectors._ranked(sims, ["qid"], 3).collect()]
    got = [(r["qid"], r["rank"], r["item_id"]) for r in vectors.subject_search(queries, names, link, 3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[2] is None for r in got)
    linked = names.join(link, "normalized_name")
    assert vectors.best_by_item(queries, linked).count() <= 25 * 13 * (4 if blocks else 1) < 25 * 120
    assert vectors.best_by_item(queries, linked, 3).count() <= 25 * 3 * (4 if blocks else 1)


def test_exploded_sides_are_not_broadcast(spark):
    points = spark.range(40).select(F.col("id").alias("p"), (F.lit(139.0) + F.col("id") * 0.001).alias("lon"), F.lit(35.0).alias("lat"))
    near = spatial.within_distance(points, points.withColumnRenamed("p", "a"), 300.0, "p")
    corner = F.array(*[F.struct((F.col("lon") + 0.001 * x).alias("lon"), (F.col("lat") + 0.001 * y).alias("lat")) for x, y in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]]).cast(LINE)
    areas = points.select(F.col("p").alias("area_idx"), F.array(corner).alias("rings"))
    inside = spatial.points_in_areas(points, areas, "p", "area_idx")
    ways = points.select(F.col("p").alias("way_id"), F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 0.005).alias("lon"), "lat")).cast(LINE).alias("line"))
    met = spatial.line_area_crossings(ways, areas, "way_id", "area_idx")
    for df in (near, inside, met):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
        assert df.count() > 40


def test_stations_stay_where_they_lie(spark, monkeypatch):
    def line(x, y):
        return F.array(F.struct(x.alias("lon"), F.lit(35.0).alias("lat")), F.struct(y.alias("lon"), F.lit(35.0).alias("lat"))).cast(LINE)

    head = [F.lit("O").alias("operator"), F.lit("L").alias("line_name"), F.lit("11").alias("rail_class"), F.lit("4").alias("operator_type")]
    # S2 is drawn against its section, S3 has none, S4 has one drawn both ways.
    rows = spark.createDataFrame([("S1", 139.0, 139.1), ("S2", 139.2, 139.1), ("S3", 139.5, 139.6), ("S4", 139.7, 139.8)], "c string, x double, y double")
    platforms = rows.select(*head, F.col("c").alias("station_code"), F.col("c").alias("station_name"), F.lit("G").alias("group_code"), line(F.col("x"), F.col("y")).alias("line"))
    sections = spark.createDataFrame([(139.0, 139.1), (139.1, 139.2), (139.7, 139.8), (139.8, 139.7)], "x double, y double").select(*head, line(F.col("x"), F.col("y")).alias("line"))
    ends = {(r["edge_id"], r["source"], r["target"]) for r in network.section_ends(sections).collect()}

    def check(stations):
        got = {r["station_code"]: r for r in stations.collect()}
        assert sorted(got) == ["S1", "S2", "S3", "S4"]
        assert all((got[c]["edge_id"], got[c]["node_a"], got[c]["node_b"]) in ends for c in ("S1", "S2", "S4"))
        assert got["S2"]["node_a"] == got["S1"]["node_b"] and got["S3"]["edge_id"] is None and got["S3"]["node_a"] is None
        assert abs(got["S2"]["lon"] - 139.15) < 1e-9

    one = network.build_stations(platforms, sections)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan
    check(one)
    # A code with several platforms takes the one that has a section.
    twice = platforms.unionByName(platforms.where("station_code = 'S3'").withColumn("station_code", F.lit("S1")))
    check(network.build_stations(twice, sections))
    monkeypatch.setattr(network, "BROADCAST_SHAPES", 0)
    check(network.build_stations(platforms, sections))


def test_matched_places_are_merged_not_sent_round(spark):
    def ring(x):
        pts = [(x, 35.0), (x + 0.01, 35.0), (x + 0.01, 35.01), (x, 35.01), (x, 35.0)]
        return F.array(*[F.struct(F.lit(a).alias("lon"), F.lit(b).alias("lat")) for a, b in pts]).cast(LINE)

    areas = spark.range(1).select(
        (F.col("id") + 1).cast("int").alias("area_idx"), F.lit("way").alias("osm_type"), F.lit(7).cast("long").alias("osm_id"), F.lit("leisure=park").alias("kind"), F.lit("A").alias("name"),
        F.lit("Q1; Q9").alias("wikidata"), F.lit(1_000_000).alias("area_m2"), F.array(ring(139.0)).alias("rings"), F.array(ring(139.0)).alias("outers"))
    spots = spark.createDataFrame([(1, "wikidata", "Q1", 139.5), (2, "wikidata", "Q2", 139.005), (3, "sample", None, 140.0)], "spot_id int, source string, ext_id string, lon double")
    spots = spots.select("*", F.lit(35.005).alias("lat"), F.lit("公園・庭園").alias("group"))
    matched = places.match_area(spots, areas)
    points = spark.createDataFrame([(5, "main", "", "", 139.0, 35.0)], "node_id int, entrance string, barrier string, access string, lon double, lat double")
    tagged = places.tagged_entrances(spark.createDataFrame([(1, 5)], "area_idx int, node_id int"), points)
    crossings = spark.createDataFrame([(1, "footway", 139.01, 35.002)], "area_idx int, kind string, lon double, lat double")
    for df, want in (
        (matched, [(1, 1, "wikidata"), (2, 1, "contains"), (3, None, "")]),
        (places.access_points(matched, areas, tagged, crossings).select("spot_id", "source", "kind"), [(1, "osm_entrance", "main"), (2, "osm_entrance", "main")]),
    ):
        rows = sorted(map(tuple, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert rows == want
        assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan, plan
