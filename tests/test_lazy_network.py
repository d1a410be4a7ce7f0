"""A search builds the lines it rides on and gives what the whole network gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stopover.functions.geo import LINE, line_interpolate, line_length_m
from stopover.operators import graph, network, reach
from stopover.plans import reach_queries


def _line(x, y):
    return F.array(F.struct(x.alias("lon"), F.lit(35.0).alias("lat")), F.struct(y.alias("lon"), F.lit(35.0).alias("lat"))).cast(LINE)


def _features(spark, rows):
    """Platforms of 100 m and a section from each to the next of its line."""
    head = [F.lit("O").alias("operator"), "line_name", F.lit("11").alias("rail_class"), F.lit("4").alias("operator_type")]
    df = spark.createDataFrame(rows, "line_name string, i int, station_code string, group_code string, x double")
    platforms = df.select(*head, "station_code", F.concat(F.lit("N"), "group_code").alias("station_name"), "group_code", _line(F.col("x"), F.col("x") + 0.001).alias("line"))
    after = df.select(F.col("line_name").alias("l"), (F.col("i") - 1).alias("j"), F.col("x").alias("y"))
    between = df.join(after, (F.col("line_name") == F.col("l")) & (F.col("i") == F.col("j"))).select(*head, _line(F.col("x") + 0.001, F.col("y")).alias("line"))
    return platforms, platforms.select("operator", "line_name", "rail_class", "operator_type", "line").unionByName(between)


def _rows(lines=6, seed=3):
    """Lines that share groups with the next line, so a way to line n takes n transfers."""
    rng = random.Random(seed)
    return [(f"L{n}", i, f"S{n}-{i}", f"G{n + 1 if i == 5 else n}-{0 if i in (0, 5) else i}", 139.0 + 0.3 * n + 0.05 * i + rng.random() / 100) for n in range(lines) for i in range(6)]


def _out(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_searches_give_what_the_whole_network_gives(spark):
    features = _features(spark, _rows())
    lazy, whole = network.build_network(*features), network._whole_network(*features)
    got = _out(reach.detour_stations(lazy, "G0-1", "NG1-2", 70))
    assert got and got == _out(reach.detour_stations(whole, "G0-1", "NG1-2", 70))
    assert "whole" not in vars(lazy) and lazy._known("lines").count() < 6
    assert _out(reach.detour_route(lazy, "G0-1", "G1-2")) == _out(reach.detour_route(whole, "G0-1", "G1-2"))


def test_codes_of_several_platforms_take_the_whole_network(spark):
    rows = _rows(3)
    rows.append(("L9", 0, "S1-2", "G0-2", 139.11))
    features = _features(spark, rows)
    lazy, whole = network.build_network(*features), network._whole_network(*features)
    assert _out(reach.reach_from(lazy, "G0-1", 40.0)) == _out(reach.reach_from(whole, "G0-1", 40.0))
    assert "whole" in vars(lazy)


@pytest.mark.parametrize("cap", [7, None])
def test_one_task_searches_as_the_rounds_do(spark, cap):
    rng = random.Random(8)
    arcs = [(rng.randrange(40), rng.randrange(40), rng.randint(0, 5)) for _ in range(90)]
    df = spark.createDataFrame([*arcs, (None, 1, 1)], "source long, target long, cost long")
    seeds = spark.createDataFrame([("a", 0, 0), ("a", 3, 4), ("b", 7, 0), ("b", 99, 1)], "origin string, node long, cost long")
    assert _out(graph.small_costs(df, seeds, cap, 91)) == _out(graph.shortest_costs(df, seeds, cap))


def test_stations_and_lines_of_two_points_are_compiled(spark):
    platforms, sections = _features(spark, _rows(1))
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.codegen.factoryMode", "spark.sql.codegen.fallback")}
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert network.build_stations(platforms, sections).select("node_a", "node_b").distinct().count() == 6
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # A point put on a line's end leaves its length and middle as they are, though three points are walked.
    two = platforms.select("line", F.concat("line", F.slice("line", 2, 1)).alias("three"))
    row = two.select(*[f(F.col(c)).alias(f"{c}{i}") for i, f in enumerate((line_length_m, lambda x: line_interpolate(x, 0.5))) for c in ("line", "three")]).collect()
    assert all(r["line0"] == r["three0"] and r["line1"] == r["three1"] for r in row)


def test_isochrones_have_all_their_bands(spark, tmp_path):
    spark.sql("select id as s_suppkey, id % 3 as s_nationkey from range(1, 4)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("select id % 3 + 1 as l_suppkey, id as l_partkey from range(30)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["band_min"]: r["station_count"] for r in reach_queries.QUERIES["isochrone_bands"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [15.0, 30.0, 45.0, 60.0] and got[15.0] >= 1 and got[60.0] > got[15.0]
