"""What is written to disk on the way: stations and trails are not kept without need."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopover.functions.geo import LINE
from stopover.operators import network
from stopover.plans import derived, place_queries


def _platforms(spark, rows):
    line = F.array(F.struct(F.col("x").alias("lon"), F.lit(35.0).alias("lat")), F.struct((F.col("x") + 0.001).alias("lon"), F.lit(35.0).alias("lat"))).cast(LINE)
    return spark.createDataFrame(rows, "line_name string, station_code string, x double").select(
        F.lit("O").alias("operator"), "line_name", F.lit("11").alias("rail_class"), F.lit("4").alias("operator_type"),
        "station_code", F.col("station_code").alias("station_name"), F.lit("G").alias("group_code"), line.alias("line"))


def test_stations_are_kept_only_if_they_moved(spark, monkeypatch):
    kept = []
    cut = network.cut_lineage
    monkeypatch.setattr(network, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))

    def stations(rows):
        kept.clear()
        p = _platforms(spark, rows)
        net = network.build_network(p, p.select("operator", "line_name", "rail_class", "operator_type", "line"))
        return net.stations.count(), any("station_code" in c for c in kept)

    assert stations([("L", "S1", 139.0), ("L", "S2", 139.001), ("M", "S3", 139.0)]) == (3, False)
    assert stations([("L", "S1", 139.0), ("L", "S1", 139.001), ("M", "S3", 139.0)]) == (2, True)


def test_trails_are_read_once_and_not_kept(spark, tmp_path, monkeypatch):
    spark.sql("select id as s_suppkey, id % 3 as s_nationkey from range(1, 4)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("select id % 3 + 1 as l_suppkey, id * 7 + 1 as l_partkey from range(30)").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = []
    cut = derived.cut_lineage
    monkeypatch.setattr(derived, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    rows = place_queries.QUERIES["cover_trails"](spark, str(tmp_path)).collect()
    assert [(r["trails"], r["edges"]) for r in rows] == [(1, 19)] * 3
    assert kept and not any({"trail", "group_code"} & set(c) for c in kept)
