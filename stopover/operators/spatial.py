"""Spatial joins as grid-cell equi-joins followed by exact geometry expressions.

Sides that are repeated by cells, corners or segments carry a merge hint: Spark's size estimates leave out what an explode
adds, so such a side would be sent whole to the driver and every task, however large it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.functions.geo import (
    M_PER_DEG_LAT,
    haversine_m,
    planar_m,
    point_in_rings,
    segment_cross,
    segments,
)
from stopover.session import skew_join

# Metres per degree of latitude on the sphere, rounded down so that a cell is never too small.
_M_PER_DEG_MIN = 110_000.0


def _band(lat: Column, radius_m: float) -> Column:
    """Latitude band of a point; bands are at least ``radius_m`` high."""
    return F.floor(lat / (radius_m / _M_PER_DEG_MIN)).cast("long")


def _columns(band: Column, radius_m: float) -> Column:
    """Cells around the globe in a latitude band, each at least ``radius_m`` wide there and in the bands beside it."""
    height = radius_m / _M_PER_DEG_MIN
    edge = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * height, F.lit(90.0))
    reach = math.sin(math.radians(min(height, 180.0)) / 2) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.greatest(F.floor(F.lit(360.0) / F.degrees(2 * F.asin(F.least(reach, F.lit(1.0))))), F.lit(1)).cast("long")


def _column(lon: Column, n: Column) -> Column:
    """Cell of a longitude among ``n`` around the globe."""
    return F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / n)).cast("long"), n)


def _neighbours(df: DataFrame, radius_m: float, lon: str, lat: str) -> DataFrame:
    """One copy of each row per cell of the 3 x 3 block around it; the block wraps at 180 degrees."""
    bands = df.withColumn("_cy", F.explode(F.array(*[_band(F.col(lat), radius_m) + d for d in (-1, 0, 1)])))
    bands = bands.withColumn("_n", _columns(F.col("_cy"), radius_m))
    mid = _column(F.col(lon), F.col("_n"))
    around = F.array(*[F.pmod(mid + F.lit(d), F.col("_n")) for d in (-1, 0, 1)])
    return bands.withColumn("_cx", F.explode(F.array_distinct(around))).drop("_n")


def within_distance(
    points: DataFrame,
    anchors: DataFrame,
    radius_m: float,
    point_key: str,
    measure=haversine_m,
    out: str = "dist_m",
) -> DataFrame:
    """Pairs of a point and an anchor at most ``radius_m`` apart, with the distance.

    Both sides need ``lon`` and ``lat``; the anchors' are returned as ``a_lon``, ``a_lat``.
    Points are hashed to cells as long as the radius, sized by their own latitude band; anchors are
    repeated in the 3 x 3 cells around them, across 180 degrees too. Cells with very many points are
    split over tasks.
    """
    pts = points.where(F.col("lon").isNotNull()).withColumn("_cy", _band(F.col("lat"), radius_m))
    pts = pts.withColumn("_cx", _column(F.col("lon"), _columns(F.col("_cy"), radius_m)))
    anc = anchors.withColumnRenamed("lon", "a_lon").withColumnRenamed("lat", "a_lat")
    near = skew_join(pts, _neighbours(anc, radius_m, "a_lon", "a_lat").hint("merge"), ["_cx", "_cy"], [point_key])
    d = measure(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat"))
    return near.withColumn(out, d).where(F.col(out) <= radius_m).drop("_cx", "_cy")


def nearest_within(
    points: DataFrame,
    anchors: DataFrame,
    radius_m: float,
    point_key: str | list[str],
    anchor_key: str,
    measure=haversine_m,
) -> DataFrame:
    """The nearest anchor of each point within ``radius_m``: keys, anchor key, dist_m. Ties by anchor key.

    Equal to nearest-of-all with a cap: an anchor beyond the cap would be dropped anyway. The
    minimum is a map-side combined aggregate, so crowded points need no sort.
    """
    keys = [point_key] if isinstance(point_key, str) else point_key
    pairs = within_distance(
        points.select(*keys, "lon", "lat"), anchors.select(anchor_key, "lon", "lat"), radius_m, keys[0], measure
    )
    best = pairs.groupBy(*keys).agg(F.min(F.struct(F.col("dist_m"), F.col(anchor_key))).alias("_b"))
    return best.select(*keys, F.col(f"_b.{anchor_key}").alias(anchor_key), F.col("_b.dist_m").alias("dist_m"))


def same_name_nearest(groups: DataFrame, named: DataFrame, radius_m: float, key: str, name: str) -> DataFrame:
    """Distance to the nearest named point with the same name, within ``radius_m``."""
    other = named.select(F.col(name), F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"))
    pairs = skew_join(other, groups.select(key, name, "lon", "lat").hint("merge"), [name], ["n_lon", "n_lat"])
    d = planar_m(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))
    return pairs.groupBy(key).agg(F.min(d).alias("named_m")).where(F.col("named_m") <= radius_m)


# ------------------------------------------------------------------ polygons


def _bbox(rings: Column) -> tuple[Column, Column, Column, Column]:
    pts = F.flatten(rings)
    lon, lat = F.transform(pts, lambda p: p["lon"]), F.transform(pts, lambda p: p["lat"])
    return F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat)


def _cover(df: DataFrame, box: tuple[Column, Column, Column, Column], deg: float) -> DataFrame:
    """One copy of each row per cell its bounding box touches."""
    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / deg).cast("long"), F.floor(hi / deg).cast("long"))

    return df.withColumn("_cx", F.explode(span(box[0], box[2]))).withColumn("_cy", F.explode(span(box[1], box[3])))


def points_in_areas(points: DataFrame, areas: DataFrame, point_key: str, area_key: str, rings: str = "rings", deg: float = 0.01) -> DataFrame:
    """Pairs of a point and an area that contains it, by cell join and ray casting.

    ``deg`` is the cell side; it should be near the typical area size, so that an area
    covers a few cells.
    """
    pts = points.withColumn("_cx", F.floor(F.col("lon") / deg).cast("long")).withColumn(
        "_cy", F.floor(F.col("lat") / deg).cast("long")
    )
    covered = _cover(areas, _bbox(F.col(rings)), deg)
    pairs = skew_join(pts, covered.hint("merge"), ["_cx", "_cy"], [point_key])
    return pairs.where(point_in_rings(F.col("lon"), F.col("lat"), F.col(rings))).drop("_cx", "_cy")


def smallest_band(points: DataFrame, bands: DataFrame, point_key: str, minutes: str, by: list[str], deg: float = 0.05) -> DataFrame:
    """Fewest minutes among the time-band polygons that cover a point, per direction and sample."""
    inside = points_in_areas(points, bands, point_key, minutes, deg=deg)
    return inside.groupBy(point_key, *by).agg(F.min(minutes).alias(minutes))


def line_area_crossings(lines: DataFrame, areas: DataFrame, line_key: str, area_key: str, deg: float = 0.005) -> DataFrame:
    """Points where a line meets the boundary of an area: (area, line, lon, lat), each point once.

    Both sides are broken into segments and segments meet in the cells their boxes share, so
    a long way or a large outline is never handled as one row.
    """
    def pieces(df: DataFrame, keys: list[str], segs: Column, name: str) -> DataFrame:
        out = df.select(*keys, F.explode(segs).alias(name))
        a, b = F.col(f"{name}.a"), F.col(f"{name}.b")
        box = (
            F.least(a["lon"], b["lon"]), F.least(a["lat"], b["lat"]),
            F.greatest(a["lon"], b["lon"]), F.greatest(a["lat"], b["lat"]),
        )
        return _cover(out, box, deg)

    carried = [c for c in lines.columns if c != "line"]
    left = pieces(lines, carried, segments(F.col("line")), "s")
    right = pieces(areas, [area_key], F.flatten(F.transform("rings", segments)), "t")
    pairs = skew_join(left, right.hint("merge"), ["_cx", "_cy"], [line_key, "s.a.lon"])
    hit = segment_cross(F.col("s.a"), F.col("s.b"), F.col("t.a"), F.col("t.b"))
    found = pairs.withColumn("_p", hit).where(F.col("_p").isNotNull())
    return found.select(
        area_key, *carried, F.round("_p.lon", 7).alias("lon"), F.round("_p.lat", 7).alias("lat")
    ).distinct()


def ring_members(areas: DataFrame, points: DataFrame, area_key: str) -> DataFrame:
    """Tagged nodes that are vertices of an area's rings, by node id."""
    ids = areas.select(area_key, F.explode(F.array_distinct("ring_nodes")).alias("node_id"))
    return skew_join(ids, points.hint("merge"), ["node_id"], [area_key])


# ------------------------------------------------------------------ surfaces

# Side of a surface cell in metres.
SURFACE_CELL_M = 250.0


def disk_cells(disks: DataFrame, by: list[str], cell_m: float = SURFACE_CELL_M, lon_scale_lat: float = 35.5) -> DataFrame:
    """Distinct grid cells whose centre lies in a disk: (by.., sx, sy).

    ``disks``: by.., lon, lat, radius_m. The union of disks is the set of covered cells; its
    area is the number of cells times the cell area.
    """
    k_lat = M_PER_DEG_LAT
    k_lon = M_PER_DEG_LAT * math.cos(math.radians(lon_scale_lat))
    x, y = F.col("lon") * k_lon / cell_m, F.col("lat") * k_lat / cell_m
    r = F.col("radius_m") / cell_m
    rows = (
        disks.withColumn("_x", x).withColumn("_y", y).withColumn("_r", r)
        .withColumn("sx", F.explode(F.sequence(F.floor(F.col("_x") - F.col("_r")), F.floor(F.col("_x") + F.col("_r")))))
        .withColumn("sy", F.explode(F.sequence(F.floor(F.col("_y") - F.col("_r")), F.floor(F.col("_y") + F.col("_r")))))
    )
    dx, dy = F.col("sx") + 0.5 - F.col("_x"), F.col("sy") + 0.5 - F.col("_y")
    return rows.where(dx * dx + dy * dy <= F.col("_r") * F.col("_r")).select(*by, "sx", "sy").distinct()


def surface_area(cells: DataFrame, by: list[str], cell_m: float = SURFACE_CELL_M) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * float(cell_m * cell_m)).alias("area_m2")
    )
