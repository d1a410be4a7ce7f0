"""Geometry as column expressions: points are lon/lat doubles, lines and rings arrays of them.

Distances are great-circle metres on a sphere; areas, edges and boundary distances use a
local planar scale. The sphere differs from the ellipsoid by at most about 0.5 %.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
DEG_TO_RAD = 0.017453292519943295
M_PER_DEG_LON = 91_000.0
M_PER_DEG_LAT = 111_000.0
SNAP_DEG = 1e-7
WALK_M_PER_MIN = 80.0

POINT = "struct<lon:double,lat:double>"
LINE = f"array<{POINT}>"
RINGS = f"array<{LINE}>"


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    rad = F.lit(DEG_TO_RAD)
    s_lat = F.sin((lat2 - lat1) * rad / 2)
    s_lon = F.sin((lon2 - lon1) * rad / 2)
    a = s_lat * s_lat + F.cos(lat1 * rad) * F.cos(lat2 * rad) * s_lon * s_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres on the local planar scale."""
    dx = (lon1 - lon2) * F.lit(M_PER_DEG_LON)
    dy = (lat1 - lat2) * F.lit(M_PER_DEG_LAT)
    return F.sqrt(dx * dx + dy * dy)


def line_start(line: Column) -> Column:
    return F.element_at(line, 1)


def line_end(line: Column) -> Column:
    return F.element_at(line, -1)


def segments(line: Column) -> Column:
    """``array<struct<a,b>>`` of the consecutive segments of a line."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(
        F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b)
    )


def line_length_m(line: Column) -> Column:
    """Great-circle length of a line; one of two points needs no walk over its segments, which is not compiled."""
    a, b = line_start(line), line_end(line)
    walked = F.aggregate(
        segments(line),
        F.lit(0.0),
        lambda acc, s: acc + haversine_m(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]),
    )
    return F.when(F.size(line) == 2, haversine_m(a["lon"], a["lat"], b["lon"], b["lat"])).otherwise(walked)


def line_length_planar_m(line: Column) -> Column:
    return F.aggregate(
        segments(line),
        F.lit(0.0),
        lambda acc, s: acc + planar_m(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]),
    )


def line_interpolate(line: Column, fraction: float | Column) -> Column:
    """Point at a share of the planar degree length, walking the segments once."""
    def seg_len(s: Column) -> Column:
        dx = s["b"]["lon"] - s["a"]["lon"]
        dy = s["b"]["lat"] - s["a"]["lat"]
        return F.sqrt(dx * dx + dy * dy)

    return interpolate_at(line, fraction, seg_len)


def interpolate_at(line: Column, fraction: float | Column, seg_len) -> Column:
    """Point at ``fraction`` of a line's length, with the segment measure supplied.

    A line of two points takes the one step that the walk over its segments would, without the walk.
    """
    segs = segments(line)
    total = F.aggregate(segs, F.lit(0.0), lambda acc, s: acc + seg_len(s))
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    first = F.element_at(line, 1)
    init = F.named_struct(F.lit("left"), total * share, F.lit("lon"), first["lon"], F.lit("lat"), first["lat"])

    def step(acc: Column, s: Column) -> Column:
        length = seg_len(s)
        t = F.when(length > 0, F.least(F.lit(1.0), acc["left"] / length)).otherwise(F.lit(0.0))
        moved = acc["left"] > 0
        return F.named_struct(
            F.lit("left"), F.greatest(F.lit(0.0), acc["left"] - length),
            F.lit("lon"), F.when(moved, s["a"]["lon"] + (s["b"]["lon"] - s["a"]["lon"]) * t).otherwise(acc["lon"]),
            F.lit("lat"), F.when(moved, s["a"]["lat"] + (s["b"]["lat"] - s["a"]["lat"]) * t).otherwise(acc["lat"]),
        )

    def two() -> tuple[Column, Column]:
        a, b = F.get(line, F.lit(0)), F.get(line, F.lit(1))
        length = seg_len({"a": a, "b": b})
        t = F.when(length > 0, F.least(F.lit(1.0), length * share / length)).otherwise(F.lit(0.0))
        moved = length * share > 0
        return tuple(F.when(moved, a[c] + (b[c] - a[c]) * t).otherwise(a[c]) for c in ("lon", "lat"))

    end = F.aggregate(segs, init, step)
    lon, lat = two()
    short = F.size(line) == 2
    return F.struct(F.when(short, lon).otherwise(end["lon"]).alias("lon"), F.when(short, lat).otherwise(end["lat"]).alias("lat"))


def snap_x(lon: Column) -> Column:
    """Integer grid key of a coordinate on the 1e-7 degree grid."""
    return F.round(lon / F.lit(SNAP_DEG)).cast("long")


snap_y = snap_x


def node_key(*parts: Column) -> Column:
    """Stable surrogate key of a natural key."""
    return F.xxhash64(*parts)


def ring_area_m2(ring: Column) -> Column:
    """Shoelace area of a closed ring on the planar scale."""
    twice = F.aggregate(
        segments(ring),
        F.lit(0.0),
        lambda acc, s: acc
        + s["a"]["lon"] * F.lit(M_PER_DEG_LON) * s["b"]["lat"] * F.lit(M_PER_DEG_LAT)
        - s["b"]["lon"] * F.lit(M_PER_DEG_LON) * s["a"]["lat"] * F.lit(M_PER_DEG_LAT),
    )
    return F.abs(twice) / 2


def rings_area_m2(outers: Column, inners: Column) -> Column:
    """Area of outer rings less the holes."""
    def add(acc: Column, ring: Column) -> Column:
        return acc + ring_area_m2(ring)

    return F.aggregate(outers, F.lit(0.0), add) - F.aggregate(inners, F.lit(0.0), add)


def point_in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd ray casting over all rings, so holes count as outside."""
    def crossings(acc: Column, ring: Column) -> Column:
        return F.aggregate(
            segments(ring),
            acc,
            lambda n, s: n
            + F.when(
                ((s["a"]["lat"] > lat) != (s["b"]["lat"] > lat))
                & (
                    lon
                    < F.try_divide((s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"]), s["b"]["lat"] - s["a"]["lat"])
                    + s["a"]["lon"]
                ),
                F.lit(1),
            ).otherwise(F.lit(0)),
        )

    return F.aggregate(rings, F.lit(0), crossings) % 2 == 1


def point_segment_m(lon: Column, lat: Column, a: Column, b: Column) -> Column:
    """Planar distance from a point to a segment."""
    kx, ky = F.lit(M_PER_DEG_LON), F.lit(M_PER_DEG_LAT)
    ax, ay = (a["lon"] - lon) * kx, (a["lat"] - lat) * ky
    bx, by = (b["lon"] - lon) * kx, (b["lat"] - lat) * ky
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / sq))).otherwise(F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py)


def point_rings_m(lon: Column, lat: Column, rings: Column) -> Column:
    """Planar distance from a point to the nearest ring boundary."""
    return F.array_min(
        F.flatten(
            F.transform(
                rings,
                lambda ring: F.transform(segments(ring), lambda s: point_segment_m(lon, lat, s["a"], s["b"])),
            )
        )
    )


def segment_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Intersection point of segments ab and cd, NULL when they do not meet in one point."""
    rx, ry = b["lon"] - a["lon"], b["lat"] - a["lat"]
    sx, sy = d["lon"] - c["lon"], d["lat"] - c["lat"]
    den = rx * sy - ry * sx
    qx, qy = c["lon"] - a["lon"], c["lat"] - a["lat"]
    # Parallel segments have no such point; ANSI division would fail wherever the plan evaluates it before a test.
    t = F.try_divide(qx * sy - qy * sx, den)
    u = F.try_divide(qx * ry - qy * rx, den)
    hit = t.between(0.0, 1.0) & u.between(0.0, 1.0)
    return F.when(hit, F.named_struct(F.lit("lon"), a["lon"] + t * rx, F.lit("lat"), a["lat"] + t * ry))


def cell(lon: Column, lat: Column, size_deg_lon: float, size_deg_lat: float) -> tuple[Column, Column]:
    """Grid cell indices of a point."""
    return (
        F.floor(lon / F.lit(size_deg_lon)).cast("long").alias("cx"),
        F.floor(lat / F.lit(size_deg_lat)).cast("long").alias("cy"),
    )


def walk_minutes(metres: Column) -> Column:
    return metres / F.lit(WALK_M_PER_MIN)


def ride_minutes(metres: Column, kmh: Column) -> Column:
    return metres / 1000.0 / kmh * 60.0


def milli(minutes: Column) -> Column:
    """Minutes as whole thousandths, so path sums do not depend on the order of addition."""
    return F.round(minutes * 1000).cast("long")
