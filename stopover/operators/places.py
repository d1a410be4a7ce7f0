"""Places, areas, access points and station exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.functions import rules as R
from stopover.functions.geo import (
    interpolate_at,
    line_length_planar_m,
    planar_m,
    point_in_rings,
    point_rings_m,
    rings_area_m2,
)
from stopover.functions.stats import category_shares, percentiles
from stopover.operators.network import group_centroids
from stopover.operators.spatial import nearest_within, points_in_areas, same_name_nearest

# Fixed values.
EDGE_STEP_M, EDGE_MAX = 100.0, 200
WIDE_AREA_M2 = 10_000
EXIT_CAP_M, NAMED_CAP_M = 500.0, 1000.0


# ------------------------------------------------------------------ extraction from tagged elements


def area_extract(elements: DataFrame) -> DataFrame:
    """Areas kept from tagged elements: with an id tag or a named area kind, no borders, places or buildings, at most 30 km2.

    ``elements``: osm_type, osm_id, tags (map), outers, inners (ring arrays), ring_nodes.
    """
    tags = F.col("tags")
    rows = elements.withColumn("kind", R.area_kind(tags)).withColumn("name", F.coalesce(tags["name"], tags["name:ja"], F.lit("")))
    wanted = tags["wikidata"].isNotNull() | (F.col("kind").isNotNull() & (F.col("name") != ""))
    border = F.coalesce(tags["boundary"].isin(*R.NOT_A_PLACE_BOUNDARY), F.lit(False))
    excluded = border | tags["place"].isNotNull() | (tags["building"].isNotNull() & F.col("kind").isNull())
    area = rings_area_m2(F.col("outers"), F.col("inners"))
    kept = rows.where(wanted & ~excluded).withColumn("area_m2", area).where(F.col("area_m2") <= R.MAX_AREA_M2)
    return kept.select(
        F.xxhash64("osm_type", "osm_id").alias("area_idx"), "osm_type", "osm_id", "name",
        F.coalesce(tags["wikidata"], F.lit("")).alias("wikidata"), F.coalesce("kind", F.lit("")).alias("kind"), "tags",
        F.round("area_m2", 0).cast("long").alias("area_m2"), F.size(F.array_distinct("ring_nodes")).alias("n_ring_nodes"),
        F.concat("outers", "inners").alias("rings"), "outers", "ring_nodes",
    )


def point_extract(elements: DataFrame) -> DataFrame:
    """Tagged points kept: entrances, barriers, railway, transport and lift nodes."""
    names = ["entrance", "barrier", "railway", "public_transport", "name", "access", "level", "ref", "wikidata"]
    return elements.where(R.is_tagged_point(F.col("tags"))).select(
        "node_id", "lon", "lat", *[F.coalesce(F.col("tags")[n], F.lit("")).alias(n) for n in names]
    )


def walkable_ways(elements: DataFrame) -> DataFrame:
    tags = F.col("tags")
    return elements.where(R.is_walkable_way(tags) & (F.size("line") > 1)).select(
        "way_id", tags["highway"].alias("highway"), F.coalesce(tags["access"], F.lit("")).alias("access"),
        F.coalesce(tags["foot"], F.lit("")).alias("foot"), "line",
    )


# ------------------------------------------------------------------ matching
# Merge hints keep sides that hold rings or exploded rows off the driver, see ``spatial``.


def with_group(places: DataFrame) -> DataFrame:
    return places.withColumn("group", R.first_group(F.col("kinds")))


def match_by_tag(places: DataFrame, areas: DataFrame) -> DataFrame:
    """Largest area that carries the place's id among its ``;``-separated tags: (spot_id, area_idx)."""
    tags = areas.where("wikidata <> ''").select(
        "area_idx", "osm_type", "osm_id", "area_m2", F.explode(F.split(F.trim("wikidata"), r"\s*;\s*")).alias("ext_id")
    )
    hits = places.where("source = 'wikidata'").select("spot_id", "ext_id").join(tags.hint("merge"), "ext_id")
    return hits.groupBy("spot_id").agg(F.min_by("area_idx", F.struct(-F.col("area_m2"), "osm_type", "osm_id")).alias("area_idx"))


def match_by_position(places: DataFrame, areas: DataFrame, deg: float = 0.01) -> DataFrame:
    """Smallest named area of a suitable kind that contains the place: (spot_id, area_idx)."""
    named = areas.where("kind <> '' and name <> ''").select("area_idx", "osm_type", "osm_id", "kind", "area_m2", "rings")
    inside = points_in_areas(places.select("spot_id", "group", "lon", "lat"), named, "spot_id", "area_idx", deg=deg)
    fit = inside.where(R.kind_allowed(F.col("group"), F.col("kind")))
    return fit.groupBy("spot_id").agg(F.min_by("area_idx", F.struct("area_m2", "osm_type", "osm_id")).alias("area_idx"))


def match_area(places: DataFrame, areas: DataFrame) -> DataFrame:
    """Area of each place by tag, else by position: (spot_id, area_idx, match); ``match`` is empty without one."""
    tagged = match_by_tag(places, areas).withColumn("match", F.lit("wikidata"))
    rest = places.join(tagged.hint("merge"), "spot_id", "left_anti")
    contained = match_by_position(rest, areas).withColumn("match", F.lit("contains"))
    both = tagged.unionByName(contained)
    return places.select("spot_id").join(both.hint("merge"), "spot_id", "left").fillna("", ["match"])


# ------------------------------------------------------------------ access points


def edge_points(areas: DataFrame) -> DataFrame:
    """Points along the outer rings about every 100 m, at most 200 per area: (area_idx, lon, lat)."""
    total = F.aggregate("outers", F.lit(0.0), lambda acc, r: acc + line_length_planar_m(r))
    step = F.greatest(F.lit(EDGE_STEP_M), total / EDGE_MAX)
    rings = areas.select("area_idx", step.alias("_step"), F.explode("outers").alias("ring"))
    n = F.greatest(F.lit(1), F.floor(line_length_planar_m(F.col("ring")) / F.col("_step"))).cast("int")
    rows = rings.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def seg(s: Column) -> Column:
        return planar_m(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])

    p = interpolate_at(F.col("ring"), F.col("_i") / F.col("_n"), seg)
    return rows.withColumn("_p", p).select("area_idx", F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"))


def tagged_entrances(ring_points: DataFrame, points: DataFrame) -> DataFrame:
    """Entrances and gates on area rings that may be entered: (area_idx, lon, lat, kind)."""
    rows = ring_points.select("area_idx", "node_id").join(points.hint("merge"), "node_id")
    return rows.where(R.may_enter(F.col("access")) & R.is_entrance(F.col("entrance"), F.col("barrier"))).select(
        "area_idx", "lon", "lat", F.when(F.coalesce("entrance", F.lit("")) != "", F.col("entrance")).otherwise(F.col("barrier")).alias("kind")
    )


def open_crossings(crossings: DataFrame) -> DataFrame:
    ok = R.may_enter(F.col("access")) & R.may_enter(F.col("foot"))
    return crossings.where(ok).select("area_idx", "lon", "lat", F.col("highway").alias("kind"))


def access_points(matched: DataFrame, areas: DataFrame, tagged: DataFrame, crossings: DataFrame) -> DataFrame:
    """Access points of every matched place: its tagged entrances, else crossings, else outline points."""
    own = matched.where("match <> ''").select("spot_id", "area_idx")
    a = own.join(tagged.hint("merge"), "area_idx").select("spot_id", F.lit("osm_entrance").alias("source"), "kind", "lon", "lat")
    no_tag = own.join(tagged.select("area_idx").distinct().hint("merge"), "area_idx", "left_anti")
    b = no_tag.join(crossings.hint("merge"), "area_idx").select("spot_id", F.lit("osm_crossing").alias("source"), "kind", "lon", "lat")
    none = no_tag.join(crossings.select("area_idx").distinct().hint("merge"), "area_idx", "left_anti")
    outline = edge_points(areas.join(none.select("area_idx").distinct().hint("merge"), "area_idx", "left_semi"))
    c = none.join(outline.hint("merge"), "area_idx").select("spot_id", F.lit("area_edge").alias("source"), F.lit("").alias("kind"), "lon", "lat")
    out = a.unionByName(b).unionByName(c)
    return out.withColumn("lon", F.round("lon", 7)).withColumn("lat", F.round("lat", 7))


def area_offsets(places: DataFrame, matched: DataFrame, areas: DataFrame, tagged: DataFrame, crossings: DataFrame) -> DataFrame:
    """Per place: area, inside or not, counts of entrances and crossings, rounded distances to them and the boundary."""
    rows = places.select("spot_id", "group", "lon", "lat").join(matched.hint("merge"), "spot_id").join(
        areas.select("area_idx", "area_m2", "rings").hint("merge"), "area_idx", "left"
    )
    lon, lat = F.col("lon"), F.col("lat")
    base = rows.select(
        "spot_id", "group", "match", "area_idx", "area_m2", "lon", "lat",
        F.when(F.col("rings").isNotNull(), point_in_rings(lon, lat, F.col("rings"))).alias("inside"),
        F.bround(point_rings_m(lon, lat, F.col("rings")), 0).alias("point_to_edge_m"),
    )

    def near(points: DataFrame, n: str, d: str) -> DataFrame:
        p = points.select("area_idx", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
        hit = base.select("spot_id", "area_idx", "lon", "lat").join(p.hint("merge"), "area_idx")
        return hit.groupBy("spot_id").agg(
            F.count(F.lit(1)).alias(n), F.bround(F.min(planar_m(lon, lat, F.col("p_lon"), F.col("p_lat"))), 0).alias(d)
        )

    out = base.join(near(tagged, "n_tagged", "near_tagged_m").hint("merge"), "spot_id", "left")
    out = out.join(near(crossings, "n_cross", "near_cross_m").hint("merge"), "spot_id", "left")
    return out.fillna(0, ["n_tagged", "n_cross"]).drop("lon", "lat")


def area_summary(offsets: DataFrame) -> DataFrame:
    """Counts and shares per place group with a totals row."""
    has = F.col("match") != ""
    return category_shares(
        offsets, "group",
        {
            "by_tag": F.col("match") == "wikidata", "by_position": F.col("match") == "contains",
            "with_entrance": has & (F.col("n_tagged") > 0),
            "with_crossing": has & (F.col("n_tagged") == 0) & (F.col("n_cross") > 0),
            "with_neither": has & (F.col("n_tagged") == 0) & (F.col("n_cross") == 0),
        },
    )


def offset_percentiles(offsets: DataFrame, shares=(0.5, 0.8)) -> DataFrame:
    """Percentiles of the distances in areas of at least 10,000 m2: (measure, share, value)."""
    wide = offsets.where((F.col("match") != "") & (F.col("area_m2") >= WIDE_AREA_M2))
    long = wide.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("near_tagged_m", "near_cross_m", "point_to_edge_m")])).alias("x")
    ).select("x.*").where("v is not null")
    return percentiles(long, ["measure"], "v", list(shares), "rounded")


# ------------------------------------------------------------------ station exits


def station_exits(stations: DataFrame, points: DataFrame, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per group: exits, nearest exit, named map station; per exit: its group).

    An exit belongs to the nearest group within 500 m. Distances use the planar scale.
    """
    names = stations.groupBy("group_code").agg(F.min_by("station_name", "station_code").alias("station_name"))
    groups = group_centroids(stations).join(names, "group_code")
    if box is not None:
        groups = groups.where(R.in_bbox(F.col("lon"), F.col("lat"), box))
    exits = points.where(F.col("railway").isin(*R.EXIT_RAILWAY) & R.may_enter(F.col("access")))
    own = nearest_within(exits, groups, EXIT_CAP_M, "node_id", "group_code", planar_m)
    per = own.groupBy("group_code").agg(F.count(F.lit(1)).alias("n_exit"), F.bround(F.min("dist_m"), 0).alias("near_exit_m"))
    map_stations = points.where(F.col("railway").isin(*R.STATION_RAILWAY) & (F.col("name") != "")).withColumnRenamed("name", "station_name")
    named = same_name_nearest(groups, map_stations, NAMED_CAP_M, "group_code", "station_name")
    out = (
        groups.join(per, "group_code", "left").join(named, "group_code", "left").fillna(0, ["n_exit"])
        .select("group_code", "station_name", "lon", "lat", "n_exit", "near_exit_m", F.bround("named_m", 0).alias("osm_station_m"))
    )
    exit_rows = own.join(exits.select("node_id", "railway", "name", "lon", "lat"), "node_id").withColumn("dist_m", F.bround("dist_m", 0))
    return out, exit_rows


def exit_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, groups with exits, median and most exits, median and 80 % distance, groups with a named map station."""
    has = groups.where("n_exit > 0")

    def pct(df: DataFrame, col: str, p: float, name: str) -> DataFrame:
        return percentiles(df, [], col, [p], "rounded").select(F.lit(1).alias("_k"), F.col("value").alias(name))

    base = groups.agg(
        F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("n_exit") > 0, 1)).alias("with_exit"),
        F.max("n_exit").alias("most_exits"), F.count("osm_station_m").alias("with_named"),
    ).withColumn("_k", F.lit(1))
    for df in (pct(has, "n_exit", 0.5, "median_exits"), pct(has, "near_exit_m", 0.5, "exit_p50_m"), pct(has, "near_exit_m", 0.8, "exit_p80_m")):
        base = base.join(df, "_k", "left")
    return base.drop("_k")
