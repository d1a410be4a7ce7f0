"""Reachability, isochrones and detours over a built rail network.

Costs are whole milli-minutes inside; published minutes are rounded half up. Filters look at
unrounded minutes, and the operators that follow use the rounded ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopover.functions.sets import distinct_list
from stopover.operators.graph import (
    group_nodes,
    platform_costs,
    resolve_station,
    shortest_route,
)
from stopover.operators.network import Network
from stopover.operators.spatial import disk_cells, surface_area, within_distance
from stopover.session import cut_lineage
from stopover.sources.writers import feature, feature_collection, point_geometry

# Fixed values.
SPREAD_M = 1500.0
REACH_BANDS = (15, 30, 45, 60)
STAY_BANDS = (15, 30, 60, 120)
WALK_M_PER_MIN = 80.0
WALK_CAP_MIN = 15.0
DETOUR_RATIO = 1.3
WAIT_MIN = 5.0
AREA_RADIUS_M = 1500.0
MIN_STAY = 15


@dataclass(frozen=True)
class WalkRule:
    """How far people walk from a station and how straight-line metres become minutes."""

    m_per_min: float = WALK_M_PER_MIN
    cap_min: float = WALK_CAP_MIN
    detour: float = DETOUR_RATIO

    @property
    def radius_m(self) -> float:
        return self.cap_min * self.m_per_min / self.detour

    def minutes(self, metres: Column) -> Column:
        return metres * F.lit(self.detour) / F.lit(self.m_per_min)


def whole(mm: Column) -> Column:
    """Milli-minutes as whole minutes, half away from zero."""
    return F.round(mm / 1000.0, 0)


def to_milli(minutes: float) -> int:
    return int(round(minutes * 1000))


def _platforms(net: Network, groups: dict[str, DataFrame], cap_min: float) -> DataFrame:
    """Stations with one cost column per origin, of those reached and of the groups all; a single search serves all origins."""
    net, costs = net.search(groups, to_milli(max(cap_min, 0)))
    per = platform_costs(net.stations, costs).groupBy("station_code").agg(
        *[F.min(F.when(F.col("origin") == o, F.col("cost"))).alias(f"c_{o}") for o in groups]
    )
    named = net.stations.join(
        net.lines.select("line_id", F.concat_ws(" ", "operator", "line_name").alias("line")), "line_id"
    )
    return named.join(per, "station_code", "left")


def _group_up(rows: DataFrame, *measures: Column) -> DataFrame:
    return rows.groupBy("group_code").agg(
        F.min("station_name").alias("station_name"),
        distinct_list(F.col("line")).alias("lines"),
        *measures,
        F.avg("lon").alias("lon"),
        F.avg("lat").alias("lat"),
    )


def _mark(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    return rows.join(groups.select("group_code", F.lit(True).alias(name)), "group_code", "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def reachable(
    net: Network, start: str, end: str, available: float, stay: float, wait: float = WAIT_MIN, include_ends: bool = False
) -> DataFrame:
    """Groups with t1 + stay + t2 within the available time, most slack first.

    Both minutes must exist on the same platform row, and the wait is added to each leg.
    """
    named = net.named(start, end)
    groups = {"from": resolve_station(named, start), "to": resolve_station(named, end)}
    rows = _platforms(net, groups, available - stay - 2 * wait)
    w = to_milli(wait)
    rows = rows.where(F.col("c_from").isNotNull() & F.col("c_to").isNotNull())
    per = _group_up(rows, (F.min("c_from") + w).alias("t1"), (F.min("c_to") + w).alias("t2"))
    left = F.lit(to_milli(available - stay)) - F.col("t1") - F.col("t2")
    out = per.withColumn("slack", left).where(F.col("slack") >= 0)
    if not include_ends:
        out = out.join(named.select("group_code").distinct(), "group_code", "left_anti")
    return out.select(
        "group_code", "station_name", "lines", whole(F.col("t1")).alias("t1_min"), whole(F.col("t2")).alias("t2_min"),
        whole(F.col("slack")).alias("slack_min"), "lon", "lat",
    ).orderBy(F.desc("slack_min"), "group_code")


def reach_from(net: Network, start: str, max_min: float, wait: float = WAIT_MIN) -> DataFrame:
    """One-way minutes to every group within the limit; the origin itself takes 0."""
    origin = resolve_station(net.named(start), start, SPREAD_M)
    rows = _mark(_platforms(net, {"from": origin}, max(max_min - wait, 0)), origin, "_o")
    t = F.when(F.col("_o"), F.lit(0).cast("long")).otherwise(F.col("c_from") + to_milli(wait))
    rows = rows.withColumn("t", t).where(F.col("t").isNotNull() & (F.col("t") <= to_milli(max_min)))
    return _group_up(rows, whole(F.min("t")).alias("t_min"))


def band_disks(stations: DataFrame, bands, reached: Column, spare: Column, name: str, rule: WalkRule) -> DataFrame:
    """One walk disk per band and station that qualifies: (band, group_code, lon, lat, radius_m)."""
    rows = stations.withColumn(name, F.explode(F.array(*[F.lit(float(b)) for b in bands])))
    radius = F.least(spare, F.lit(rule.cap_min)) * F.lit(rule.m_per_min) / F.lit(rule.detour)
    return rows.where(reached).select(name, "group_code", "lon", "lat", radius.alias("radius_m"))


def _bands(disks: DataFrame, name: str) -> DataFrame:
    counts = disks.groupBy(name).agg(F.count(F.lit(1)).cast("int").alias("station_count"))
    area = surface_area(disk_cells(disks, [name]), [name])
    return counts.join(area, name, "left").select(
        name, "station_count", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("area_m2", F.lit(0.0)).alias("area_m2")
    )


def bands_of(reached: DataFrame, bands=REACH_BANDS, rule: WalkRule = WalkRule()) -> DataFrame:
    """Time bands of a reach table; a station counts for a band it is strictly inside."""
    disks = band_disks(reached, bands, F.col("t_min") < F.col("band_min"), F.col("band_min") - F.col("t_min"), "band_min", rule)
    return _bands(disks, "band_min")


def isochrone_bands(net: Network, start: str, bands=REACH_BANDS, rule: WalkRule = WalkRule(), wait: float = WAIT_MIN) -> DataFrame:
    """Station count and covered surface of each time band.

    The surface is the set of grid cells under the walk disks, given as a cell count and an area.
    """
    return bands_of(reach_from(net, start, float(max(bands)), wait), bands, rule)


def spots_of(reached: DataFrame, places: DataFrame, max_min: float, rule: WalkRule = WalkRule()) -> DataFrame:
    """Earliest arrival at each place over the stations of a reach table, ties by group code."""
    st = reached.select("group_code", "station_name", "t_min", "lon", "lat")
    near = within_distance(places.select("spot_id", "lon", "lat"), st, rule.radius_m, "spot_id")
    cand = near.withColumn("walk", rule.minutes(F.col("dist_m"))).withColumn("t", F.col("t_min") + F.col("walk"))
    best = (
        cand.where(F.col("t") <= max_min)
        .groupBy("spot_id")
        .agg(F.min(F.struct("t", "group_code", "station_name", "walk")).alias("b"))
    )
    return best.join(places.select("spot_id", "source", "name", "kinds", "lon", "lat"), "spot_id").select(
        "spot_id", "source", "name", "kinds", F.round("b.t", 0).alias("t_min"),
        F.col("b.station_name").alias("via_station"), F.round("b.walk", 0).alias("walk_min"), "lon", "lat",
    )


def spots_in_reach(net: Network, places: DataFrame, start: str, max_min: float, rule: WalkRule = WalkRule(), wait: float = WAIT_MIN) -> DataFrame:
    return spots_of(reach_from(net, start, max_min, wait), places, max_min, rule)


def reach_list(spots: DataFrame, minutes: float, limit: int = 200) -> DataFrame:
    """Places within the minutes, sample places first, then by time; the list shows at most 200."""
    return (
        spots.where(F.col("t_min") <= minutes)
        .orderBy((F.col("source") != "sample").cast("int"), "t_min", "spot_id")
        .limit(limit)
    )


def reach_map_json(net: Network, places: DataFrame, start: str, max_min: float = 60) -> DataFrame:
    """One row with the bands, stations and places of a reach search as GeoJSON documents."""
    st = cut_lineage(reach_from(net, start, max_min))
    bands = bands_of(st.where(F.col("t_min") <= max_min), [b for b in REACH_BANDS if b <= max_min])
    spots = spots_of(st, places, max_min)
    none = F.lit(None).cast("string")
    b = feature_collection(bands, feature({"band_min": F.col("band_min"), "station_count": F.col("station_count"), "area_m2": F.col("area_m2")}, none), [-F.col("band_min")])
    s = feature_collection(st, feature({"name": F.col("station_name"), "t_min": F.col("t_min"), "lines": F.col("lines")}, point_geometry(F.col("lon"), F.col("lat"))), [F.col("group_code")])
    p = feature_collection(
        spots,
        feature(
            {"name": F.col("name"), "source": F.col("source"), "kinds": F.col("kinds"), "t_min": F.col("t_min"), "via": F.col("via_station"), "walk_min": F.col("walk_min")},
            point_geometry(F.col("lon"), F.col("lat")),
        ),
        [F.col("spot_id")],
    )
    return _one_document({"bands": b, "stations": s, "spots": p}).select(
        F.lit(start).alias("from"), F.lit(float(max_min)).alias("max_min"), "bands", "stations", "spots"
    )


def _one_document(parts: dict[str, DataFrame]) -> DataFrame:
    """Single-row collections side by side."""
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(1).alias("_k"), F.col("collection").alias(name))
        out = row if out is None else out.join(row, "_k")
    return out.drop("_k")


# ------------------------------------------------------------------ detours


def detour_stations(net: Network, start: str, end: str, available: float, wait: float = WAIT_MIN) -> DataFrame:
    """Groups on the way with t1, t2, slack and role (origin, dest or via)."""
    named = net.named(start, end)
    groups = {"from": resolve_station(named, start, SPREAD_M), "to": resolve_station(named, end, SPREAD_M)}
    rows = _platforms(net, groups, max(available - wait, 0))
    rows = _mark(_mark(rows, groups["from"], "_o"), groups["to"], "_d")
    w = to_milli(wait)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("t1", F.when(F.col("_o"), zero).otherwise(F.col("c_from") + w)).withColumn(
        "t2", F.when(F.col("_d"), zero).otherwise(F.col("c_to") + w)
    ).where(F.col("t1").isNotNull() & F.col("t2").isNotNull())
    per = _group_up(
        rows, F.min("t1").alias("t1"), F.min("t2").alias("t2"), F.max("_o").alias("_o"), F.max("_d").alias("_d")
    ).withColumn("slack", F.lit(to_milli(available)) - F.col("t1") - F.col("t2"))
    return per.where(F.col("slack") >= 0).select(
        "group_code", "station_name", "lines", whole(F.col("t1")).alias("t1_min"), whole(F.col("t2")).alias("t2_min"),
        whole(F.col("slack")).alias("slack_min"),
        F.when(F.col("_o"), "origin").when(F.col("_d"), "dest").otherwise("via").alias("role"), "lon", "lat",
    )


def detour_route(net: Network, start: str, end: str, wait: float = WAIT_MIN, within: float = 0) -> DataFrame:
    """Groups on the shortest path in order; the wait is added except at the start.

    ``within`` are the minutes in which a way is looked for first; the result does not depend on them.
    """
    named = net.named(start, end)
    first, last = resolve_station(named, start, SPREAD_M), resolve_station(named, end, SPREAD_M)
    net = net.towards(first, last, to_milli(within))
    path = shortest_route(net.arcs, group_nodes(net.stations, first), group_nodes(net.stations, last), adj=net.adj)
    ends = net.stations.withColumn("node", F.explode(F.array_distinct(F.array("node_a", "node_b"))))
    on = ends.join(path, "node").groupBy("group_code").agg(
        F.min("station_name").alias("station_name"), F.min("cost").alias("t"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")
    )
    # One route: the number of rows is the number of stations passed.
    w = Window.orderBy("t", "group_code")
    minutes = F.when(F.col("t") == 0, F.lit(0.0)).otherwise(whole(F.col("t") + to_milli(wait)))
    return on.select(F.row_number().over(w).alias("seq"), "group_code", "station_name", minutes.alias("t1_min"), "lon", "lat")


def detour_bands_of(stations: DataFrame, bands=STAY_BANDS, rule: WalkRule = WalkRule()) -> DataFrame:
    """Stay bands: stations with strictly more slack than the stay, the destination left out."""
    spare = (F.col("slack_min") - F.col("stay_min")) / 2
    disks = band_disks(
        stations.where(F.col("role") != "dest"), bands, F.col("slack_min") > F.col("stay_min"), spare, "stay_min", rule
    )
    return _bands(disks, "stay_min")


def detour_spots_of(stations: DataFrame, places: DataFrame, min_stay: float = MIN_STAY, rule: WalkRule = WalkRule()) -> DataFrame:
    """Best station per place by the time left there after walking both ways."""
    st = stations.where(F.col("role") != "dest").select("group_code", "station_name", "t1_min", "slack_min", "lon", "lat")
    near = within_distance(places.select("spot_id", "lon", "lat"), st, rule.radius_m, "spot_id")
    cand = near.withColumn("walk", rule.minutes(F.col("dist_m"))).withColumn("stay", F.col("slack_min") - 2 * F.col("walk"))
    best = (
        cand.where(F.col("stay") >= min_stay)
        .groupBy("spot_id")
        .agg(F.min(F.struct((-F.col("stay")).alias("neg"), "group_code", "station_name", "t1_min", "walk")).alias("b"))
    )
    return best.join(places.select("spot_id", "source", "name", "kinds", "lon", "lat"), "spot_id").select(
        "spot_id", "source", "name", "kinds", F.col("b.group_code").alias("via_group"), F.col("b.station_name").alias("via"),
        F.col("b.t1_min").alias("t1_min"), F.round(-F.col("b.neg"), 0).alias("stay_min"), F.round("b.walk", 0).alias("walk_min"),
        "lon", "lat",
    )


def detour_map_json(net: Network, places: DataFrame, start: str, end: str, available: float, min_stay: float = MIN_STAY) -> DataFrame:
    """One row with the bands, stations, places and route of a detour search."""
    st = cut_lineage(detour_stations(net, start, end, available))
    route = detour_route(net, start, end, within=max(available - WAIT_MIN, 0)).join(st.select("group_code", "slack_min"), "group_code", "left")
    bands, spots = detour_bands_of(st), detour_spots_of(st, places, min_stay)
    none = F.lit(None).cast("string")
    point = point_geometry(F.col("lon"), F.col("lat"))
    b = feature_collection(bands, feature({"stay_min": F.col("stay_min"), "station_count": F.col("station_count"), "area_m2": F.col("area_m2")}, none), [F.col("stay_min")])
    s = feature_collection(
        st,
        feature(
            {"group": F.col("group_code"), "name": F.col("station_name"), "t1_min": F.col("t1_min"), "t2_min": F.col("t2_min"), "slack_min": F.col("slack_min"), "role": F.col("role"), "lines": F.col("lines")},
            point,
        ),
        [F.col("group_code")],
    )
    p = feature_collection(
        spots,
        feature(
            {"name": F.col("name"), "source": F.col("source"), "kinds": F.col("kinds"), "via": F.col("via"), "via_group": F.col("via_group"), "t1_min": F.col("t1_min"), "stay_min": F.col("stay_min"), "walk_min": F.col("walk_min")},
            point,
        ),
        [F.col("spot_id")],
    )
    stop = F.to_json(
        F.struct("seq", F.col("station_name").alias("name"), "t1_min", "slack_min", F.round("lon", 6).alias("lng"), F.round("lat", 6).alias("lat"))
    )
    r = route.agg(
        F.concat(
            F.lit("["),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", stop.alias("j")))), lambda x: x["j"]), ","),
            F.lit("]"),
        ).alias("collection")
    )
    total = st.where(F.col("role") == "origin").agg(F.min("t2_min").alias("collection"))
    return _one_document({"min_total": total, "bands": b, "stations": s, "spots": p, "route": r}).select(
        F.lit(start).alias("from"), F.lit(end).alias("to"), F.lit(float(available)).alias("available_min"),
        "min_total", "bands", "stations", "spots", "route",
    )


def collapse_repeats(routes: DataFrame, by: list[str]) -> DataFrame:
    """Stops of each route without those named like the stop before; a route is what shares ``by``, in the order of ``seq``."""
    prev = F.lag("station_name").over(Window.partitionBy(*by).orderBy("seq"))
    return routes.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("_p") != F.col("station_name"))).drop("_p")


def detour_areas(stations: DataFrame, spots: DataFrame, radius_m: float = AREA_RADIUS_M, order: str = "spots") -> DataFrame:
    """Destinations grouped around leading stations.

    Stations of at least 15 minutes' slack are ranked by voiced places, places and slack. A
    leader is a station with no higher-ranked leader within the radius, and a station joins
    the highest-ranked leader in its radius. That is the result of taking leaders one by one
    from the top, found in parallel rounds: a station is settled once all its higher-ranked
    neighbours are.
    """
    count = spots.groupBy(F.col("via_group").alias("group_code")).agg(
        F.count(F.lit(1)).alias("n_spots"), F.count(F.when(F.col("source") == "sample", 1)).alias("voiced")
    )
    cand = (
        stations.where((F.col("role") != "dest") & (F.col("slack_min") >= MIN_STAY))
        .join(count, "group_code", "left")
        .fillna(0, ["n_spots", "voiced"])
    )
    rank = F.struct((-F.col("voiced")).alias("v"), (-F.col("n_spots")).alias("n"), (-F.col("slack_min")).alias("s"), F.col("group_code").alias("g"))
    cand = cut_lineage(cand.withColumn("prio", rank))
    near = within_distance(
        cand.select("group_code", "prio", "lon", "lat"),
        cand.select(F.col("group_code").alias("other"), F.col("prio").alias("other_prio"), "lon", "lat"),
        radius_m, "group_code",
    )
    above = cut_lineage(near.where(F.col("other_prio") < F.col("prio")).select("group_code", "other"))
    state = cand.select("group_code", F.lit(None).cast("boolean").alias("leader"))
    while True:
        seen = above.join(state.select(F.col("group_code").alias("other"), F.col("leader").alias("up")), "other").groupBy("group_code").agg(
            F.max(F.coalesce("up", F.lit(False))).alias("covered"), F.max(F.col("up").isNull()).alias("open")
        )
        state = cut_lineage(
            state.join(seen, "group_code", "left").select(
                "group_code",
                F.coalesce(
                    "leader",
                    F.when(F.coalesce("covered", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True)),
                ).alias("leader"),
            )
        )
        if state.where(F.col("leader").isNull()).isEmpty():
            break
    lead = state.where("leader").select(F.col("group_code").alias("other"))
    area = near.join(lead, "other", "left_semi").where(F.col("other_prio") <= F.col("prio")).groupBy("group_code").agg(
        F.min_by("other", "other_prio").alias("area")
    )
    member = cand.join(area, "group_code")
    origin_total = stations.where(F.col("role") == "origin").agg(F.min("t2_min").alias("min_total"))
    member = member.join(F.broadcast(origin_total))  # one row
    per = member.groupBy("area").agg(
        F.count(F.lit(1)).alias("members"),
        F.max("slack_min").alias("stay"),
        F.greatest(F.lit(0.0), F.min(F.col("t1_min") + F.col("t2_min") - F.col("min_total"))).alias("detour"),
        F.max(F.col("role") == "origin").alias("origin"),
    )
    # Area name: the two names whose stations have the most places.
    named = member.groupBy("area", "station_name").agg(
        F.min(F.struct((-F.col("n_spots")).alias("n"), (-F.length("lines")).alias("l"), "prio")).alias("o")
    )
    w = Window.partitionBy("area").orderBy("o")
    names = named.withColumn("i", F.row_number().over(w)).where("i <= 2").groupBy("area").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "station_name"))), lambda x: x["station_name"]), "・").alias("joined"),
        F.count(F.lit(1)).alias("k"),
    ).select("area", F.concat("joined", F.when(F.col("k") > 1, "のあたり").otherwise("")).alias("name"))
    # A place seen through several stations counts once.
    kept = (
        spots.join(member.select(F.col("group_code").alias("via_group"), "area"), "via_group")
        .groupBy("area", "name", "source")
        .agg(F.max("stay_min").alias("stay_min"))
        .groupBy("area")
        .agg(F.count(F.lit(1)).alias("spots"), F.count(F.when(F.col("source") == "sample", 1)).alias("voiced"))
    )
    out = per.join(names, "area").join(kept, "area", "left").fillna(0, ["spots", "voiced"])
    return out.orderBy(*area_order(order), "area")


def area_order(mode: str) -> list[Column]:
    """Orderings of areas: by places, by stay or by detour."""
    return {
        "spots": [F.desc("voiced"), F.desc("spots"), F.desc("stay")],
        "stay": [F.desc("stay"), F.desc("spots")],
        "detour": [F.asc("detour"), F.desc("spots")],
    }[mode]


def station_prefix_search(stations: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Names that start with a prefix, for completion; the limit is the length of the list shown."""
    return stations.where(F.col("station_name").startswith(prefix)).select("station_name").distinct().orderBy("station_name").limit(limit)
