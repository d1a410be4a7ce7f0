"""Area matching, access points, exits and timetable queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopover.functions import rules as R
from stopover.functions.geo import LINE, walk_minutes
from stopover.operators import network, places, spatial, suggest, timetable
from stopover.plans import derived as D
from stopover.plans import sql as S

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


_KINDS = ("湖", "公園", "神社", "寺", "城", "博物館", "動物園", "山", "店", "道")
_TAGS = (("natural", "water"), ("leisure", "park"), ("amenity", "place_of_worship"), ("historic", "castle"), ("tourism", "museum"), ("shop", "yes"))
KANTO = (138.4, 34.8, 140.9, 37.2)


def elements(spark, sf):
    """Parts as square areas around their position, with tags by key; some are borders, buildings or too wide."""
    k = F.col("p_partkey")
    lon, lat = D.lon_of(k, D.PART_TILE), D.lat_of(k, D.PART_TILE)
    half = F.col("p_size") * 0.0001
    corner = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    ring = F.array(*[F.struct((lon + half * x).alias("lon"), (lat + half * y).alias("lat")) for x, y in corner]).cast(LINE)
    pairs = F.array(*[F.struct(F.lit(a).alias("k"), F.lit(b).alias("v")) for a, b in _TAGS])
    main = F.element_at(pairs, (k % len(_TAGS) + 1).cast("int"))
    tags = F.map_filter(
        F.create_map(
            main["k"], main["v"], F.lit("name"), F.col("p_name"),
            F.lit("wikidata"), F.when(k % 3 == 0, F.concat(F.lit("Q"), k.cast("string"), F.lit("; Q"), (k + 1).cast("string"))),
            F.lit("building"), F.when(k % 7 == 0, "yes"), F.lit("boundary"), F.when(k % 11 == 0, "administrative"),
        ),
        lambda _, v: v.isNotNull(),
    )
    nodes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: k * 4 + i)
    return D.table(spark, sf, "part").select(
        F.lit("way").alias("osm_type"), k.alias("osm_id"), tags.alias("tags"), F.array(ring).alias("outers"),
        F.array().cast(f"array<{LINE}>").alias("inners"), nodes.alias("ring_nodes"),
    )


def point_elements(spark, sf):
    """Corner nodes of the squares as tagged points: gates, private gates, exits and stations by key."""
    k, i = F.col("p_partkey"), F.col("i")
    lon, lat = D.lon_of(k, D.PART_TILE), D.lat_of(k, D.PART_TILE)
    half = F.col("p_size") * 0.0001
    x = F.when(i.isin(1, 2), 1).otherwise(-1)
    y = F.when(i >= 2, 1).otherwise(-1)
    p = D.table(spark, sf, "part").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    barrier = F.when(k % 5 == 0, F.when(i == 1, "gate").when(i == 2, "wall"))
    railway = F.when(i == 3, F.when(k % 4 == 0, "subway_entrance").when(k % 4 == 1, "station"))
    tags = F.map_filter(
        F.create_map(
            F.lit("barrier"), barrier, F.lit("railway"), railway, F.lit("access"), F.when(k % 10 == 0, "private"),
            F.lit("name"), F.concat(F.lit("N"), k.cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return p.select((k * 4 + i).alias("node_id"), (lon + half * x).alias("lon"), (lat + half * y).alias("lat"), tags.alias("tags"))


def tagged_places(spark, sf):
    k = F.col("spot_id")
    kinds = F.array(*[F.lit(x) for x in _KINDS])
    p = D.places(spark, sf).withColumn("source", F.lit("wikidata")).withColumn("ext_id", F.concat(F.lit("Q"), k.cast("string")))
    return places.with_group(p.withColumn("kinds", F.element_at(kinds, (k % len(_KINDS) + 1).cast("int"))))


def areas(spark, sf):
    return D._memo(spark, "areas", sf, lambda: D.cut_lineage(places.area_extract(elements(spark, sf))))


def tagged(spark, sf):
    pts = places.point_extract(point_elements(spark, sf))
    members = spatial.ring_members(areas(spark, sf), pts, "area_idx").select("area_idx", "node_id")
    return places.tagged_entrances(members, pts)


def crossings(spark, sf):
    ways = D.roads(spark, sf).select(F.xxhash64("line").alias("way_id"), F.lit("footway").alias("highway"), F.lit("").alias("access"), F.lit("").alias("foot"), "line").distinct()
    return spatial.line_area_crossings(ways, areas(spark, sf), "way_id", "area_idx")


_PLON, _PLAT = S.lon("p_partkey", 2000), S.lat("p_partkey", 2000)
_AREA = f"""
area as materialized (
  select *, x0 + h as x1, y0 + h as y1 from (
    select p_partkey as k, p_name as name, {_PLON} - p_size*0.0001::double as x0, {_PLAT} - p_size*0.0001::double as y0, {_PLON} as cx, {_PLAT} as cy, p_size*0.0001::double*2 as h, p_size,
      ['natural=water','leisure=park','amenity=place_of_worship','historic=castle','tourism=museum',''][(p_partkey % 6 + 1)::int] as kind,
      round(p_size*0.0002::double*91000*p_size*0.0002::double*111000)::bigint as area_m2
    from part) where (k % 3 = 0 or kind <> '') and k % 11 <> 0 and not (k % 7 = 0 and kind = ''))
"""
_GROUPS = "['湖・池・沼','公園・庭園','神社','寺','城・城跡','博物館・美術館','動物園・水族館','山・滝・自然','その他','その他']"
_MATCH = f"""
pl as materialized (select spot_id, lon, lat, {_GROUPS}[(spot_id % 10 + 1)::int] as grp from spot),
byq as (select spot_id, k, row_number() over (partition by spot_id order by area_m2 desc, k) as rn from pl join (select k, area_m2, k as q from area where k % 3 = 0 union all select k, area_m2, k + 1 from area where k % 3 = 0) on q = spot_id),
byc as (select spot_id, k, row_number() over (partition by spot_id order by area_m2, k) as rn, area_m2, rank() over (partition by spot_id order by area_m2) as rk from pl join area on kind <> '' and lon > x0 and lon < x1 and lat > y0 and lat < y1
  where spot_id not in (select spot_id from byq) and case grp when '湖・池・沼' then kind = 'natural=water' when '公園・庭園' then kind = 'leisure=park' when '神社' then kind = 'amenity=place_of_worship'
   when '寺' then kind = 'amenity=place_of_worship' when '城・城跡' then kind in ('historic=castle', 'leisure=park') when '博物館・美術館' then kind = 'tourism=museum' when '動物園・水族館' then false else true end),
mt as materialized (select pl.spot_id, lon, lat, grp, coalesce(q.k, c.k) as k, case when q.k is not null then 'wikidata' when c.k is not null then 'contains' else '' end as match
  from pl left join (select * from byq where rn = 1) q using (spot_id) left join (select * from byc where rn = 1) c using (spot_id))
"""
_PLACES = f"with {S.SPOTS}, {_AREA}, {_MATCH}"


@query("area_extract", f"with {_AREA} select k as osm_id, kind, area_m2, 4::int as n_ring_nodes from area")
def _(spark, sf):
    return areas(spark, sf).select("osm_id", "kind", "area_m2", "n_ring_nodes")


@query("point_extract", "select p_partkey*4 + i as node_id, case when p_partkey % 5 = 0 and i = 1 then 'gate' when p_partkey % 5 = 0 and i = 2 then 'wall' else '' end as barrier, case when i = 3 and p_partkey % 4 = 0 then 'subway_entrance' when i = 3 and p_partkey % 4 = 1 then 'station' else '' end as railway from part, unnest([0, 1, 2, 3]) u(i) where (p_partkey % 5 = 0 and i = 1) or (i = 3 and p_partkey % 4 < 2)")
def _(spark, sf):
    return places.point_extract(point_elements(spark, sf)).select("node_id", "barrier", "railway")


@query("place_groups", f"with {S.SPOTS} select {_GROUPS}[(spot_id % 10 + 1)::int] as \"group\", count(*) as places from spot group by 1")
def _(spark, sf):
    return tagged_places(spark, sf).groupBy("group").agg(F.count(F.lit(1)).alias("places"))


@query("match_area", _PLACES + "select spot_id, k as osm_id, match from mt")
def _(spark, sf):
    a = areas(spark, sf)
    m = places.match_area(tagged_places(spark, sf), a)
    # Ties between equal areas are settled by key here and in the SQL.
    return m.join(a.select("area_idx", "osm_id"), "area_idx", "left").select("spot_id", "osm_id", "match")


@query("edge_points", f"with {_AREA} select k as osm_id, greatest(1, floor(l/greatest(100.0::double, l/200)))::bigint as points, round(cx, 5) as lon from (select *, 2*(h*91000 + h*111000) as l from area)")
def _(spark, sf):
    a = areas(spark, sf)
    pts = places.edge_points(a).groupBy("area_idx").agg(F.count(F.lit(1)).alias("points"), F.min("lon").alias("lo"), F.max("lon").alias("hi"))
    half = pts.join(a.select("area_idx", "osm_id", F.element_at(F.element_at("outers", 1), 1)["lon"].alias("x0"), F.element_at(F.element_at("outers", 1), 2)["lon"].alias("x1")), "area_idx")
    return half.select("osm_id", "points", F.round((F.col("x0") + F.col("x1")) / 2, 5).alias("lon"))


_CROSS = f"""{S.ROADS.replace('wedge as materialized', 'wedge as')}, {_AREA},
cr as materialized (
  select distinct k, round(x, 7) as x, round(y, 7) as y from (
    select k, unnest([x0, x1]) as x, lat1 as y, lon1, lon2, y0, y1 from road join area on lat1 = lat2 and lat1 > y0 and lat1 < y1 and lon2 >= x0 and lon1 <= x1) where x between lon1 and lon2
  union
  select distinct k, round(x, 7), round(y, 7) from (
    select k, lon1 as x, unnest([y0, y1]) as y, lat1, lat2 from road join area on lon1 = lon2 and lon1 > x0 and lon1 < x1 and lat2 >= y0 and lat1 <= y1) where y between lat1 and lat2)
"""


@query("line_area_crossings", "with " + _CROSS.replace("from road join", "from road_all join").replace("road as materialized", "road_all as materialized").replace("where toll is distinct from '2' and road_class is distinct from '4' and state is distinct from '5'", "").replace("from road)", "from road_all)").replace("as m from road", "as m from road_all") + "select k as osm_id, count(*) as crossings from cr group by 1")
def _(spark, sf):
    c = crossings(spark, sf).groupBy("area_idx").agg(F.count(F.lit(1)).alias("crossings"))
    return c.join(areas(spark, sf).select("area_idx", "osm_id"), "area_idx").select("osm_id", "crossings")


@query("tagged_entrances", f"with {_AREA} select k as osm_id, 'gate' as kind, round(x1, 7) as lon, round(y0, 7) as lat from area where k % 5 = 0 and k % 10 <> 0")
def _(spark, sf):
    t = tagged(spark, sf).join(areas(spark, sf).select("area_idx", "osm_id"), "area_idx")
    return t.select("osm_id", "kind", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("access_points")
def _(spark, sf):
    a = areas(spark, sf)
    m = places.match_area(tagged_places(spark, sf), a)
    return places.access_points(m, a, tagged(spark, sf), places.open_crossings(crossings(spark, sf)))


@query("access_sources")
def _(spark, sf):
    a = areas(spark, sf)
    m = places.match_area(tagged_places(spark, sf), a)
    return suggest.access_sources(places.access_points(m, a, tagged(spark, sf), places.open_crossings(crossings(spark, sf))))


def _offsets(spark, sf):
    a = areas(spark, sf)
    p = tagged_places(spark, sf)
    return D.cut_lineage(places.area_offsets(p, places.match_area(p, a), a, tagged(spark, sf), places.open_crossings(crossings(spark, sf))))


@query("area_summary", _PLACES + "select coalesce(grp, 'total') as \"group\", count(*) as n, count(*) filter (match = 'wikidata') as by_tag, count(*) filter (match = 'contains') as by_position, count(*) filter (match <> '' and k % 5 = 0 and k % 10 <> 0) as with_entrance from mt group by rollup (grp)")
def _(spark, sf):
    return places.area_summary(_offsets(spark, sf)).select("group", "n", "by_tag", "by_position", "with_entrance")


@query("offset_percentiles")
def _(spark, sf):
    return places.offset_percentiles(_offsets(spark, sf))


_PLANAR = "sqrt(((p.lon - g.lon)*91000)*((p.lon - g.lon)*91000) + ((p.lat - g.lat)*111000)*((p.lat - g.lat)*111000))"
_EXITS = f"""with {S.RAIL}, grp as materialized (select group_code, min(partkey) as partkey, {S.POINT} from st group by 1),
ex as (select p_partkey*4 + 3 as node_id, {_PLON} - p_size*0.0001::double as lon, {_PLAT} + p_size*0.0001::double as lat from part where p_partkey % 4 = 0 and p_partkey % 10 <> 0),
own as materialized (select node_id, group_code, d from (select node_id, group_code, {_PLANAR} as d, row_number() over (partition by node_id order by {_PLANAR}, group_code) as rn from ex p join grp g on g.lon between p.lon - 0.006 and p.lon + 0.006 and g.lat between p.lat - 0.005 and p.lat + 0.005) where rn = 1 and d <= 500),
ms as (select p_partkey as partkey, {_PLON} - p_size*0.0001::double as lon, {_PLAT} + p_size*0.0001::double as lat from part where p_partkey % 4 = 1)
"""


@query("station_exits", _EXITS + f"select g.group_code, coalesce(n, 0) as n_exit, near_exit_m, case when m <= 1000 then round_even(m, 0) end as osm_station_m from grp g left join (select group_code, count(*) as n, round_even(min(d), 0) as near_exit_m from own group by 1) using (group_code) left join (select g.group_code, {_PLANAR} as m from grp g join ms p using (partkey)) x on x.group_code = g.group_code")
def _(spark, sf):
    out, _ = places.station_exits(D.rail_network(spark, sf).stations, places.point_extract(point_elements(spark, sf)))
    return out.select("group_code", "n_exit", "near_exit_m", "osm_station_m")


@query("exit_summary", _EXITS + "select (select count(*) from grp) as groups, (select count(distinct group_code) from own) as with_exit, (select max(n) from (select count(*) as n from own group by group_code)) as most_exits")
def _(spark, sf):
    out, _ = places.station_exits(D.rail_network(spark, sf).stations, places.point_extract(point_elements(spark, sf)))
    return places.exit_summary(D.cut_lineage(out)).select("groups", "with_exit", "most_exits")


@query("place_access", None)
def _(spark, sf):
    a = areas(spark, sf)
    p = tagged_places(spark, sf)
    ap = places.access_points(places.match_area(p, a), a, tagged(spark, sf), places.open_crossings(crossings(spark, sf)))
    ap = ap.withColumn("ap_id", F.xxhash64("spot_id", "lon", "lat"))
    nodes, _ = D.walk_network(spark, sf)
    out = network.place_access(p, ap, nodes)
    return out.groupBy("spot_id").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.min("access_m"), 3).alias("least_access_m"))


def _walk_variants(spark, sf):
    """Walks of at most 10 minutes under six kinds of access: (variant, group_code, spot_id, walk_min).

    Stations by their centre or their exits, places by their point or their access points, over the network (``net_``) and,
    from the centre, in a straight line (``line_``). One search serves all four network variants: only the ends differ.
    """
    a = areas(spark, sf)
    p = tagged_places(spark, sf)
    ap = D.cut_lineage(places.access_points(places.match_area(p, a), a, tagged(spark, sf), places.open_crossings(crossings(spark, sf))))
    nodes, edges = D.walk_network(spark, sf)
    stations, own = D.walk_access(spark, sf)
    net = D.rail_network(spark, sf)
    _, exits = places.station_exits(net.stations, places.point_extract(point_elements(spark, sf)))
    at_exits = network.snap_to_network(exits.select(F.col("node_id").alias("exit_id"), "group_code", "lon", "lat"), nodes, ["exit_id", "group_code"])
    starts = stations.select(F.lit("centre").alias("s"), "group_code", "node_id", "access_m").unionByName(at_exits.select(F.lit("exit").alias("s"), "group_code", "node_id", "access_m"))
    access = network.place_access(p, ap.withColumn("ap_id", F.xxhash64("spot_id", "lon", "lat")), nodes)
    ends = own.select(F.lit("point").alias("v"), "spot_id", "node_id", "access_m").unionByName(access.select(F.lit("ap").alias("v"), "spot_id", "node_id", "access_m"))
    walks = suggest.station_place_walks(
        network.walk_arcs(edges), starts.select(F.struct("s", "group_code").alias("group_code"), "node_id", "access_m"),
        ends.select(F.struct("v", "spot_id").alias("spot_id"), "node_id", "access_m"), 10,
    )
    by_net = walks.select(
        F.concat_ws("_", F.lit("net"), "group_code.s", "spot_id.v").alias("variant"), F.col("group_code.group_code").alias("group_code"), F.col("spot_id.spot_id").alias("spot_id"), "walk_min",
    )
    spots = p.select(F.lit("point").alias("v"), "spot_id", "lon", "lat").unionByName(ap.select(F.lit("ap").alias("v"), "spot_id", "lon", "lat"))
    near = spatial.within_distance(spots, network.group_centroids(net.stations), 800.0, "spot_id")
    by_line = near.select(F.concat_ws("_", F.lit("line_centre"), "v").alias("variant"), "group_code", "spot_id", walk_minutes(F.col("dist_m")).alias("walk_min"))
    return D.cut_lineage(by_net.unionByName(by_line))


@query("access_impact")
def _(spark, sf):
    w = _walk_variants(spark, sf)
    return suggest.impact_summary(suggest.access_impact(w.where("variant = 'net_centre_point'"), w.where("variant = 'net_centre_ap'")))


@query("access_report")
def _(spark, sf):
    w = _walk_variants(spark, sf)
    return suggest.impact_report(w.where("variant = 'net_centre_point'"), w.where("variant = 'net_centre_ap'"))


@query("delta_matrix")
def _(spark, sf):
    return suggest.delta_matrix(_walk_variants(spark, sf), shares=(0.2, 0.5, 0.8))


@query("smallest_band", f"with {S.SPOTS}, b as (select p_partkey, {_PLON} as x, {_PLAT} as y, m from part, unnest([15, 30]) u(m)) select spot_id, min(m)::int as minutes from spot join b on lon > x - m*0.0004::double and lon < x + m*0.0004::double and lat > y - m*0.0004::double and lat < y + m*0.0004::double group by 1")
def _(spark, sf):
    k = F.col("p_partkey")
    lon, lat = D.lon_of(k, D.PART_TILE), D.lat_of(k, D.PART_TILE)
    b = D.table(spark, sf, "part").withColumn("minutes", F.explode(F.array(F.lit(15), F.lit(30))))
    half = F.col("minutes") * 0.0004
    ring = F.array(*[F.struct((lon + half * x).alias("lon"), (lat + half * y).alias("lat")) for x, y in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]]).cast(LINE)
    return spatial.smallest_band(D.places(spark, sf).select("spot_id", "lon", "lat"), b.select("minutes", F.array(ring).alias("rings")), "spot_id", "minutes", [])


# ------------------------------------------------------------------ timetable


def _platform_edges(spark, sf, keep=False):
    net = D.rail_network(spark, sf)
    edges = network.edge_minutes(network.build_ride_edges(D.rail_features(spark, sf, keep)[1]), net.lines)
    return timetable.platform_edges(edges, net.stations)


def _tables(spark, sf):
    def make():
        net = D.rail_network(spark, sf)
        own = D.cut_lineage(_platform_edges(spark, sf, keep=True))
        trails = D.cut_lineage(timetable.cover_trails(own))
        return trails, timetable.trip_patterns(trails, own, net.stations, net.lines, KANTO)

    return make()


@query("cover_trails", f"with {S.RAIL} select operator, line_name, 1::bigint as trails, count(*) as edges, round(sum({S._RIDE.format(m='m').replace('speed', 'edge.speed')}), 6) as minutes from edge join line using (suppkey) group by 1, 2")
def _(spark, sf):
    trails = timetable.cover_trails(_platform_edges(spark, sf))  # read once, so neither they nor the edges are kept
    per = trails.groupBy("line_id").agg(F.countDistinct("trail").alias("trails"), F.count(F.lit(1)).alias("edges"), F.round(F.sum("cost"), 6).alias("minutes"))
    return per.join(D.rail_network(spark, sf).lines, "line_id").select("operator", "line_name", "trails", "edges", "minutes")


_HEADWAY = "case service when 'shinkansen' then 10 when 'conventional' then 10 when 'subway' then 5 when 'monorail' then 8 when 'agt' then 8 when 'tram' then 10 when 'cable' then 20 else 15 end"


@query("timetable_tables", f"with {S.RAIL} select operator, line_name, 2::bigint as trips, (select 2*count(*) from st where st.suppkey = line.suppkey) as stop_times, {_HEADWAY}*60 as headway_secs from line where suppkey in (select suppkey from st)")
def _(spark, sf):
    _, t = _tables(spark, sf)
    trips = t["trips"].join(t["routes"], "route_id").join(t["frequencies"], "trip_id")
    n = t["stop_times"].groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    return trips.join(n, "trip_id").groupBy(F.col("agency_id").alias("operator"), F.col("route_long_name").alias("line_name")).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("n").alias("stop_times"), F.max("headway_secs").alias("headway_secs")
    )


@query("timetable_coverage", f"with {S.RAIL} select (select count(distinct group_code) from st) as groups, 0::bigint as groups_missing, (select count(*) from st) as pairs, 0::bigint as pairs_missing, 0::bigint as repeated_hops, 1::bigint as most_trips")
def _(spark, sf):
    _, t = _tables(spark, sf)
    return timetable.timetable_coverage(t, D.rail_network(spark, sf).stations, KANTO)


@query("adjacent_pairs", f"with {S.RAIL} select operator, line_name, 2*(count(*) - 1) as hops from st group by 1, 2")
def _(spark, sf):
    _, t = _tables(spark, sf)
    hops = timetable.adjacent_pairs(t["stop_times"], t["trips"]).groupBy("route_id").agg(F.sum("trips").alias("hops"))
    return hops.join(t["routes"], "route_id").select(F.col("agency_id").alias("operator"), F.col("route_long_name").alias("line_name"), "hops")


@query("service_types", f"with {S.LINES} select service as service_type, count(*) as lines, max(speed) as speed_kmh from line group by 1")
def _(spark, sf):
    a = D.line_attributes(spark, sf)
    t = a.withColumn("service_type", R.service_type(F.col("operator"), F.col("operator_type"), F.col("rail_class")))
    return t.groupBy("service_type").agg(F.count(F.lit(1)).alias("lines"), F.max(R.default_speed(F.col("service_type"))).alias("speed_kmh"))
