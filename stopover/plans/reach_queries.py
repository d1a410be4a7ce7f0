"""Rail, walking, reachability and suggestion queries over the derived network."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopover.functions.geo import line_interpolate
from stopover.functions.stats import percentiles
from stopover.operators import graph, network, reach, suggest
from stopover.operators.spatial import within_distance
from stopover.plans import derived as D
from stopover.plans import sql as S

START, END = "G0", "G1"
AVAILABLE, STAY = 75.0, 30.0
DETOUR_AVAILABLE = 45.0
REACH_MIN = 30.0
WALK_MIN = 10.0
QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _xy(df):
    return df.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


# ------------------------------------------------------------------ network


@query("build_lines", f"with {S.LINES} select operator, line_name, cls as rail_class, optype as operator_type, service as service_type, speed as speed_kmh from line where suppkey in (select l_suppkey from lineitem)")
def _(spark, sf):
    return network.build_lines(D.rail_features(spark, sf)[1]).drop("line_id")


@query("build_nodes", f"with {S.RAIL} select operator, line_name, count(*) as nodes from (select suppkey, na as n from st union all select suppkey, nb from st) join line using (suppkey) group by 1, 2")
def _(spark, sf):
    sections = D.rail_features(spark, sf)[1]
    nodes = network.build_nodes(sections).groupBy("line_id").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(network.build_lines(sections), "line_id").select("operator", "line_name", "nodes")


@query("build_ride_edges", f"with {S.RAIL} select operator, line_name, count(*) as edges, round(sum(m), 2) as metres, round(sum(m/1000.0/edge.speed*60.0), 4) as minutes from edge join line using (suppkey) group by 1, 2")
def _(spark, sf):
    sections = D.rail_features(spark, sf)[1]
    lines = network.build_lines(sections)
    timed = network.edge_minutes(network.build_ride_edges(sections), lines)
    per = timed.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.sum("length_m"), 2).alias("metres"), F.round(F.sum("minutes"), 4).alias("minutes")
    )
    return per.join(lines, "line_id").select("operator", "line_name", "edges", "metres", "minutes")


@query("build_stations", f"with {S.RAIL} select suppkey || '-' || partkey as station_code, station_name, group_code, round(lon + 0.001::double, 6) as lon, round(lat, 6) as lat, true as placed from st")
def _(spark, sf):
    st = network.build_stations(*D.rail_features(spark, sf))
    return _xy(st.select("station_code", "station_name", "group_code", "lon", "lat", F.col("node_a").isNotNull().alias("placed")))


@query("build_transfers", f"with {S.RAIL} select a.group_code, count(*) as transfers from st a join st b on a.group_code = b.group_code and a.suppkey < b.suppkey group by 1")
def _(spark, sf):
    return network.transfer_counts(D.rail_network(spark, sf).stations).where("transfers > 0")


_OVERRIDE_SPAN = 20


@query("speed_overrides", f"""
with {S.RAIL},
o as (select suppkey, min(partkey) as p0, min(partkey) filter (partkey >= lo + {_OVERRIDE_SPAN}) as p1
      from (select *, min(partkey) over (partition by suppkey) as lo from st) group by 1)
select operator, line_name, count(*) as edges, round(min(m/1000.0/60.0*60.0), 6) as least_minutes
from edge join line using (suppkey) join o using (suppkey)
where (edge.s//2) % 10000000 < p1 group by 1, 2""")
def _(spark, sf):
    # Every line runs at 60 km/h from its first station to the first one twenty keys on.
    sections = D.rail_features(spark, sf, keep=True)[1]
    net = D.rail_network(spark, sf)
    edges = network.build_ride_edges(sections)
    st = net.stations.withColumn("partkey", F.split("station_code", "-")[1].cast("long"))
    first = st.groupBy("line_id").agg(F.min("partkey").alias("lo"), F.min_by("station_name", "partkey").alias("from_station"))
    until = st.join(first, "line_id").where(F.col("partkey") >= F.col("lo") + _OVERRIDE_SPAN).groupBy("line_id", "from_station").agg(
        F.min_by("station_name", "partkey").alias("to_station"), F.min(F.split("station_code", "-")[0].cast("int")).alias("id")
    )
    asked = until.join(net.lines, "line_id").select(
        "id", "operator", "line_name", "from_station", "to_station", F.lit(60.0).alias("speed_kmh")
    )
    chosen, _ = graph.resolve_overrides(asked, net.lines, net.stations, edges)
    timed = network.edge_minutes(edges.join(chosen.select("edge_id"), "edge_id", "left_semi"), net.lines, chosen)
    per = timed.groupBy("line_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.min("minutes"), 6).alias("least_minutes"))
    return per.join(net.lines, "line_id").select("operator", "line_name", "edges", "least_minutes")


@query("walk_graph", f"with {S.ROADS} select (select count(*) from wnode) as nodes, (select count(*) from wedge) as edges, (select round(sum(m)/1000, 3) from wedge) as km")
def _(spark, sf):
    nodes, edges = network.build_walk_graph(D.roads(spark, sf))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.lit(1).alias("k"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length_m") / 1000, 3).alias("km"), F.lit(1).alias("k"))
    return n.join(e, "k").drop("k")


@query("snap_to_network", f"with {S.WALK_ACCESS} select group_code, round(m, 3) as access_m from gsnap")
def _(spark, sf):
    st, _ = D.walk_access(spark, sf)
    return st.select("group_code", F.round("access_m", 3).alias("access_m"))


@query("connected_components", f"""
with recursive {S.ROADS}, {S.WALK_ARCS},
lab(n, c) using key (n) as (
  select id, id from wnode
  union all
  select x.n, x.c from (select e.t as n, min(lab.c) as c from lab join warc e on e.s = lab.n group by 1) x
  join recurring.lab r on r.n = x.n where x.c < r.c),
size as (select c, count(*) as n from lab group by 1)
select count(*) as components, sum(n)::bigint as nodes, max(n) as largest, round(max(n)/sum(n), 9) as largest_share,
       count(*) filter (n <= 10) as small_components from size""")
def _(spark, sf):
    nodes, edges = D.walk_network(spark, sf)
    out = graph.component_sizes(graph.connected_components(nodes, edges))
    return out.withColumn("largest_share", F.round("largest_share", 9))


@query("driving_distance", f"""
with recursive {S.RAIL}, {S.ARCS}, {S.search(S.group_seeds({'from': START, 'to': END}), int(REACH_MIN * 1000))}
select o as origin, count(*) as nodes, sum(c)::bigint as total from d group by 1""")
def _(spark, sf):
    net = D.rail_network(spark, sf)
    named = net.named(START, END)
    groups = {o: graph.resolve_station(named, g) for o, g in (("from", START), ("to", END))}
    net, cost = net.search(groups, int(REACH_MIN * 1000))
    real = net.stations.select(F.explode(F.array_distinct(F.array("node_a", "node_b"))).alias("node")).distinct()
    # Transfer hubs are helpers of the search, not nodes of the network.
    return cost.join(real, "node", "left_semi").groupBy("origin").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("cost").alias("total")
    )


# ------------------------------------------------------------------ reachability

_W = 5000
_CAP = int((AVAILABLE - STAY - 10) * 1000)
_REACHABLE = f"""
{S.platforms({'from': START, 'to': END}, _CAP)},
rg as (
  select group_code, min(station_name) as station_name, string_agg(distinct line, '、' order by line) as lines,
         min(c_from) + {_W} as t1, min(c_to) + {_W} as t2, {S.POINT}
  from plat where c_from is not null and c_to is not null group by 1),
reachable_all as materialized (
  select group_code, station_name, lines, round(t1/1000.0) as t1_min, round(t2/1000.0) as t2_min,
         round(({int((AVAILABLE - STAY) * 1000)} - t1 - t2)/1000.0) as slack_min, lon, lat
  from rg where t1 + t2 <= {int((AVAILABLE - STAY) * 1000)}),
r as materialized (select * from reachable_all where group_code not in ('{START}', '{END}'))
"""


@query("reachable", _REACHABLE + "select group_code, station_name, lines, t1_min::double as t1_min, t2_min::double as t2_min, slack_min::double as slack_min, round(lon, 6) as lon, round(lat, 6) as lat from r")
def _(spark, sf):
    return _xy(reach.reachable(D.rail_network(spark, sf), START, END, AVAILABLE, STAY))


_FROM = f"""
{S.platforms({'from': START}, int((REACH_MIN - 5) * 1000))},
tt as (select *, case when group_code = '{START}' then 0 else c_from + {_W} end as t from plat),
rf as materialized (
  select group_code, min(station_name) as station_name, string_agg(distinct line, '、' order by line) as lines,
         round(min(t)/1000.0)::double as t_min, {S.POINT}
  from tt where t is not null and t <= {int(REACH_MIN * 1000)} group by 1)
"""


@query("reach_from", _FROM + "select group_code, station_name, lines, t_min, round(lon, 6) as lon, round(lat, 6) as lat from rf")
def _(spark, sf):
    return _xy(reach.reach_from(D.rail_network(spark, sf), START, REACH_MIN))


def _surface(disks: str, key: str) -> str:
    k_lon = "111000.0::double*cos(radians(35.5::double))"
    return f"""
disk as (select {key}, lon*{k_lon}/250.0::double as x, lat*111000.0::double/250.0::double as y, radius_m/250.0::double as r from ({disks})),
cells as (
  select distinct {key}, sx, sy from (
    select {key}, x, y, r, sx, unnest(generate_series(floor(y - r)::bigint, floor(y + r)::bigint)) as sy from (
      select {key}, x, y, r, unnest(generate_series(floor(x - r)::bigint, floor(x + r)::bigint)) as sx from disk))
  where (sx + 0.5 - x)*(sx + 0.5 - x) + (sy + 0.5 - y)*(sy + 0.5 - y) <= r*r)
"""


# The search goes as far as the widest band.
_ISO_FROM = f"""
{S.platforms({'from': START}, (max(reach.REACH_BANDS) - 5) * 1000)},
tt as (select *, case when group_code = '{START}' then 0 else c_from + {_W} end as t from plat),
rf as materialized (
  select group_code, round(min(t)/1000.0)::double as t_min, {S.POINT}
  from tt where t is not null and t <= {max(reach.REACH_BANDS) * 1000} group by 1)
"""
_BAND_DISKS = "select b::double as band_min, lon, lat, least(b - t_min, 15.0::double)*80.0::double/1.3::double as radius_m from rf, unnest([15.0::double, 30.0::double, 45.0::double, 60.0::double]) u(b) where t_min < b"


@query("isochrone_bands", _ISO_FROM + f", {_surface(_BAND_DISKS, 'band_min')}" + f"select b.band_min, b.n::int as station_count, coalesce(c.n, 0) as cells, coalesce(c.n, 0)*62500.0::double as area_m2 from (select band_min, count(*) as n from ({_BAND_DISKS}) group by 1) b left join (select band_min, count(*) as n from cells group by 1) c using (band_min)")
def _(spark, sf):
    return reach.isochrone_bands(D.rail_network(spark, sf), START)


_RADIUS = 15 * 80 / 1.3
_SPOT_NEAR = S.hav("s.lon", "s.lat", "g.lon", "g.lat")
_SPOTS_IN = f"""
, {S.SPOTS},
cand as (select s.*, g.group_code, g.station_name, g.t_min as ts, {_SPOT_NEAR} as d from spot s join rf g
         on s.lat between g.lat - 0.01 and g.lat + 0.01 and s.lon between g.lon - 0.0125 and g.lon + 0.0125),
best as materialized (
  select * from (select *, d*1.3::double/80.0::double as walk, row_number() over (partition by spot_id order by ts + d*1.3::double/80.0::double, group_code) as rn
                 from cand where d <= {_RADIUS!r} and ts + d*1.3::double/80.0::double <= {REACH_MIN}) where rn = 1)
"""


@query("spots_in_reach", _FROM + _SPOTS_IN + "select spot_id, source, name, kinds, round(ts + walk) as t_min, station_name as via_station, round(walk) as walk_min, round(lon, 6) as lon, round(lat, 6) as lat from best")
def _(spark, sf):
    return _xy(reach.spots_in_reach(D.rail_network(spark, sf), D.places(spark, sf), START, REACH_MIN))


@query("reach_list", _FROM + _SPOTS_IN + "select spot_id, source, round(ts + walk) as t_min from best where round(ts + walk) <= 25 order by source <> 'sample', t_min, spot_id limit 200")
def _(spark, sf):
    spots = reach.spots_in_reach(D.rail_network(spark, sf), D.places(spark, sf), START, REACH_MIN)
    return reach.reach_list(spots, 25).select("spot_id", "source", "t_min")


_COLLECTION = "struct<features:array<struct<type:string>>>"


@query("reach_map_json", _FROM + _SPOTS_IN + f"select '{START}' as \"from\", {REACH_MIN}::double as max_min, (select count(*) from unnest([15, 30]) u(b) where exists (select 1 from rf where t_min < b))::int as bands, (select count(*) from rf)::int as stations, (select count(*) from best)::int as spots")
def _(spark, sf):
    doc = reach.reach_map_json(D.rail_network(spark, sf), D.places(spark, sf), START, REACH_MIN)
    return doc.select("from", "max_min", *[F.size(F.from_json(c, _COLLECTION)["features"]).alias(c) for c in ("bands", "stations", "spots")])


# ------------------------------------------------------------------ detours

_DAV = int(DETOUR_AVAILABLE * 1000)
_DETOUR = f"""
{S.platforms({'from': START, 'to': END}, _DAV - 5000)},
dt as (select *, case when group_code = '{START}' then 0 else c_from + {_W} end as t1,
              case when group_code = '{END}' then 0 else c_to + {_W} end as t2 from plat),
ds as materialized (
  select group_code, min(station_name) as station_name, string_agg(distinct line, '、' order by line) as lines,
         round(min(t1)/1000.0)::double as t1_min, round(min(t2)/1000.0)::double as t2_min,
         round(({_DAV} - min(t1) - min(t2))/1000.0)::double as slack_min,
         case group_code when '{START}' then 'origin' when '{END}' then 'dest' else 'via' end as role, {S.POINT}
  from dt where t1 is not null and t2 is not null group by group_code having {_DAV} - min(t1) - min(t2) >= 0)
"""


@query("detour_stations", _DETOUR + "select group_code, station_name, lines, t1_min, t2_min, slack_min, role, round(lon, 6) as lon, round(lat, 6) as lat from ds")
def _(spark, sf):
    return _xy(reach.detour_stations(D.rail_network(spark, sf), START, END, DETOUR_AVAILABLE))


@query("detour_route", f"""
{S.platforms({'from': START}, 40000)},
goal as (select min(c_from) as total from plat where group_code = '{END}')
select 0.0::double as first_min, round((total + {_W})/1000.0)::double as last_min from goal""")
def _(spark, sf):
    route = reach.detour_route(D.rail_network(spark, sf), START, END)
    return route.agg(F.min_by("t1_min", "seq").alias("first_min"), F.max_by("t1_min", "seq").alias("last_min"))


_STAY_DISKS = "select b::double as stay_min, lon, lat, least((slack_min - b)/2, 15.0::double)*80.0::double/1.3::double as radius_m from ds, unnest([15.0::double, 30.0::double, 60.0::double, 120.0::double]) u(b) where slack_min > b and role <> 'dest'"


@query("detour_bands", _DETOUR + f", {_surface(_STAY_DISKS, 'stay_min')}" + f"select b.stay_min, b.n::int as station_count, coalesce(c.n, 0) as cells, coalesce(c.n, 0)*62500.0::double as area_m2 from (select stay_min, count(*) as n from ({_STAY_DISKS}) group by 1) b left join (select stay_min, count(*) as n from cells group by 1) c using (stay_min)")
def _(spark, sf):
    return reach.detour_bands_of(D.cut_lineage(reach.detour_stations(D.rail_network(spark, sf), START, END, DETOUR_AVAILABLE)))


_DETOUR_SPOTS = f"""
, {S.SPOTS},
cand as (select s.*, g.group_code, g.station_name, g.t1_min, g.slack_min - 2*({_SPOT_NEAR}*1.3::double/80.0::double) as stay,
                {_SPOT_NEAR} as d from spot s join ds g
         on s.lat between g.lat - 0.01 and g.lat + 0.01 and s.lon between g.lon - 0.0125 and g.lon + 0.0125 where g.role <> 'dest'),
dspot as materialized (select * from (select *, row_number() over (partition by spot_id order by stay desc, group_code) as rn from cand where d <= {_RADIUS!r} and stay >= 15) where rn = 1)
"""


@query("detour_spots", _DETOUR + _DETOUR_SPOTS + "select spot_id, source, name, kinds, group_code as via_group, station_name as via, t1_min, round(stay) as stay_min, round(d*1.3::double/80.0::double) as walk_min, round(lon, 6) as lon, round(lat, 6) as lat from dspot")
def _(spark, sf):
    st = D.cut_lineage(reach.detour_stations(D.rail_network(spark, sf), START, END, DETOUR_AVAILABLE))
    return _xy(reach.detour_spots_of(st, D.places(spark, sf)))


@query("detour_map_json", _DETOUR + _DETOUR_SPOTS + f"select '{START}' as \"from\", '{END}' as \"to\", (select min(t2_min) from ds where role = 'origin') as min_total, (select count(*) from unnest([15, 30, 60, 120]) u(b) where exists (select 1 from ds where role <> 'dest' and slack_min > b))::int as bands, (select count(*) from ds)::int as stations, (select count(*) from dspot)::int as spots")
def _(spark, sf):
    doc = reach.detour_map_json(D.rail_network(spark, sf), D.places(spark, sf), START, END, DETOUR_AVAILABLE)
    return doc.select("from", "to", "min_total", *[F.size(F.from_json(c, _COLLECTION)["features"]).alias(c) for c in ("bands", "stations", "spots")])


@query("detour_areas")
def _(spark, sf):
    st = D.cut_lineage(reach.detour_stations(D.rail_network(spark, sf), START, END, DETOUR_AVAILABLE))
    return reach.detour_areas(st, D.cut_lineage(reach.detour_spots_of(st, D.places(spark, sf))))


@query("station_prefix_search", f"with {S.RAIL} select distinct station_name from st where station_name like 'N1%' order by 1 limit 20")
def _(spark, sf):
    return reach.station_prefix_search(D.rail_network(spark, sf).stations, "N1")


# ------------------------------------------------------------------ suggestions

_NEAR = f"""
, {S.SPOTS}, {S.INTEREST},
near as (select s.spot_id, g.group_code, g.station_name, g.t1_min, g.t2_min, g.slack_min, {_SPOT_NEAR} as d
         from spot s join r g on s.lat between g.lat - 0.02 and g.lat + 0.02 and s.lon between g.lon - 0.025 and g.lon + 0.025),
ok as (select *, slack_min - 2*greatest(0.0::double, d - 800)/80.0::double as slack_left from near
       where d <= 2000 and d <= least(2000.0::double, 800 + 80*slack_min/2)),
direct as (select min(t1_min + t2_min) as t from r)
"""
_SUGGEST_COLS = "s.spot_id, s.source, s.name, s.kinds, b.group_code, b.station_name, round(b.d) as dist_m, b.t1_min::double as t1_min, b.t2_min::double as t2_min, round(b.slack_left) as slack_min, (b.t1_min + b.t2_min - (select t from direct))::double as detour_min, round(sim, 6) as sim"
_BEST = "(select * from (select *, row_number() over (partition by spot_id order by t1_min + t2_min, d, group_code) as rn from {src}) where rn = 1)"


@query("suggest_reach_first", _REACHABLE + _NEAR + f"select {_SUGGEST_COLS} from {_BEST.format(src='ok')} b join spot s using (spot_id) join sims using (spot_id)")
def _(spark, sf):
    out = suggest.suggest_reach_first(
        D.rail_network(spark, sf), D.places(spark, sf, True), START, END, AVAILABLE, STAY, D.interest(spark, sf)
    )
    return out.withColumn("sim", F.round("sim", 6))


@query("suggest_interest_first", _REACHABLE + _NEAR + f", top as (select spot_id from sims order by round(sim, 12) desc, spot_id limit 200) select {_SUGGEST_COLS} from {_BEST.format(src='(select * from ok where spot_id in (select spot_id from top))')} b join spot s using (spot_id) join sims using (spot_id)")
def _(spark, sf):
    out = suggest.suggest_interest_first(
        D.rail_network(spark, sf), D.places(spark, sf, True), START, END, AVAILABLE, STAY, D.interest(spark, sf), 200
    )
    return out.withColumn("sim", F.round("sim", 6))


@query("suggestion_rankings", _REACHABLE + _NEAR + f""",
cand as materialized (select {_SUGGEST_COLS}, sim as s0 from {_BEST.format(src='ok')} b join spot s using (spot_id) join sims using (spot_id)),
a as (select 'A' as method, spot_id, row_number() over (order by round(s0, 12) desc, spot_id) as rank from cand),
b as (select 'B' as method, spot_id, row_number() over (order by detour_min, round(s0, 12) desc, spot_id) as rank from (select * from cand order by round(s0, 12) desc, spot_id limit 30)),
c as (select 'C' as method, spot_id, row_number() over (order by round(s0 - 0.05::double*detour_min/60.0::double, 12) desc, spot_id) as rank from cand)
select method, spot_id, rank::int as rank from (select * from a union all select * from b union all select * from c) where rank <= 10""")
def _(spark, sf):
    cand = D.cut_lineage(suggest.suggest_reach_first(
        D.rail_network(spark, sf), D.places(spark, sf, True), START, END, AVAILABLE, STAY, D.interest(spark, sf)
    ))
    out = None
    for m in "ABC":
        rows = suggest.top_ranked(cand, m).select(F.lit(m).alias("method"), "spot_id", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("order_of_filters", _REACHABLE + _NEAR + f""",
cand as materialized (select s.spot_id, sim from {_BEST.format(src='ok')} b join spot s using (spot_id) join sims using (spot_id)),
ten as (select spot_id from cand order by round(sim, 12) desc, spot_id limit 10),
pos as (select spot_id, row_number() over (order by round(sim, 12) desc, spot_id) as p from sims)
select k::int as k, (select count(*) from pos join cand using (spot_id) where p <= k) as kept, (select count(*) from pos join ten using (spot_id) where p <= k) as hits
from unnest([50, 200, 1000]) u(k)""")
def _(spark, sf):
    pl = D.cut_lineage(suggest.interest_similarity(D.places(spark, sf, True), D.interest(spark, sf)))
    cand = D.cut_lineage(suggest.suggest_from(reach.reachable(D.rail_network(spark, sf), START, END, AVAILABLE, STAY), pl))
    return suggest.order_of_filters(cand, pl, [50, 200, 1000])


def _walk_sql(max_min: float) -> str:
    cap = int(max_min * 1000)
    seeds = f"select group_code as o, node as n, {S.milli('m/80.0::double')} as c from gsnap where {S.milli('m/80.0::double')} <= {cap}"
    return f"""
with recursive {S.WALK_ACCESS}, {S.search(seeds, cap, 'wd', 'warc')},
walk as materialized (
  select o as group_code, spot_id, min(c + {S.milli('m/80.0::double')})/1000.0::double as walk_min
  from wd join ssnap on ssnap.node = wd.n group by 1, 2 having min(c + {S.milli('m/80.0::double')}) <= {cap})
"""


@query("station_place_walks", _walk_sql(WALK_MIN) + "select group_code, spot_id, walk_min from walk")
def _(spark, sf):
    return D.walk_table(spark, sf, WALK_MIN)


@query("walk_line_ratio", _walk_sql(WALK_MIN) + f""",
lines as materialized (select walk_min*80.0::double/{S.hav('s.lon', 's.lat', 'g.lon', 'g.lat')} as ratio from walk join spot s using (spot_id) join grp g using (group_code) where {S.hav('s.lon', 's.lat', 'g.lon', 'g.lat')} >= 300),
sorted as (select ratio, row_number() over (order by ratio) - 1 as i, count(*) over () as n from lines)
select p as share, round(ratio, 6) as value from sorted, unnest([0.5::double, 0.75::double, 0.9::double, 0.99::double]) u(p) where i = least(n - 1, floor(p*n))""")
def _(spark, sf):
    pairs = suggest.walk_line_ratio(D.walk_table(spark, sf, WALK_MIN), D.rail_network(spark, sf).stations, D.places(spark, sf))
    return suggest.ratio_report(pairs).withColumn("value", F.round("value", 6))


@query("near_but_far", _walk_sql(WALK_MIN) + f""",
lines as (select walk_min, {S.hav('s.lon', 's.lat', 'g.lon', 'g.lat')} as m from walk join spot s using (spot_id) join grp g using (group_code))
select count(*) filter (m <= 400) as close, count(*) filter (m <= 400 and walk_min > 8) as far, round(count(*) filter (m <= 400 and walk_min > 8)/count(*) filter (m <= 400), 9) as far_share from lines""")
def _(spark, sf):
    pairs = suggest.walk_line_ratio(D.walk_table(spark, sf, WALK_MIN), D.rail_network(spark, sf).stations, D.places(spark, sf))
    return suggest.near_but_far(pairs, 400, 8).withColumn("far_share", F.round("far_share", 9))


_WALK_SUGGEST = _REACHABLE.replace(S.RAIL, S.WALK_ACCESS) + "," + _walk_sql(suggest.MAX_WALK_MIN).split(S.WALK_ACCESS, 1)[1].lstrip(", ") + f""", {S.INTEREST},
direct as (select min(t1_min + t2_min) as t from reachable_all),
wok as (select g.*, spot_id, walk_min, slack_min - 2*greatest(0.0::double, walk_min - 10) as slack_left from reachable_all g join walk using (group_code)
        where walk_min <= least(25.0::double, 10 + slack_min/2)),
wbest as (select * from (select *, row_number() over (partition by spot_id order by round(t1_min + t2_min + 2*walk_min, 6), walk_min, group_code) as rn from wok) where rn = 1)
select s.spot_id, s.source, s.name, s.kinds, b.group_code, b.station_name, round({S.hav('s.lon', 's.lat', 'b.lon', 'b.lat')}) as dist_m,
  b.t1_min::double as t1_min, b.t2_min::double as t2_min, round(b.slack_left) as slack_min,
  round(round(b.t1_min + b.t2_min - (select t from direct) + 2*b.walk_min, 6)) as detour_min, round(sim, 6) as sim, round(b.walk_min, 1) as walk_min
from wbest b join spot s using (spot_id) join sims using (spot_id)"""


@query("suggest_walk", _WALK_SUGGEST)
def _(spark, sf):
    walks = D.cut_lineage(D.walk_table(spark, sf, suggest.MAX_WALK_MIN))
    out = suggest.suggest_walk(
        D.rail_network(spark, sf), walks, D.places(spark, sf, True), START, END, AVAILABLE, STAY, D.interest(spark, sf)
    )
    return out.withColumn("sim", F.round("sim", 6))


@query("stations_near_places", f"with {S.RAIL}, {S.SPOTS}, grp as (select group_code, {S.POINT} from st group by 1) select spot_id, count(*) as groups, round(min(d), 3) as nearest_m from (select s.spot_id, {_SPOT_NEAR} as d from spot s join grp g on s.lat between g.lat - 0.01 and g.lat + 0.01 and s.lon between g.lon - 0.0125 and g.lon + 0.0125) where d <= 800 group by 1")
def _(spark, sf):
    g = network.group_centroids(D.rail_network(spark, sf).stations)
    pairs = within_distance(D.places(spark, sf).select("spot_id", "lon", "lat"), g, 800.0, "spot_id")
    return pairs.groupBy("spot_id").agg(F.count(F.lit(1)).alias("groups"), F.round(F.min("dist_m"), 3).alias("nearest_m"))


@query("edge_length_percentiles", f"with {S.RAIL}, s as (select service, m, row_number() over (partition by service order by m) - 1 as i, count(*) over (partition by service) as n from edge join line using (suppkey)) select service as service_type, p as share, round(m, 3) as value from s, unnest([0.5::double, 0.9::double]) u(p) where i = greatest(1, ceil(round(p*n, 9))) - 1")
def _(spark, sf):
    sections = D.rail_features(spark, sf)[1]
    rows = network.build_ride_edges(sections).join(network.build_lines(sections), "line_id")
    return percentiles(rows, ["service_type"], "length_m", [0.5, 0.9], "nearest").withColumn("value", F.round("value", 3))


@query("line_midpoints", f"with {S.RAIL} select operator, line_name, round(avg(lon + 0.001::double), 6) as lon, round(avg(lat), 6) as lat from st group by 1, 2")
def _(spark, sf):
    mid = D.rail_features(spark, sf)[0].withColumn("p", line_interpolate(F.col("line"), 0.5))
    return mid.groupBy("operator", "line_name").agg(F.round(F.avg("p.lon"), 6).alias("lon"), F.round(F.avg("p.lat"), 6).alias("lat"))


# ------------------------------------------------------------------ supplied travel times and itineraries

_OD = """with t as (select user_id, event_type, event_id % 2 as half, min(value) as m from events group by 1, 2, 3),
p as (select * from (select user_id, event_type, m as x from t where half = 0) full join (select user_id, event_type, m as y from t where half = 1) using (user_id, event_type)),
d as (select 'there' as direction, x, y from p union all select 'back', y, x from p)"""


@query("od_compare", _OD + """ select direction, count(y - x) as common, count(*) filter (abs(y - x) <= 5) as within, count(*) filter (y - x < -5) as faster, count(*) filter (y - x > 5) as slower,
  count(*) filter (x is not null and y is null) as only_a, count(*) filter (y is not null and x is null) as only_b, round(avg(y - x), 6) as mean_diff from d group by 1""")
def _(spark, sf):
    # Two tables of least times between a user and an event type, compared in both directions.
    least = D.cut_lineage(D.table(spark, sf, "events").groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("half")).agg(F.min("value").alias("minutes")))
    a, b = (least.where(F.col("half") == h).drop("half") for h in (0, 1))
    keys = ["user_id", "event_type"]
    there = suggest.od_compare(a, b, keys, "minutes").withColumn("direction", F.lit("there"))
    back = suggest.od_compare(b, a, keys, "minutes").withColumn("direction", F.lit("back"))
    return there.unionByName(back).withColumn("mean_diff", F.round("mean_diff", 6))


@query("averaged_times", """with s as (select l_partkey as place, l_quantity as minutes, row_number() over (partition by l_partkey order by l_quantity) - 1 as i, count(*) over (partition by l_partkey) as n
  from lineitem where l_returnflag <> 'A')
select place, round(avg(minutes), 6) as mean, max(n) as n, max(minutes) filter (n = 15 and i = round_even(0.5*(n - 1), 0)) as p50, max(minutes) filter (n = 15 and i = round_even(0.8*(n - 1), 0)) as p80 from s group by 1""")
def _(spark, sf):
    # Departures to a part; those returned as 'A' did not arrive. Quantiles stand only where all 15 departures did.
    rows = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("place"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("minutes"))
    return suggest.averaged_times(rows, ["place"], 15).withColumn("mean", F.round("mean", 6))


_LEGS = """with leg as (select l_orderkey as trip, l_linenumber as leg, case when l_returnflag = 'N' then 'WALK' else 'RIDE' end as mode, l_linenumber*60.0::double as s, l_linenumber*60.0::double + l_quantity as e from lineitem),
one as (select trip, leg, max(mode) as mode, min(s) as s, min(e) as e from leg group by 1, 2),
k as (select *, min(leg) over (partition by trip) as f, max(leg) over (partition by trip) as l from one),
p as (select trip, max(e) - 30 as total, min(s) - 30 as first_wait, sum(case when mode = 'WALK' and leg = f then e - s else 0 end) as access, sum(case when mode = 'WALK' and leg = l and leg <> f then e - s else 0 end) as egress,
  sum(case when mode = 'WALK' and leg <> f and leg <> l then e - s else 0 end) as transfer, sum(case when mode <> 'WALK' then e - s else 0 end) as ride from k group by 1)"""


@query("itinerary_parts", _LEGS + " select trip, total, first_wait, access, egress, transfer, ride, total - first_wait - access - egress - transfer - ride as wait from p")
def _(spark, sf):
    # Orders as trips of one to seven legs: walks only, rides only and both.
    line = D.table(spark, sf, "lineitem")
    mode = F.when(F.col("l_returnflag") == "N", "WALK").otherwise("RIDE")
    start = F.col("l_linenumber") * 60.0
    legs = line.groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("leg")).agg(
        F.max(mode).alias("mode"), F.min(start).alias("start"), F.min(start + F.col("l_quantity")).alias("end"))
    return suggest.itinerary_parts(legs.withColumn("depart", F.lit(30.0)), ["trip"])


@query("door_candidates", """with c as (select p_partkey as spot_id, (p_size + p_partkey % 50 - p_size / 2.0)::double as detour, p_retailprice / 3000 as sim from part where p_size + p_partkey % 50 + 20 <= 60 + 20)
select spot_id, detour, round(sim - {w} * detour / 60, 9) as score, row_number() over (order by round(sim - {w} * detour / 60, 12) desc, spot_id) as rank from c""".replace("{w}", repr(suggest.DETOUR_WEIGHT)))
def _(spark, sf):
    part = D.table(spark, sf, "part")
    times = part.select(F.col("p_partkey").alias("spot_id"), F.col("p_size").cast("double").alias("t1"), (F.col("p_partkey") % 50).cast("double").alias("t2"),
                        (F.col("p_size") / 2.0).alias("direct"), (F.col("p_retailprice") / 3000).alias("sim"))
    return suggest.door_candidates(times, 60.0, 20.0).select("spot_id", "detour", F.round("score", 9).alias("score"), "rank")


@query("collapse_repeats", "select user_id, seq, station_name from (select user_id, event_id as seq, event_type as station_name, lag(event_type) over (partition by user_id order by event_id) as p from events) where p is null or p <> station_name")
def _(spark, sf):
    # A user's events as the stops of one route.
    routes = D.table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("station_name"))
    return reach.collapse_repeats(routes, ["user_id"])
