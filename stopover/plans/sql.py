"""SQL statements of the derived views, for the checks of the registered queries."""

from __future__ import annotations

RAD = "0.017453292519943295::double"


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    s_lat = f"sin((({lat2})-({lat1}))*{RAD}/2)"
    s_lon = f"sin((({lon2})-({lon1}))*{RAD}/2)"
    a = f"{s_lat}*{s_lat} + cos(({lat1})*{RAD})*cos(({lat2})*{RAD})*{s_lon}*{s_lon}"
    return f"(12742000.0::double*asin(sqrt(least(1.0::double, {a}))))"


def lon(key: str, tile: int) -> str:
    return f"(139.5::double + (({key})//{tile} % 40)*0.25::double + ((({key})*7919) % 10007)/10007.0::double*0.25::double)"


def lat(key: str, tile: int) -> str:
    return f"(35.4::double + (({key})//{tile}//40)*0.25::double + ((({key})*104729) % 10007)/10007.0::double*0.25::double)"


def milli(minutes: str) -> str:
    return f"round(({minutes})*1000)::bigint"


LINES = """
line as (
  select *, case service when 'shinkansen' then 150 when 'conventional' then 40 when 'subway' then 30 when 'monorail' then 27
            when 'agt' then 25 when 'tram' then 13 when 'cable' then 5 else 20 end::double as speed
  from (select *, case when optype = '1' then 'shinkansen'
                       when optype = '3' and cls = '12' then 'subway'
                       when cls = '21' then 'tram' when cls = '13' then 'cable'
                       when cls in ('14','15','22','23') then 'monorail'
                       when cls in ('16','24','25') then 'agt'
                       when cls in ('11','12') then 'conventional' else 'other' end as service
        from (select s_suppkey as suppkey, 'OP' || s_nationkey as operator, 'LINE' || s_suppkey as line_name,
                     ['11','12','13','14','16','21','12','99'][(s_suppkey % 8 + 1)::int] as cls,
                     case when s_suppkey % 8 = 0 then '1' when s_suppkey % 8 = 6 then '3' else '4' end as optype
              from supplier)))
"""

_RIDE = "({m})/1000.0/speed*60.0"

RAIL = f"""
stops as (select distinct l_suppkey as suppkey, l_partkey as partkey from lineitem),
{LINES},
st as materialized (
  select suppkey, partkey, operator, line_name, service, speed, operator || ' ' || line_name as line,
         'N' || partkey as station_name, 'G' || partkey as group_code,
         {lon('partkey', 2000)} as lon, {lat('partkey', 2000)} as lat,
         (suppkey*10000000 + partkey)*2 as na, (suppkey*10000000 + partkey)*2 + 1 as nb
  from stops join line using (suppkey)),
nxt as (
  select *, lead(na) over w as n2, lead(lon) over w as lon2, lead(lat) over w as lat2
  from st window w as (partition by suppkey order by partkey)),
edge as materialized (
  select suppkey, na as s, nb as t, speed, {hav('lon', 'lat', 'lon + 0.002::double', 'lat')} as m from st
  union all
  select suppkey, nb, n2, speed, {hav('lon + 0.002::double', 'lat', 'lon2', 'lat2')} from nxt where n2 is not null)
"""

ARCS = f"""
arc0 as (
  select s, t, {milli(_RIDE.format(m='m'))} as c from edge
  union all
  select a.na, b.na, 10000 from st a join st b on a.group_code = b.group_code and a.suppkey < b.suppkey),
arc as materialized (select s, t, c from arc0 union all select t, s, c from arc0)
"""


def search(seeds: str, cap: int, name: str = "d", arc: str = "arc") -> str:
    """Bounded relaxation from ``seeds`` (o, n, c)."""
    return f"""
{name}(o, n, c) using key (o, n) as (
  select o, n, c from ({seeds})
  union all
  select x.o, x.n, x.c from (
    select {name}.o, e.t as n, min({name}.c + e.c) as c from {name} join {arc} e on e.s = {name}.n
    where {name}.c + e.c <= {cap} group by 1, 2) x
  left join recurring.{name} r on r.o = x.o and r.n = x.n where r.n is null or x.c < r.c)
"""


def group_seeds(origins: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{o}' as o, unnest([na, nb]) as n, 0::bigint as c from st where group_code = '{g}'" for o, g in origins.items()
    )


def platforms(origins: dict[str, str], cap: int) -> str:
    """RAIL, ARCS, the search and station costs per origin."""
    cols = ", ".join(f"min(c) filter (o = '{o}') as c_{o}" for o in origins)
    return f"""
with recursive {RAIL}, {ARCS}, {search(group_seeds(origins), cap)},
plat as materialized (
  select st.*, {', '.join('k.c_' + o for o in origins)}
  from st left join (
    select suppkey, partkey, {cols} from (select suppkey, partkey, unnest([na, nb]) as n from st) e join d using (n) group by 1, 2) k
  using (suppkey, partkey))
"""


POINT = "avg(lon + 0.001::double) as lon, avg(lat) as lat"

SPOTS = f"""
spot as materialized (
  select c_custkey as spot_id, case when c_mktsegment = 'BUILDING' then 'sample' else 'wikidata' end as source,
         c_name as name, c_mktsegment as kinds, {lon('c_custkey', 1500)} as lon, {lat('c_custkey', 1500)} as lat
  from customer)
"""

INTEREST = """
interest as (select list(m order by i) as q from (select i, round(avg(x::double), 6) as m from
   (select unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by i)),
sims as (select spot_id, list_cosine_similarity(e.embedding::double[], (select q from interest)) as sim
   from spot join embeddings e on e.vec_id = spot.spot_id % (select count(*) from embeddings))
"""

ROADS = """
road as materialized (
  select x.lon1, x.lat1, x.lon2, x.lat2 from (
    select unnest([{'lon1': 139.5::double + gx*0.0025::double, 'lat1': 35.4::double + gy*0.0025::double,
                    'lon2': 139.5::double + (gx+1)*0.0025::double, 'lat2': 35.4::double + gy*0.0025::double},
                   {'lon1': 139.5::double + gx*0.0025::double, 'lat1': 35.4::double + gy*0.0025::double,
                    'lon2': 139.5::double + gx*0.0025::double, 'lat2': 35.4::double + (gy+1)*0.0025::double}]) as x
    from (select (t % 40)*100 + c % 100 as gx, (t//40)*100 + c//100 as gy,
                 case when o_orderpriority = '1-URGENT' then '2' when o_orderstatus = 'F' then '1' end as toll,
                 case when o_orderstatus = 'O' then '1' end as road_class,
                 case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then '5' end as state
          from (select *, o_orderkey//15000 as t, o_orderkey % 10000 as c from orders))
    where toll is distinct from '2' and road_class is distinct from '4' and state is distinct from '5')),
wedge as materialized (
  select round(lon1/1e-7)::bigint as x1, round(lat1/1e-7)::bigint as y1, round(lon2/1e-7)::bigint as x2, round(lat2/1e-7)::bigint as y2,
         HAV as m from road),
wnode as materialized (
  select x, y, (x-1390000000)*10000000000 + y as id, min(lon) as lon, min(lat) as lat from (
    select x1 as x, y1 as y, lon1 as lon, lat1 as lat from (select *, round(lon1/1e-7)::bigint as x1, round(lat1/1e-7)::bigint as y1 from road)
    union all
    select round(lon2/1e-7)::bigint, round(lat2/1e-7)::bigint, lon2, lat2 from road) group by x, y)
""".replace("HAV", hav("lon1", "lat1", "lon2", "lat2"))

WALK_ARCS = f"""
warc as materialized (
  select s, t, min(c) as c from (
    select (x1-1390000000)*10000000000 + y1 as s, (x2-1390000000)*10000000000 + y2 as t, {milli('m/80.0::double')} as c from wedge
    union all
    select (x2-1390000000)*10000000000 + y2, (x1-1390000000)*10000000000 + y1, {milli('m/80.0::double')} from wedge) group by 1, 2)
"""


def snapped(name: str, source: str, key: str) -> str:
    """Nearest walking node of each row of ``source`` (key, lon, lat) within 300 m."""
    d = hav("p.lon", "p.lat", "w.lon", "w.lat")
    return f"""
{name} as materialized (
  select {key}, node, m from (
    select p.{key}, w.id as node, {d} as m, row_number() over (partition by p.{key} order by {d}, w.id) as rn
    from {source} p join wnode w on w.lon between p.lon - 0.004 and p.lon + 0.004 and w.lat between p.lat - 0.003 and p.lat + 0.003)
  where rn = 1 and m <= 300)
"""


WALK_ACCESS = f"""
{RAIL}, {SPOTS}, {ROADS}, {WALK_ARCS},
grp as materialized (select group_code, {POINT} from st group by 1),
{snapped('gsnap', 'grp', 'group_code')}, {snapped('ssnap', 'spot', 'spot_id')}
"""

CONVERSATIONS = """
post as materialized (
  select conv_id as conv, turn::int as seq, 'P' || turn as post_id, role as author, text,
         case when turn = 0 or (conv_id*31 + turn*17) % 4 = 0 then null else 'P' || (turn - 1) end as parent,
         case when role = 'system' then []::varchar[] when length(text) % 5 = 0 then ['T' || (turn//3), 'TX'] else ['T' || (turn//3)] end as topics,
         case when length(text) % 7 = 0 then 'OFF' else 'c' || ((turn + length(text) % 2)//3) end as assign,
         length(text) % 3 = 0 as deferred
  from conversations)
"""
