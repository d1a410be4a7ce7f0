"""Classification rules stated as column expressions.

The code lists in this module are fixed values: results depend on them literally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default speed in km/h of each service type.
SPEED_KMH = {
    "shinkansen": 150, "conventional": 40, "subway": 30, "monorail": 27,
    "agt": 25, "tram": 13, "cable": 5, "other": 20,
}

# Minutes between departures and timetable route type of each service type.
HEADWAY_MIN = {
    "shinkansen": 10, "conventional": 10, "subway": 5, "monorail": 8,
    "agt": 8, "tram": 10, "cable": 20, "other": 15,
}
ROUTE_TYPE = {
    "shinkansen": 2, "conventional": 2, "subway": 1, "monorail": 12,
    "agt": 12, "tram": 0, "cable": 7, "other": 2,
}

# Operators whose heavy or light rail counts as a subway, and the city whose guided rail does.
SUBWAY_OPERATORS = ("東京地下鉄", "大阪市高速電気軌道", "北大阪急行電鉄")
SUBWAY_CITY = "札幌市"

# Place groups by words in the place's kinds, tried in this order.
PLACE_GROUPS = (
    ("湖・池・沼", ("湖", "池", "沼", "貯水池", "ダム湖")),
    ("公園・庭園", ("公園", "庭園", "緑地", "植物園")),
    ("神社", ("神社",)),
    ("寺", ("寺", "仏教")),
    ("城・城跡", ("城",)),
    ("博物館・美術館", ("博物館", "美術館", "記念館", "資料館", "ギャラリー")),
    ("動物園・水族館", ("動物園", "水族館")),
    ("山・滝・自然", ("山", "滝", "峠", "渓谷", "島", "浜", "海岸", "岬")),
)
OTHER_GROUP = "その他"

# Area kinds (prefixes) that may stand for a place of each group.
COMPATIBLE_KINDS = {
    "湖・池・沼": ("natural=water", "water=", "natural=wetland"),
    "公園・庭園": ("leisure=", "landuse=recreation_ground", "landuse=village_green", "tourism=attraction"),
    "神社": ("amenity=place_of_worship", "landuse=religious"),
    "寺": ("amenity=place_of_worship", "landuse=religious"),
    "城・城跡": ("historic=", "leisure=park"),
    "博物館・美術館": ("tourism=museum", "tourism=gallery", "tourism=zoo", "tourism=aquarium", "tourism=attraction"),
    "動物園・水族館": ("tourism=zoo", "tourism=aquarium", "leisure=zoo"),
}

# Area tags with their accepted values; None accepts any value.
AREA_TAGS = {
    "leisure": ("park", "garden", "nature_reserve", "common", "zoo", "dog_park", "marina"),
    "natural": ("water", "wetland", "beach", "wood", "scrub", "heath", "peak", "valley", "bay"),
    "water": None,
    "amenity": ("place_of_worship", "grave_yard"),
    "landuse": ("religious", "cemetery", "recreation_ground", "village_green"),
    "historic": None,
    "tourism": (
        "museum", "zoo", "theme_park", "attraction", "aquarium", "gallery", "viewpoint", "picnic_site",
    ),
    "boundary": ("protected_area", "national_park"),
}
NOT_A_PLACE_BOUNDARY = ("administrative", "political", "census", "postal_code")
MAX_AREA_M2 = 30e6

# Tagged points kept, by tag.
POINT_TAGS = {
    "barrier": ("gate", "entrance", "turnstile", "kissing_gate", "swing_gate", "lift_gate", "bollard", "stile"),
    "railway": ("subway_entrance", "train_station_entrance", "station", "halt", "stop"),
    "public_transport": ("station", "stop_position"),
    "highway": ("elevator",),
}
WALKABLE_HIGHWAYS = (
    "footway", "path", "pedestrian", "steps", "residential", "service", "unclassified", "tertiary",
    "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "trunk", "trunk_link",
    "living_street", "track", "cycleway", "corridor", "bridleway", "road",
)
ENTRANCE_BARRIERS = ("gate", "entrance", "turnstile", "kissing_gate", "swing_gate", "stile")
EXIT_RAILWAY = ("subway_entrance", "train_station_entrance")
STATION_RAILWAY = ("station", "halt")
NO_ACCESS = ("private", "no")


def service_type(operator: Column, operator_type: Column, rail_class: Column) -> Column:
    """Service type of a line from its operator, operator type and rail class."""
    return (
        F.when(operator_type == "1", "shinkansen")
        .when(operator.isin(*SUBWAY_OPERATORS) & rail_class.isin("12", "21"), "subway")
        .when((operator_type == "3") & (rail_class == "12"), "subway")
        .when((operator == SUBWAY_CITY) & (rail_class == "16"), "subway")
        .when(rail_class == "21", "tram")
        .when(rail_class == "13", "cable")
        .when(rail_class.isin("14", "15", "22", "23"), "monorail")
        .when(rail_class.isin("16", "24", "25"), "agt")
        .when(rail_class.isin("11", "12"), "conventional")
        .otherwise("other")
    )


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    """Value of a small fixed table for a key."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(default))


def default_speed(service: Column) -> Column:
    return lookup({k: float(v) for k, v in SPEED_KMH.items()}, service, 20.0)


def headway_minutes(service: Column) -> Column:
    return lookup(HEADWAY_MIN, service, 15)


def route_type(service: Column) -> Column:
    return lookup(ROUTE_TYPE, service, 2)


def walkable(toll: Column, road_class: Column, state: Column) -> Column:
    """Not tolled, not an expressway, not under construction; a missing attribute is no obstacle."""
    return ~toll.eqNullSafe(F.lit("2")) & ~road_class.eqNullSafe(F.lit("4")) & ~state.eqNullSafe(F.lit("5"))


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (lon min, lat min, lon max, lat max), edges included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_group(kinds: Column, groups=PLACE_GROUPS, other: str = OTHER_GROUP) -> Column:
    """First group one of whose words occurs in the text."""
    text = F.coalesce(kinds, F.lit(""))
    out = None
    for name, words in groups:
        hit = any_of([text.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def kind_allowed(group: Column, kind: Column) -> Column:
    """Whether an area kind suits a place group; a group without a rule accepts all."""
    ruled = [
        (group == g) & any_of([kind.startswith(p) for p in prefixes]) for g, prefixes in COMPATIBLE_KINDS.items()
    ]
    return ~group.isin(*COMPATIBLE_KINDS) | any_of(ruled)


def area_kind(tags: Column) -> Column:
    """``key=value`` of the first accepted area tag, NULL without one."""
    out = None
    for key, allowed in AREA_TAGS.items():
        v = tags[key]
        hit = v.isNotNull() if allowed is None else v.isin(*allowed)
        text = F.concat(F.lit(f"{key}="), v)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def is_tagged_point(tags: Column) -> Column:
    return tags["entrance"].isNotNull() | any_of(
        [F.coalesce(tags[k].isin(*values), F.lit(False)) for k, values in POINT_TAGS.items()]
    )


def is_walkable_way(tags: Column) -> Column:
    return (
        tags["highway"].isin(*WALKABLE_HIGHWAYS)
        & ~tags["motorroad"].eqNullSafe(F.lit("yes"))
        & ~tags["area"].eqNullSafe(F.lit("yes"))
    )


def is_entrance(entrance: Column, barrier: Column) -> Column:
    return (F.coalesce(entrance, F.lit("")) != "") | F.coalesce(barrier.isin(*ENTRANCE_BARRIERS), F.lit(False))


def may_enter(access: Column) -> Column:
    return ~F.coalesce(access.isin(*NO_ACCESS), F.lit(False))


def three_levels(grade: Column) -> Column:
    """Grades 0, 1 and 2-or-more."""
    return F.when(grade == 0, 0).when(grade >= 2, 2).otherwise(1)


def drop_replies(reply_to: Column, post_id: Column, seed: int, p: float) -> Column:
    """Reply links of a post, emptied with probability ``p`` by a hash of seed and id."""
    if p <= 0:
        return reply_to
    u = F.pmod(F.xxhash64(F.lit(seed), post_id), F.lit(1_000_000)) / 1_000_000.0
    return F.when(u < p, F.array().cast("array<string>")).otherwise(reply_to)
