"""Building the rail and walking networks from line features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.functions.geo import (
    line_end,
    line_interpolate,
    line_length_m,
    line_start,
    milli,
    node_key,
    ride_minutes,
    snap_x,
    snap_y,
    walk_minutes,
)
from stopover.functions.rules import default_speed, service_type, walkable
from stopover.operators.spatial import nearest_within
from stopover.session import cut_lineage, skew_join

if TYPE_CHECKING:
    from stopover.operators.graph import Prepared

# Fixed values.
TRANSFER_MIN = 10.0
SNAP_CAP_M = 300.0
# A search may build so many stations of its own; beyond that it goes over the whole network.
OWN_STATIONS = 1_000_000
# Milli-minutes to look for a way in at first; doubled up to the last before the whole network is taken.
FIRST_WAY_CAP, LAST_WAY_CAP = 15_000, 240_000
# Up to so many platform shapes unlike their sections go to every task (about 20 bytes each); more are met by a merge join.
BROADCAST_SHAPES = 500_000


@dataclass
class Network:
    """Tables of a built rail network; ``arcs`` are directed (source, target, cost) in milli-minutes."""

    lines: DataFrame
    stations: DataFrame
    arcs: DataFrame

    @cached_property
    def adj(self) -> Prepared:
        """The adjacency all searches share, prepared at the first one: queries on lines and stations alone never build it."""
        from stopover.operators.graph import prepare

        return prepare(self.arcs)

    def named(self, *stations: str) -> DataFrame:
        """Stations with one of some names or group codes."""
        return self.stations.where(F.col("station_name").isin(*stations) | F.col("group_code").isin(*stations))

    def seeds(self, groups: dict[str, DataFrame]) -> DataFrame:
        """Starting rows (origin, node, cost) at the platforms of some groups."""
        from stopover.operators.graph import group_nodes

        out = None
        for origin, g in groups.items():
            rows = group_nodes(self.stations, g).select(F.lit(origin).alias("origin"), "node", F.lit(0).cast("long").alias("cost"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def search(self, groups: dict[str, DataFrame], cap: int) -> tuple[Network, DataFrame]:
        """(origin, node, cost) from the platforms of some groups, and a network that holds the stations there and all that were reached."""
        from stopover.operators.graph import shortest_costs

        return self, shortest_costs(self.arcs, self.seeds(groups), cap, adj=self.adj)

    def towards(self, start: DataFrame, goal: DataFrame, cap: int | None = None) -> Network:
        """A network that holds every node and arc of the shortest ways from some groups to others; ``cap`` is the cost to look within first."""
        return self


class LazyNetwork(Network):
    """A network over tables of features, built as far as it is asked for.

    The tables of the whole network are built at their first use. A bounded search builds only the lines it can ride on:
    nodes belong to one line, and a transfer takes a fixed time, so a line counts only if the search gets to one of its
    groups with that time to spare. A round finds the lines of all groups reached like that, builds them and goes on
    from the costs so far, until no group is new. Platforms and lines are looked up in the features by joins, so every round
    reads their keys, but shuffles only what it takes. What a search built serves the next ones.

    ``whole`` gives (station lines, sections), ``of_lines`` those of some lines (line_id), ``look`` the station lines that
    a function of their table keeps by name, code or group. Searches that take more than OWN_STATIONS stations and
    features in which a station code occurs twice are left to the whole network.
    """

    def __init__(self, whole: Callable, of_lines: Callable, look: Callable):
        self._features, self._of_lines, self._look = whole, of_lines, look
        self._parts: list[Network] = []
        self._told: DataFrame | None = None  # groups all of whose lines are built
        self._held, self._checked, self._rides = 0, 0, 0
        self._by_whole = False

    @cached_property
    def whole(self) -> Network:
        return _whole_network(*self._features())

    @cached_property
    def lines(self) -> DataFrame:
        return self.whole.lines

    @cached_property
    def stations(self) -> DataFrame:
        return self.whole.stations

    @cached_property
    def arcs(self) -> DataFrame:
        return self.whole.arcs

    def _once(self, codes: DataFrame) -> bool:
        """Whether the codes (c) of some platforms are different and no other platform has one of them."""
        rows, different = codes.agg(F.count(F.lit(1)), F.countDistinct("c")).first()
        told = F.broadcast(codes.select(F.col("c").alias("_c")).distinct())
        once = rows == different and rows == self._look(lambda p: p.join(told, F.xxhash64("station_code") == F.col("_c"), "left_semi")).count()
        self._by_whole |= not once
        return once

    def named(self, *stations: str) -> DataFrame:
        if not self._by_whole:
            found = self._look(lambda p: p.where(F.col("station_name").isin(*stations) | F.col("group_code").isin(*stations)))
            rows = found.select("station_code", "station_name", "group_code", line_interpolate(F.col("line"), 0.5).alias("p"))
            rows = cut_lineage(rows.select("station_code", "station_name", "group_code", "p.lon", "p.lat"))
            if self._once(rows.select(F.xxhash64("station_code").alias("c"))):
                return rows
        return self.whole.named(*stations)

    def _known(self, table: str) -> DataFrame:
        out = getattr(self._parts[0], table)
        for p in self._parts[1:]:
            out = out.unionByName(getattr(p, table))
        return out

    def _build_lines_of(self, groups: DataFrame) -> bool:
        """Builds the lines of some groups that are not built yet; False if there are too many."""
        found = self._look(lambda p: p.join(F.broadcast(groups), "group_code", "left_semi"))
        lines = found.select(line_key(F.col("operator"), F.col("line_name")).alias("line_id")).distinct()
        if self._parts:
            lines = lines.join(self._known("lines"), "line_id", "left_anti")
        lines = cut_lineage(lines)
        if not self._parts or not lines.isEmpty():
            platforms, sections = self._of_lines(lines)
            sections = cut_lineage(sections)
            own = cut_lineage(build_lines(sections))
            stations = cut_lineage(build_stations(platforms, sections))
            rides = cut_lineage(both_ways(edge_minutes(build_ride_edges(sections), own), milli(F.col("minutes"))))
            self._parts.append(Network(own, stations, rides))
            self._held += stations.count()
            self._rides += rides.count()
        self._told = groups if self._told is None else cut_lineage(self._told.unionByName(groups))
        return self._held <= OWN_STATIONS

    def _around(self, groups: dict[str, DataFrame], cap: int) -> tuple[Network, DataFrame] | None:
        from stopover.operators.graph import small_costs

        if self._by_whole:
            return None
        change = int(round(TRANSFER_MIN * 1000))
        new = None
        for g in groups.values():
            new = g.select("group_code") if new is None else new.unionByName(g.select("group_code"))
        new = new.where("group_code is not null").distinct()
        new = cut_lineage(new if self._told is None else new.join(self._told, "group_code", "left_anti"))
        costs = None
        while True:
            if self._told is None or not new.isEmpty():
                if not self._build_lines_of(new):
                    self._by_whole = True
                    return None
            elif costs is not None:
                break
            stations = self._known("stations")
            changes = cut_lineage(transfer_arcs(stations.join(F.broadcast(self._told), "group_code", "left_semi")))
            part = Network(self._known("lines"), stations, self._known("arcs").unionByName(changes))
            costs = cut_lineage(small_costs(part.arcs, part.seeds(groups) if costs is None else costs, cap, self._rides + changes.count()))
            left = costs.where(F.col("cost") <= cap - change).select(F.col("node").alias("node_a")).distinct()
            new = stations.join(left, "node_a", "left_semi").select("group_code").where("group_code is not null").distinct()
            new = cut_lineage(new.join(self._told, "group_code", "left_anti"))
        if self._checked < self._held:
            if not self._once(part.stations.select(F.xxhash64("station_code").alias("c"))):
                return None
            self._checked = self._held
        return part, costs

    def search(self, groups: dict[str, DataFrame], cap: int) -> tuple[Network, DataFrame]:
        return self._around(groups, cap) or self.whole.search(groups, cap)

    def towards(self, start: DataFrame, goal: DataFrame, cap: int | None = None) -> Network:
        from stopover.operators.graph import group_nodes

        cap = max(cap or 0, FIRST_WAY_CAP)
        while cap <= LAST_WAY_CAP and (found := self._around({"from": start, "to": goal}, cap)):
            part, costs = found
            if not costs.where("origin = 'from'").join(group_nodes(part.stations, goal), "node", "left_semi").isEmpty():
                return part
            cap *= 2
        return self.whole


# ------------------------------------------------------------------ rail


def line_key(operator: Column, line_name: Column) -> Column:
    return node_key(F.lit("line"), operator, line_name)


def build_lines(sections: DataFrame) -> DataFrame:
    """One row per operator and line name, taken from its lowest rail class, with service type and speed."""
    first = sections.groupBy("operator", "line_name").agg(
        F.min(F.struct("rail_class", "operator_type")).alias("f")
    )
    return (
        first.select(
            line_key(F.col("operator"), F.col("line_name")).alias("line_id"), "operator", "line_name",
            "f.rail_class", "f.operator_type",
        )
        .withColumn("service_type", service_type(F.col("operator"), F.col("operator_type"), F.col("rail_class")))
        .withColumn("speed_kmh", default_speed(F.col("service_type")))
    )


def endpoint_node(line_id: Column, point: Column) -> Column:
    """Node key of an endpoint: nodes belong to one line, so lines cannot leak into each other."""
    return node_key(line_id, snap_x(point["lon"]), snap_y(point["lat"]))


def snapped(line: Column) -> Column:
    """Grid keys of a line's points; those of a line of two points are compiled."""
    def at(p: Column) -> Column:
        return F.struct(snap_x(p["lon"]).alias("x"), snap_y(p["lat"]).alias("y"))

    two = F.array(at(F.get(line, F.lit(0))), at(F.get(line, F.lit(1))))
    return F.when(F.size(line) == 2, two).otherwise(F.transform(line, at))


def shape_key(line: Column) -> Column:
    """Key of a line's shape, the same for both directions of drawing."""
    pts = snapped(line)
    return F.xxhash64(F.least(pts, F.reverse(pts)))


def section_ends(sections: DataFrame) -> DataFrame:
    """Sections with line key, edge key and the node keys of both ends.

    Node keys are hashes of the natural key, so no join against a node table is needed.
    """
    line_id = line_key(F.col("operator"), F.col("line_name"))
    return sections.select(
        line_id.alias("line_id"),
        F.xxhash64(line_id, shape_key(F.col("line"))).alias("edge_id"),
        endpoint_node(line_id, line_start(F.col("line"))).alias("source"),
        endpoint_node(line_id, line_end(F.col("line"))).alias("target"),
        "line",
    )


def build_nodes(sections: DataFrame) -> DataFrame:
    """Distinct snapped endpoints per line: (node_id, line_id, lon, lat)."""
    ends = section_ends(sections)
    a = ends.select("line_id", F.col("source").alias("node_id"), line_start(F.col("line")).alias("p"))
    b = ends.select("line_id", F.col("target").alias("node_id"), line_end(F.col("line")).alias("p"))
    return (
        a.unionByName(b)
        .groupBy("node_id", "line_id")
        .agg(F.min("p").alias("p"))
        .select("node_id", "line_id", "p.lon", "p.lat")
    )


def build_ride_edges(sections: DataFrame) -> DataFrame:
    """One undirected edge per section with its length in metres."""
    return section_ends(sections).select(
        "edge_id", "line_id", "source", "target", line_length_m(F.col("line")).alias("length_m")
    )


def drawn_forward(line: Column) -> Column:
    """Whether a line is drawn in the direction in which its shape's key is taken."""
    pts = snapped(line)
    return F.coalesce(pts <= F.reverse(pts), F.lit(True))


def unlike_sections(platforms: DataFrame, ends: DataFrame) -> DataFrame:
    """(edge_id, drawn): platform shapes that no section has (``drawn`` is null) or that a section is drawn against.

    ``platforms`` and ``ends``: (edge_id, forward). Only keys and directions move; platforms drawn like their section
    need no row. Of sections drawn both ways, one drawn backward decides.
    """
    no = F.lit(None).cast("boolean")
    both = platforms.select("edge_id", F.col("forward").alias("p"), no.alias("s")).unionByName(
        ends.select("edge_id", no.alias("p"), F.col("forward").alias("s"))
    )
    per = both.groupBy("edge_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.min("s").alias("drawn"))
    return per.where(
        F.col("lo").isNotNull() & (F.col("drawn").isNull() | (F.col("lo") != F.col("drawn")) | (F.col("hi") != F.col("drawn")))
    ).select("edge_id", "drawn")


def build_stations(station_lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Stations on the edge with their platform's shape, positioned at its middle.

    A platform without a section of the same shape keeps NULL nodes. The end nodes follow from the platform's own shape;
    from the sections it only takes whether there is one and how it is drawn. So the stations stay where they lie, unless
    many platforms differ from the sections or a code has several platforms: only then are they materialised, else each
    use computes them from the platforms again, which costs no disk.
    """
    def shape(rows: DataFrame) -> DataFrame:
        key = line_key(F.col("operator"), F.col("line_name"))
        return rows.select(F.xxhash64(key, shape_key(F.col("line"))).alias("edge_id"), drawn_forward(F.col("line")).alias("forward"))

    unlike = cut_lineage(unlike_sections(shape(station_lines), shape(sections)))
    line_id = line_key(F.col("operator"), F.col("line_name"))
    rows = station_lines.select(
        "station_code", "station_name", "group_code", line_id.alias("line_id"),
        F.xxhash64(line_id, shape_key(F.col("line"))).alias("edge_id"), drawn_forward(F.col("line")).alias("forward"),
        # With try_element_at the code of the projection does not compile, and each row costs ten times as much.
        endpoint_node(line_id, F.get("line", F.lit(0))).alias("first"),
        endpoint_node(line_id, F.get("line", F.size("line") - 1)).alias("last"),
        line_interpolate(F.col("line"), 0.5).alias("p"),
    )
    few = unlike.count() <= BROADCAST_SHAPES
    told = unlike.withColumnRenamed("edge_id", "_e")
    found = rows.join(F.broadcast(told) if few else told.hint("merge"), F.col("edge_id") == F.col("_e"), "left")
    placed = F.col("_e").isNull() | F.col("drawn").isNotNull()
    turned = F.col("_e").isNotNull() & (F.col("drawn") != F.col("forward"))
    matched = found.select(
        "station_code", "station_name", "group_code", "line_id", F.when(placed, F.col("edge_id")).alias("edge_id"),
        F.when(placed, F.when(turned, F.col("last")).otherwise(F.col("first"))).alias("node_a"),
        F.when(placed, F.when(turned, F.col("first")).otherwise(F.col("last"))).alias("node_b"),
        "p", F.col("edge_id").alias("_key"),
    )
    code = station_lines.select(F.xxhash64("station_code").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    if code.where("n > 1").isEmpty():
        placed_rows = matched.select(
            "station_code", "station_name", "group_code", "line_id", "edge_id", "node_a", "node_b", "p.lon", "p.lat"
        )
        return placed_rows if few else cut_lineage(placed_rows)
    first = matched.groupBy("station_code").agg(
        F.min_by(
            F.struct("station_name", "group_code", "line_id", "edge_id", "node_a", "node_b", "p"),
            F.struct(F.col("node_a").isNull(), "_key"),
        ).alias("s")
    )
    return cut_lineage(first.select(
        "station_code", "s.station_name", "s.group_code", "s.line_id", "s.edge_id", "s.node_a", "s.node_b",
        "s.p.lon", "s.p.lat",
    ))


def transfer_counts(stations: DataFrame) -> DataFrame:
    """Number of transfer pairs (different lines of one group) per group, without forming the pairs."""
    placed = stations.where(F.col("node_a").isNotNull())
    per_line = placed.groupBy("group_code", "line_id").agg(F.count(F.lit(1)).alias("n"))
    tot = per_line.groupBy("group_code").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    return tot.select("group_code", ((F.col("n") * F.col("n") - F.col("n2")) / 2).cast("long").alias("transfers"))


def build_transfers(stations: DataFrame) -> DataFrame:
    """Transfer edges as pairs of platforms (node_a to node_a), as an explicit table.

    Quadratic in the lines of a group; routing uses :func:`transfer_arcs` instead.
    """
    s = stations.where(F.col("node_a").isNotNull()).select("group_code", "line_id", "station_code", "node_a")
    b = s.toDF("group_code", "line_b", "code_b", "node_b")
    return skew_join(s, b, ["group_code"], ["station_code"]).where(
        (F.col("line_id") != F.col("line_b")) & (F.col("station_code") < F.col("code_b"))
    ).select(F.col("node_a").alias("source"), F.col("node_b").alias("target"), F.lit(TRANSFER_MIN).alias("minutes"))


def transfer_arcs(stations: DataFrame, minutes: float = TRANSFER_MIN) -> DataFrame:
    """Directed arcs that give every pair of different lines in a group a transfer, linear in the stations.

    A group whose stations all lie on different lines gets one hub: entering costs the
    transfer, leaving is free. A group where a line has several platforms gets two hubs per
    bit of the line key: a platform enters the hub of its own bit value and leaves from the
    hub of the other, so exactly the platforms of different lines are joined.
    """
    cost = int(round(minutes * 1000))
    n = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by group once: the counts and their join need no further shuffle.
    placed = stations.where(F.col("node_a").isNotNull()).select("group_code", "line_id", "node_a").repartition(n, "group_code")
    shape = placed.groupBy("group_code").agg(
        (F.count(F.lit(1)) == F.countDistinct("line_id")).alias("simple"), F.countDistinct("line_id").alias("lines")
    ).where(F.col("lines") > 1)
    rows = placed.join(shape, "group_code")
    hub = node_key(F.lit("hub"), F.col("group_code"))
    plain = rows.where("simple").select(
        F.explode(
            F.array(
                F.struct(F.col("node_a").alias("source"), hub.alias("target"), F.lit(cost).cast("long").alias("cost")),
                F.struct(hub.alias("source"), F.col("node_a").alias("target"), F.lit(0).cast("long").alias("cost")),
            )
        ).alias("a")
    ).select("a.*")
    bits = rows.where(~F.col("simple")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    value = F.bit_get(F.col("line_id"), F.col("bit")).cast("long")
    own = node_key(F.lit("hub"), F.col("group_code"), F.col("bit"), value)
    other = node_key(F.lit("hub"), F.col("group_code"), F.col("bit"), F.lit(1).cast("long") - value)
    mixed = bits.select(
        F.explode(
            F.array(
                F.struct(F.col("node_a").alias("source"), own.alias("target"), F.lit(cost).cast("long").alias("cost")),
                F.struct(other.alias("source"), F.col("node_a").alias("target"), F.lit(0).cast("long").alias("cost")),
            )
        ).alias("a")
    ).select("a.*")
    return plain.unionByName(mixed)


def edge_minutes(edges: DataFrame, lines: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Ride edges with speed and minutes; ``overrides`` (edge_id, speed_kmh) win over the line's speed."""
    rows = edges.join(lines.select("line_id", "speed_kmh"), "line_id")
    if overrides is not None:
        o = overrides.select("edge_id", F.col("speed_kmh").alias("_o"))
        rows = rows.join(o, "edge_id", "left").withColumn("speed_kmh", F.coalesce("_o", "speed_kmh")).drop("_o")
    return rows.withColumn("minutes", ride_minutes(F.col("length_m"), F.col("speed_kmh")))


def both_ways(edges: DataFrame, cost: Column) -> DataFrame:
    """Directed arcs of undirected edges."""
    arc = F.array(
        F.struct(F.col("source").alias("source"), F.col("target").alias("target"), cost.alias("cost")),
        F.struct(F.col("target").alias("source"), F.col("source").alias("target"), cost.alias("cost")),
    )
    return edges.select(F.explode(arc).alias("a")).select("a.*")


def of_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Features of some lines (line_id)."""
    key = line_key(F.col("operator"), F.col("line_name"))
    return rows.join(F.broadcast(lines.select(F.col("line_id").alias("_l"))), key == F.col("_l"), "left_semi")


def build_network(station_lines: DataFrame, sections: DataFrame, speed_overrides: DataFrame | None = None) -> Network:
    """Lines, stations and routing arcs of a rail network.

    Without ``speed_overrides`` nothing is built before it is asked for, and a search builds the lines it can ride on.
    """
    if speed_overrides is not None:
        return _whole_network(station_lines, sections, speed_overrides)
    return LazyNetwork(
        lambda: (station_lines, sections), lambda lines: (of_lines(station_lines, lines), of_lines(sections, lines)),
        lambda only: only(station_lines),
    )


def _whole_network(station_lines: DataFrame, sections: DataFrame, speed_overrides: DataFrame | None = None) -> Network:
    """The tables of a network in full.

    Lines are materialised, stations only if they had to move. The arcs are a plan over the sections: they are computed when a search prepares
    them, and only the adjacency is kept.
    """
    from stopover.operators.graph import resolve_overrides

    lines = cut_lineage(build_lines(sections))
    stations = build_stations(station_lines, sections)
    edges = build_ride_edges(sections)
    chosen = None
    if speed_overrides is not None:
        edges = cut_lineage(edges)
        chosen = resolve_overrides(speed_overrides, lines, stations, edges)[0]
    timed = edge_minutes(edges, lines, chosen)
    return Network(lines, stations, both_ways(timed, milli(F.col("minutes"))).unionByName(transfer_arcs(stations)))


# ------------------------------------------------------------------ walking


def build_walk_graph(roads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lon, lat) and edges (source, target, length_m, minutes) of the walkable roads."""
    ok = roads.where(walkable(F.col("toll"), F.col("road_class"), F.col("state")))

    def key(p: Column) -> Column:
        return node_key(snap_x(p["lon"]), snap_y(p["lat"]))

    first, last = line_start(F.col("line")), line_end(F.col("line"))
    edges = ok.select(
        key(first).alias("source"), key(last).alias("target"), line_length_m(F.col("line")).alias("length_m")
    ).withColumn("minutes", walk_minutes(F.col("length_m")))
    ends = ok.select(F.explode(F.array(first, last)).alias("p"))
    nodes = ends.groupBy(key(F.col("p")).alias("node_id")).agg(F.min("p").alias("p")).select("node_id", "p.lon", "p.lat")
    return nodes, edges


def walk_arcs(edges: DataFrame) -> DataFrame:
    return both_ways(edges, milli(F.col("minutes")))


def group_centroids(stations: DataFrame) -> DataFrame:
    """Mean position of each group's platforms."""
    return stations.groupBy("group_code").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def snap_to_network(points: DataFrame, nodes: DataFrame, key: str | list[str], cap_m: float = SNAP_CAP_M) -> DataFrame:
    """Nearest network node of each point within the cap: keys, node_id, access_m."""
    return nearest_within(points, nodes, cap_m, key, "node_id").withColumnRenamed("dist_m", "access_m")


def place_access(places: DataFrame, access_points: DataFrame, nodes: DataFrame, cap_m: float = SNAP_CAP_M) -> DataFrame:
    """Network nodes of every place: those of its access points, or its own point if none snapped.

    Output: (spot_id, ap_id, node_id, access_m); ``ap_id`` is NULL for the place's own point.
    """
    by_ap = snap_to_network(access_points, nodes, ["spot_id", "ap_id"], cap_m)
    own = snap_to_network(places, nodes, "spot_id", cap_m)
    rest = own.join(by_ap.select("spot_id").distinct(), "spot_id", "left_anti")
    return by_ap.unionByName(rest.withColumn("ap_id", F.lit(None).cast(by_ap.schema["ap_id"].dataType)))
