"""Graph analytics as iterative joins: bounded shortest paths, routes, components, reply chains."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopover.functions.geo import haversine_m, milli
from stopover.session import HOT_KEY_ROWS, adaptive_skew, cut_lineage, skew_join

# Arcs one adjacency row may hold; a node with more is stored in several rows.
ADJACENCY_CHUNK = 1_000
# Relaxations planned between two lineage cuts.
HOPS_PER_CUT = 8
# Largest adjacency, in arcs, that is sent to every task; about 40 bytes each in the hash table.
BROADCAST_ARCS = 6_000_000
# A search of up to this many rows is hashed against the kept graph, if that has more arcs; sending the graph round costs more.
HASHED_ROWS = 200_000
# A search of more rows is cut into bands of cost: only rows below the end of the band make offers.
BAND_ROWS = 5_000_000
BANDS = 8
# Settled rows are set aside, out of the rounds' shuffles, as soon as there are so many.
SETTLED_ROWS = 200_000
# A graph of up to this many arcs is searched within one task, in about 100 bytes an arc.
LOCAL_ARCS = 6_000_000


class StationNotFound(ValueError):
    pass


class AmbiguousStation(ValueError):
    pass


def adjacency(arcs: DataFrame) -> DataFrame:
    """Arcs packed per source: (node, out) with ``out`` an array of (target, cost), partitioned by node.

    Of parallel arcs the cheapest stays. A node of very many arcs is spread over rows of about
    ``ADJACENCY_CHUNK`` arcs, so no row holds a hub's whole neighbourhood. The arcs are dealt by
    source once; everything after works where they lie.
    """
    n = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = F.col("source").alias("node")
    cheapest = arcs.select(node, "target", "cost").repartition(n, "node").groupBy("node", "target").agg(F.min("cost").alias("cost"))
    degree = F.count(F.lit(1)).over(Window.partitionBy("node"))
    chunk = F.pmod(F.xxhash64("target"), F.ceil(F.col("_d") / F.lit(ADJACENCY_CHUNK)).cast("long"))
    return (
        cheapest.withColumn("_d", degree).withColumn("chunk", chunk)
        .groupBy("node", "chunk")
        .agg(F.collect_list(F.struct("target", "cost")).alias("out"))
        .select("node", "out")
    )


@dataclass
class Prepared:
    """A graph laid out for many searches: adjacency by node, its arcs counted, its longest arc."""

    adj: DataFrame
    arcs: int
    longest: int


def prepare(arcs: DataFrame) -> Prepared:
    """Adjacency of a graph laid out for many searches; build it once per network.

    It is hash-partitioned and sorted by node and kept on the executors, so a round moves the
    rows of the search but never the graph.
    """
    kept = adjacency(arcs).sortWithinPartitions("node").persist()
    held, longest = kept.agg(F.sum(F.size("out")), F.max(F.array_max("out.cost"))).first()
    return Prepared(kept, held or 0, longest or 0)


def _relax(state: DataFrame, adj: DataFrame, cap: int | None, top: int | None) -> DataFrame:
    """One round: every improved row below ``top`` offers its arcs; the best offer per (origin, node) stays.

    Rows carry the cost they had before the round in ``old`` (null while they have not made offers at that
    cost), so one aggregate both merges the offers and tells which rows are still to make theirs. Offers are
    combined map-side before the shuffle.
    """
    asks = F.col("fresh") if top is None else F.col("fresh") & (F.col("cost") < top)
    step = state.join(adj.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & asks, "left")
    old = "cost" if top is None else f"if(fresh and cost >= {top}, null, cost)"
    itself = f"array(struct(node, cost, {old} as old))"
    offers = "transform(out, a -> struct(a.target as node, cost + a.cost as cost, cast(null as bigint) as old))"
    rows = step.selectExpr("origin", f"inline(if(out is null, {itself}, concat({itself}, {offers})))")
    if cap is not None:
        rows = rows.where(f"cost <= {cap}")
    best = rows.groupBy("origin", "node").agg(F.min("cost").alias("cost"), F.min("old").alias("old"))
    return best.selectExpr("origin", "node", "cost", "old is null or cost < old as fresh")


def shortest_costs(
    arcs: DataFrame, seeds: DataFrame, cap: int | None, hops: int = HOPS_PER_CUT, sink: DataFrame | None = None,
    adj: Prepared | None = None, delta: int | None = None, settled_rows: int = SETTLED_ROWS,
) -> DataFrame:
    """Bounded multi-source shortest path: (origin, node, cost) with cost at most ``cap``; arc costs are not negative.

    ``seeds``: (origin, node, cost) starting rows; every origin is searched in the same
    rounds, and several seeds of one origin act as one virtual source. ``sink`` (origin,
    node) names goals: once an origin reaches one, costs beyond its best arrival are not
    explored. ``adj`` is the graph as :func:`prepare` leaves it, for searches that share one.

    The rounds go through bands of cost ``delta`` wide: rows beyond the band wait until every row in it has made its offers,
    so they make theirs about once instead of at each improvement. Without ``delta`` a search has one band until it holds
    more than BAND_ROWS rows. No later offer can be lower than the lowest row that still waits; what lies below it by more
    than the longest arc is settled. Settled rows are set aside partitioned by (origin, node) and take no part in the
    rounds; offers that go back to them, along arcs without a way back, are dropped against them after each cut.
    """
    graph = prepare(arcs) if adj is None else adj
    n = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = cut_lineage(
        seeds.groupBy("origin", "node").agg(F.min(F.col("cost").cast("long")).alias("cost")).withColumn("fresh", F.lit(True))
    )
    settled: list[DataFrame] = []
    rows, floor = live.agg(F.count("*"), F.min("cost")).first()
    wait, top = rows, None if delta is None or floor is None else floor + delta
    while wait:
        for _ in range(hops):
            if rows <= HASHED_ROWS < graph.arcs:
                live = _relax(live.hint("shuffle_hash"), graph.adj, cap, top)
            else:
                live = _relax(live, F.broadcast(graph.adj) if graph.arcs <= BROADCAST_ARCS else graph.adj, cap, top)
        for part in settled:
            live = live.join(part.select("origin", "node"), ["origin", "node"], "left_anti")
        live = cut_lineage(live)
        if sink is not None:
            arrived = live.select("origin", "node", "cost")
            for part in settled:
                arrived = arrived.unionByName(part)
            arrived = arrived.join(sink, ["origin", "node"], "left_semi").groupBy("origin").agg(F.min("cost").alias("_best"))
            live = live.join(arrived, "origin", "left").select(
                "origin", "node", "cost", (F.col("fresh") & (F.col("_best").isNull() | (F.col("cost") < F.col("_best")))).alias("fresh")
            )
        rows, wait, floor, high = live.agg(
            F.count("*"), F.count(F.when(F.col("fresh"), 1)), F.min(F.when(F.col("fresh"), F.col("cost"))), F.max("cost")
        ).first()
        if not wait:
            break
        if delta is not None:
            top = top if floor < top else floor + delta
        elif rows > BAND_ROWS:
            top = floor + max((high - floor) // BANDS, graph.longest, 1)
        else:
            top = None
        below = floor - graph.longest
        old = live.where((F.col("cost") < below) & ~F.col("fresh")).select("origin", "node", "cost")
        if old.count() > settled_rows:
            settled.append(old.repartition(n, "origin", "node").persist())
            live = live.where((F.col("cost") >= below) | F.col("fresh"))
    if adj is None:
        graph.adj.unpersist()
    out = live.select("origin", "node", "cost")
    if settled:
        for part in settled:
            out = out.unionByName(part)
        out = cut_lineage(out)
        for part in settled:
            part.unpersist()
    return out


def _local_costs(cap: int | None):
    """Relaxation in numpy of (origin, node, cost) rows over (source, target, cost) rows, both as Arrow tables."""

    def run(seeds: pa.Table, arcs: pa.Table) -> pa.Table:
        source, target, cost = (arcs.column(c).to_numpy() for c in ("source", "target", "cost"))
        names, node, first = (seeds.column(c) for c in ("origin", "node", "cost"))
        node, first = node.to_numpy(), first.to_numpy()
        keys = np.unique(np.concatenate([source, target, node]))
        order = np.argsort(source, kind="stable")
        target, cost = np.searchsorted(keys, target[order]), cost[order]
        at = np.searchsorted(source[order], keys, side="left")
        until = np.append(at[1:], len(source))
        names = names.combine_chunks().dictionary_encode()
        far = np.iinfo(np.int64).max
        out = []
        for i, name in enumerate(names.dictionary):
            own = names.indices.to_numpy() == i
            best = np.full(len(keys), far)
            np.minimum.at(best, np.searchsorted(keys, node[own]), first[own])
            fresh = np.flatnonzero(best < far)
            while len(fresh):
                many = until[fresh] - at[fresh]
                arc = np.repeat(at[fresh] - np.cumsum(many) + many, many) + np.arange(many.sum())
                offer, to = np.repeat(best[fresh], many) + cost[arc], target[arc]
                good = offer < best[to]
                if cap is not None:
                    good &= offer <= cap
                np.minimum.at(best, to[good], offer[good])
                fresh = np.unique(to[good])
            got = np.flatnonzero(best < far)
            out.append(pa.table({"origin": pa.array([name.as_py()] * len(got), pa.string()), "node": keys[got], "cost": best[got]}))
        return pa.concat_tables(out)

    return run


def small_costs(arcs: DataFrame, seeds: DataFrame, cap: int | None, count: int) -> DataFrame:
    """As :func:`shortest_costs`, for few origins (strings): a graph of up to LOCAL_ARCS arcs (``count``) is searched within one task."""
    arcs = arcs.select(*[F.col(c).cast("long").alias(c) for c in ("source", "target", "cost")])
    if count > LOCAL_ARCS:
        return shortest_costs(arcs, seeds, cap)
    k = F.lit(0).alias("k")
    known = arcs.dropna().select(k, "source", "target", "cost")
    start = seeds.where("node is not null").select(k, "origin", "node", F.col("cost").cast("long").alias("cost"))
    return start.groupBy("k").cogroup(known.groupBy("k")).applyInArrow(_local_costs(cap), "origin string, node long, cost long")


def shortest_route(
    arcs: DataFrame, starts: DataFrame, goals: DataFrame, cap: int | None = None, adj: Prepared | None = None
) -> DataFrame:
    """Nodes of one shortest path from any start to the cheapest goal: (step, node, cost).

    ``starts`` and ``goals``: (node). Step 0 is the start. Ties are settled by the smaller
    predecessor key. An unreachable goal gives no rows.
    """
    seeds = starts.select(F.lit("from").alias("origin"), "node", F.lit(0).cast("long").alias("cost"))
    cost = shortest_costs(arcs, seeds, cap, sink=goals.select(F.lit("from").alias("origin"), "node"), adj=adj).select("node", "cost")
    end = (
        cost.join(goals.select("node"), "node", "left_semi").orderBy("cost", "node").limit(1)
    )
    # An arc is tight when it explains the cost of its target exactly; costs are whole numbers.
    a = arcs.groupBy("source", "target").agg(F.min("cost").alias("len"))
    src = cost.select(F.col("node").alias("source"), F.col("cost").alias("c0"))
    dst = cost.select(F.col("node").alias("target"), F.col("cost").alias("c1"))
    tight = (
        a.join(src, "source").join(dst, "target")
        .where((F.col("c0") + F.col("len") == F.col("c1")) & (F.col("source") != F.col("target")))
        .join(starts.select(F.col("node").alias("target")), "target", "left_anti")
        .groupBy(F.col("target").alias("node"))
        .agg(F.min(F.struct(F.col("c0"), F.col("source"))).alias("p"))
        .select("node", F.col("p.source").alias("prev"), F.col("p.c0").alias("prev_cost"))
    )
    prev = cut_lineage(tight)
    path = cut_lineage(end.select(F.lit(0).alias("back"), "node", "cost"))
    found = [path]
    here, depth = path, 0
    while True:
        reached = []
        for _ in range(HOPS_PER_CUT):
            depth += 1
            # One row per route: the frontier is a single node.
            here = prev.join(F.broadcast(here.select("node")), "node").select(
                F.lit(depth).alias("back"), F.col("prev").alias("node"), F.col("prev_cost").alias("cost")
            )
            reached.append(here)
        part = reached[0]
        for r in reached[1:]:
            part = part.unionByName(r)
        part = cut_lineage(part.coalesce(1))
        found.append(part)
        here = part.where(F.col("back") == depth)
        if here.isEmpty():
            break
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    last = out.agg(F.max("back").alias("m"))
    return out.join(F.broadcast(last)).select((F.col("m") - F.col("back")).alias("step"), "node", "cost")


# ------------------------------------------------------------------ stations


def resolve_station(stations: DataFrame, station: str, spread_m: float | None = None) -> DataFrame:
    """Groups (group_code) meant by a name or group code.

    Strict by default: more than one group is an error. With ``spread_m`` several groups are
    accepted when no two centroids lie further apart.
    """
    hit = stations.where((F.col("station_name") == station) | (F.col("group_code") == station))
    groups = cut_lineage(hit.groupBy("group_code").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")))
    n = groups.limit(2).count()
    if n == 0:
        raise StationNotFound(station)
    if n > 1:
        if spread_m is None:
            raise AmbiguousStation(station)
        # The box test settles clear cases; only groups inside one box are compared in pairs.
        box = groups.agg(
            haversine_m(F.min("lon"), F.avg("lat"), F.max("lon"), F.avg("lat")),
            haversine_m(F.avg("lon"), F.min("lat"), F.avg("lon"), F.max("lat")),
        ).first()
        if max(box) > spread_m * 1.01:
            raise AmbiguousStation(station)
        a = groups.withColumn("k", F.lit(1))
        b = groups.select(F.lit(1).alias("k"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
        far = a.join(b, "k").agg(F.max(haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))).first()[0]
        if far > spread_m:
            raise AmbiguousStation(station)
    return groups.select("group_code")


def group_nodes(stations: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct platform nodes of some groups: (node)."""
    rows = stations.join(groups, "group_code", "left_semi")
    return (
        rows.select(F.explode(F.array("node_a", "node_b")).alias("node")).where(F.col("node").isNotNull()).distinct()
    )


def platform_costs(stations: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of each station per origin: the cheaper of its two platform ends; unreached stations are absent."""
    ends = stations.select("station_code", F.explode(F.array_distinct(F.array("node_a", "node_b"))).alias("node"))
    return ends.join(costs, "node").groupBy("station_code", "origin").agg(F.min("cost").alias("cost"))


def resolve_overrides(
    overrides: DataFrame, lines: DataFrame, stations: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Edges that speed overrides apply to, and the overrides that could not be placed.

    ``overrides``: (id, operator, line_name, from_station, to_station, speed_kmh). All
    overrides are searched together, each as its own origin on the arcs of its line, by
    length in millimetres; the edges on the path get the speed, and the highest id wins.
    """
    ends = stations.select("line_id", "station_name", "node_a", "station_code")
    first = ends.groupBy("line_id", "station_name").agg(F.min_by("node_a", "station_code").alias("node"))
    placed = (
        overrides.join(lines.select("operator", "line_name", "line_id"), ["operator", "line_name"])
        .join(first.select("line_id", F.col("station_name").alias("from_station"), F.col("node").alias("a")), ["line_id", "from_station"], "left")
        .join(first.select("line_id", F.col("station_name").alias("to_station"), F.col("node").alias("b")), ["line_id", "to_station"], "left")
    )
    placed = cut_lineage(placed)
    good = placed.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    missing = placed.where(F.col("a").isNull() | F.col("b").isNull()).select(
        "id", "operator", "line_name", "from_station", "to_station", F.lit("station not found").alias("warning")
    )
    from stopover.operators.network import both_ways

    own = edges.join(good.select("line_id").distinct(), "line_id", "left_semi")
    arcs = both_ways(own, milli(F.col("length_m")))
    seeds = good.select(F.col("id").alias("origin"), F.col("a").alias("node"), F.lit(0).alias("cost")).unionByName(
        good.select((-F.col("id") - 1).alias("origin"), F.col("b").alias("node"), F.lit(0).alias("cost"))
    )
    goals = good.select(F.col("id").alias("origin"), F.col("b").alias("node")).unionByName(
        good.select((-F.col("id") - 1).alias("origin"), F.col("a").alias("node"))
    )
    cost = shortest_costs(arcs, seeds, None, sink=goals)
    # An edge is on a shortest path when start-to-edge, edge and edge-to-end add up to the whole.
    fwd = cost.where(F.col("origin") >= 0)
    back = cost.where(F.col("origin") < 0).withColumn("origin", -F.col("origin") - 1)
    total = good.select(F.col("id").alias("origin"), F.col("b").alias("node"), "speed_kmh").join(fwd, ["origin", "node"]).select(
        "origin", F.col("cost").alias("total"), "speed_kmh"
    )
    leg = edges.select("edge_id", "source", "target", milli(F.col("length_m")).alias("len"))
    sides = leg.unionByName(leg.select("edge_id", F.col("target").alias("source"), F.col("source").alias("target"), "len"))
    on = (
        sides.join(fwd.select("origin", F.col("node").alias("source"), F.col("cost").alias("c0")), "source")
        .join(back.select("origin", F.col("node").alias("target"), F.col("cost").alias("c1")), ["origin", "target"])
        .join(total, "origin")
        .where(F.col("c0") + F.col("len") + F.col("c1") == F.col("total"))
    )
    return on.groupBy("edge_id").agg(F.max_by("speed_kmh", "origin").alias("speed_kmh")), missing


# ------------------------------------------------------------------ components


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges joined with the least neighbour of ``u``; a star centre's edges are split over tasks."""
    hot_rows = None if adaptive_skew(edges.sparkSession) else HOT_KEY_ROWS
    return skew_join(edges, _min_neighbour(edges), ["u"], ["v"], hot_rows=hot_rows).select("u", "v", "m")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of a graph (node_id; source, target), the component named by its least node.

    Alternates large-star and small-star rewrites of the edge list (Kiveris et al., 2014)
    until it is stable; the number of rounds grows with the logarithm of the graph, not its
    diameter, and no component is gathered in one task.
    """
    e = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).where("u <> v")
    e = cut_lineage(e.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct())
    mark = None
    while True:
        # Large star: connect every larger neighbour of u to u's least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: connect the smaller neighbours of u, and u, to the least of them.
        small = _with_min(large)
        e = small.select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.*").where("u <> v").distinct()
        e = cut_lineage(e)
        now = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            break
        mark = now
    label = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.select(F.col("node_id").alias("node")).join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(components: DataFrame, small: int = 10) -> DataFrame:
    """One row: number of components, nodes, size and share of the largest, components of at most ``small`` nodes."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"),
        F.sum("n").alias("nodes"),
        F.max("n").alias("largest"),
        (F.max("n") / F.sum("n")).alias("largest_share"),
        F.count(F.when(F.col("n") <= small, 1)).alias("small_components"),
    )


# ------------------------------------------------------------------ reply chains


def reply_parents(posts: DataFrame) -> DataFrame:
    """First reply target of each post that was posted before it: (conv, post_id, parent_id).

    Links to posts that came earlier cannot form a loop, so no target on a chain repeats.
    """
    links = posts.select("conv", "post_id", "seq", F.posexplode("reply_to").alias("i", "target"))
    known = posts.select("conv", F.col("post_id").alias("target"), F.col("seq").alias("tseq"))
    return (
        links.join(known, ["conv", "target"])
        .where(F.col("tseq") < F.col("seq"))
        .groupBy("conv", "post_id")
        .agg(F.min_by("target", "i").alias("parent_id"))
    )


def reply_chains(posts: DataFrame, depth: int | None = 8) -> DataFrame:
    """Ancestors of each post along first known reply targets: (conv, post_id, chain), nearest first.

    ``depth`` limits the steps; None runs to the root. Posts without a known target have an
    empty chain. Each round doubles the distance covered.
    """
    parents = reply_parents(posts)
    empty = F.array().cast(f"array<{posts.schema['post_id'].dataType.simpleString()}>")
    state = cut_lineage(
        posts.select("conv", "post_id").join(parents, ["conv", "post_id"], "left").select(
            "conv", "post_id", F.col("parent_id").alias("top"),
            F.when(F.col("parent_id").isNull(), empty).otherwise(F.array("parent_id")).alias("chain"),
        )
    )
    reach = 1
    while True:
        if depth is not None and reach >= depth:
            break
        if state.where(F.col("top").isNotNull()).isEmpty():
            break
        up = state.select("conv", F.col("post_id").alias("top"), F.col("chain").alias("_more"), F.col("top").alias("_top"))
        state = cut_lineage(
            state.join(up, ["conv", "top"], "left").select(
                "conv", "post_id", F.col("_top").alias("top"),
                F.concat("chain", F.coalesce("_more", empty)).alias("chain"),
            )
        )
        reach *= 2
    chain = F.col("chain") if depth is None else F.slice("chain", 1, depth)
    return state.select("conv", "post_id", chain.alias("chain"))
