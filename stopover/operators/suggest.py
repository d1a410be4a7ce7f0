"""Suggestions: reachable stations combined with places, walks and similarity to an interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopover.functions.geo import haversine_m, milli, walk_minutes
from stopover.functions.stats import percentiles, share
from stopover.functions.vectors import cosine_similarity
from stopover.operators.graph import Prepared, shortest_costs
from stopover.operators.network import Network, group_centroids
from stopover.operators.reach import reachable
from stopover.operators.spatial import within_distance

# Fixed values.
BASE_RADIUS_M = 800.0
MAX_RADIUS_M = 2000.0
M_PER_MIN = 80.0
BASE_WALK_MIN = 10.0
MAX_WALK_MIN = 25.0
DETOUR_WEIGHT = 0.05
FIRST_STAGE = 30

_PLACE = ["spot_id", "source", "name", "kinds"]


def interest_similarity(places: DataFrame, interest: list[float]) -> DataFrame:
    """Places with ``sim``, their cosine similarity to an interest vector."""
    q = F.array(*[F.lit(float(x)) for x in interest])
    return places.withColumn("sim", cosine_similarity(F.col("embedding"), q))


def _around(reached: DataFrame, places: DataFrame, base_m: float, max_m: float, v: float) -> DataFrame:
    """Best station of every place within the radius its slack allows."""
    st = reached.select("group_code", "station_name", "t1_min", "t2_min", "slack_min", "lon", "lat")
    near = within_distance(places.select("spot_id", "lon", "lat"), st, max_m, "spot_id", out="d")
    ok = near.where(F.col("d") <= F.least(F.lit(max_m), F.lit(base_m) + F.lit(v) * F.col("slack_min") / 2)).withColumn(
        "slack_left", F.col("slack_min") - 2 * F.greatest(F.lit(0.0), F.col("d") - F.lit(base_m)) / F.lit(v)
    )
    return ok.groupBy("spot_id").agg(
        F.min(
            F.struct((F.col("t1_min") + F.col("t2_min")).alias("t"), "d", "group_code", "station_name", "t1_min", "t2_min", "slack_left")
        ).alias("b")
    )


def _direct(reached: DataFrame) -> DataFrame:
    """Shortest total over the reachable stations, one row."""
    return reached.agg(F.min(F.col("t1_min") + F.col("t2_min")).alias("direct"))


def suggest_from(
    reached: DataFrame, places: DataFrame, base_m: float = BASE_RADIUS_M, max_m: float = MAX_RADIUS_M, v: float = M_PER_MIN
) -> DataFrame:
    """Candidates around reachable stations; ``places`` carries ``sim``."""
    best = _around(reached, places, base_m, max_m, v)
    rows = best.join(places.select(*_PLACE, "sim"), "spot_id").join(F.broadcast(_direct(reached)))  # one row
    return rows.select(
        *_PLACE, F.col("b.group_code").alias("group_code"), F.col("b.station_name").alias("station_name"),
        F.round("b.d", 0).alias("dist_m"), F.col("b.t1_min").alias("t1_min"), F.col("b.t2_min").alias("t2_min"),
        F.round("b.slack_left", 0).alias("slack_min"), (F.col("b.t") - F.col("direct")).alias("detour_min"), "sim",
    )


def suggest_reach_first(net: Network, places: DataFrame, start: str, end: str, available: float, stay: float, interest: list[float], **radius) -> DataFrame:
    """Reachable stations first, then every place around them, with its similarity."""
    return suggest_from(reachable(net, start, end, available, stay), interest_similarity(places, interest), **radius)


def most_similar(places: DataFrame, k: int) -> DataFrame:
    """The k places most similar to the interest, ties by id."""
    return places.orderBy(F.desc(F.round("sim", 12)), "spot_id").limit(k)


def suggest_interest_first(
    net: Network, places: DataFrame, start: str, end: str, available: float, stay: float, interest: list[float], k: int, **radius
) -> DataFrame:
    """The k most similar places first, then those of them near a reachable station."""
    top = most_similar(interest_similarity(places, interest), k)
    return suggest_from(reachable(net, start, end, available, stay), top, **radius)


# ------------------------------------------------------------------ walking


def station_place_walks(
    arcs: DataFrame, station_access: DataFrame, place_access: DataFrame, max_min: float = MAX_WALK_MIN, adj: Prepared | None = None
) -> DataFrame:
    """Walking minutes of every station and place within the limit: (group_code, spot_id, walk_min).

    ``station_access``: (group_code, node_id, access_m); ``place_access``: (spot_id, node_id,
    access_m), several rows per place allowed. All stations are searched in the same rounds,
    each with its own access walk as the starting cost.
    """
    cap = int(round(max_min * 1000))
    seeds = station_access.select(
        F.col("group_code").alias("origin"), F.col("node_id").alias("node"), milli(walk_minutes(F.col("access_m"))).alias("cost")
    )
    costs = shortest_costs(arcs, seeds.where(F.col("cost") <= cap), cap, adj=adj)
    total = F.col("cost") + milli(walk_minutes(F.col("access_m")))
    return (
        costs.join(place_access.select("spot_id", F.col("node_id").alias("node"), "access_m"), "node")
        .groupBy(F.col("origin").alias("group_code"), "spot_id")
        .agg(F.min(total).alias("mm"))
        .where(F.col("mm") <= cap)
        .select("group_code", "spot_id", (F.col("mm") / 1000.0).alias("walk_min"))
    )


def walk_from_station(arcs: DataFrame, station_access: DataFrame, place_access: DataFrame, group: str, max_min: float) -> DataFrame:
    """Walking minutes from one station's group."""
    one = station_access.where(F.col("group_code") == group)
    return station_place_walks(arcs, one, place_access, max_min).select("spot_id", "walk_min")


def suggest_walk_from(
    reached: DataFrame, walks: DataFrame, places: DataFrame, base_walk: float = BASE_WALK_MIN, max_walk: float = MAX_WALK_MIN
) -> DataFrame:
    """Candidates by precomputed walking time; the station wastes the least total time, then the least walk."""
    st = reached.select("group_code", "station_name", "t1_min", "t2_min", "slack_min", F.col("lon").alias("st_lon"), F.col("lat").alias("st_lat"))
    ok = (
        st.join(walks, "group_code")
        .where(F.col("walk_min") <= F.least(F.lit(max_walk), F.lit(base_walk) + F.col("slack_min") / 2))
        .withColumn("slack_left", F.col("slack_min") - 2 * F.greatest(F.lit(0.0), F.col("walk_min") - F.lit(base_walk)))
    )
    best = ok.groupBy("spot_id").agg(
        F.min(
            F.struct(
                F.round(F.col("t1_min") + F.col("t2_min") + 2 * F.col("walk_min"), 6).alias("total"), "walk_min", "group_code",
                "station_name", "t1_min", "t2_min", "slack_left", "st_lon", "st_lat",
            )
        ).alias("b")
    )
    rows = best.join(places.select(*_PLACE, "sim", "lon", "lat"), "spot_id").join(F.broadcast(_direct(reached)))  # one row
    return rows.select(
        *_PLACE, F.col("b.group_code").alias("group_code"), F.col("b.station_name").alias("station_name"),
        F.round(haversine_m(F.col("lon"), F.col("lat"), F.col("b.st_lon"), F.col("b.st_lat")), 0).alias("dist_m"),
        F.col("b.t1_min").alias("t1_min"), F.col("b.t2_min").alias("t2_min"), F.round("b.slack_left", 0).alias("slack_min"),
        F.round(F.round(F.col("b.t1_min") + F.col("b.t2_min") - F.col("direct") + 2 * F.col("b.walk_min"), 6), 0).alias("detour_min"),
        "sim", F.round("b.walk_min", 1).alias("walk_min"),
    )


def suggest_walk(
    net: Network, walks: DataFrame, places: DataFrame, start: str, end: str, available: float, stay: float, interest: list[float], **limits
) -> DataFrame:
    reached = reachable(net, start, end, available, stay, include_ends=True)
    return suggest_walk_from(reached, walks, interest_similarity(places, interest), **limits)


# ------------------------------------------------------------------ rankings and comparisons


def composite_score() -> Column:
    return F.col("sim") - F.lit(DETOUR_WEIGHT) * F.col("detour_min") / 60.0


def top_ranked(cand: DataFrame, method: str, k: int = 10) -> DataFrame:
    """Top k by similarity (A), by detour among the 30 most similar (B), or by similarity less detour hours (C)."""
    sim = F.desc(F.round("sim", 12))
    if method == "A":
        order = [sim, F.asc("spot_id")]
    elif method == "B":
        cand = cand.orderBy(sim, "spot_id").limit(FIRST_STAGE)
        order = [F.asc("detour_min"), sim, F.asc("spot_id")]
    else:
        cand = cand.withColumn("score", composite_score())
        order = [F.desc(F.round("score", 12)), F.asc("spot_id")]
    top = cand.orderBy(*order).limit(k)
    # At most k rows: numbering them in one task is the product.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def order_of_filters(cand: DataFrame, places: DataFrame, ks: list[int], top: int = 10) -> DataFrame:
    """How many of the reach-first top 10 survive when the k most similar places are chosen first."""
    best = top_ranked(cand, "A", top).select("spot_id")
    out = None
    for k in ks:
        kept = most_similar(places, k).select("spot_id")
        row = kept.join(cand.select("spot_id"), "spot_id", "left_semi").agg(F.count(F.lit(1)).alias("kept")).join(
            F.broadcast(best.join(kept, "spot_id", "left_semi").agg(F.count(F.lit(1)).alias("hits")))
        ).select(F.lit(k).alias("k"), "kept", "hits")
        out = row if out is None else out.unionByName(row)
    return out


def compare_candidates(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both tables, only in the first, only in the second."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = x.join(y, keys, "full")
    return both.agg(
        F.count(F.when(F.col("_a") & F.col("_b"), 1)).alias("both"),
        F.count(F.when(F.col("_a") & F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_b") & F.col("_a").isNull(), 1)).alias("only_b"),
    )


def walk_line_ratio(walks: DataFrame, stations: DataFrame, places: DataFrame) -> DataFrame:
    """Walked metres over straight-line metres of every station and place: adds line_m, ratio."""
    st = group_centroids(stations).withColumnRenamed("lon", "g_lon").withColumnRenamed("lat", "g_lat")
    rows = walks.join(places.select("spot_id", "lon", "lat"), "spot_id").join(st, "group_code")
    line = haversine_m(F.col("lon"), F.col("lat"), F.col("g_lon"), F.col("g_lat"))
    return rows.select("group_code", "spot_id", "walk_min", line.alias("line_m")).withColumn(
        "ratio", F.when(F.col("line_m") > 0, F.col("walk_min") * M_PER_MIN / F.col("line_m"))
    )


def ratio_report(pairs: DataFrame, shares=(0.5, 0.75, 0.9, 0.99), min_line: float = 300.0) -> DataFrame:
    """Quantiles of the ratio where the line is at least 300 m."""
    return percentiles(pairs.where(F.col("line_m") >= min_line), [], "ratio", list(shares), "floor")


def near_but_far(pairs: DataFrame, line_m: float = 800.0, walk_min: float = 15.0) -> DataFrame:
    """Pairs close in a straight line but long to walk, with their share of the close pairs; one row."""
    close = F.col("line_m") <= line_m
    far = close & (F.col("walk_min") > walk_min)
    return pairs.agg(F.count(F.when(close, 1)).alias("close"), F.count(F.when(far, 1)).alias("far")).withColumn(
        "far_share", share(F.col("far"), F.col("close"))
    )


def worst_ratios(pairs: DataFrame, k: int = 10, min_line: float = 300.0) -> DataFrame:
    return pairs.where(F.col("line_m") >= min_line).orderBy(F.desc("ratio"), "group_code", "spot_id").limit(k)


def access_impact(before: DataFrame, after: DataFrame, walk_step: float = 3.0) -> DataFrame:
    """Nearest-walk change of each place between two walking tables: (spot_id, before, after, delta)."""
    a = before.groupBy("spot_id").agg(F.min("walk_min").alias("before"))
    b = after.groupBy("spot_id").agg(F.min("walk_min").alias("after"))
    return a.join(b, "spot_id", "full").withColumn("delta", F.col("after") - F.col("before")).withColumn(
        "change",
        F.when(F.col("delta") <= -walk_step, "nearer").when(F.col("delta") >= walk_step, "farther")
        .when(F.col("delta").isNotNull(), "same").when(F.col("before").isNull(), "gained").otherwise("lost"),
    )


def impact_summary(impact: DataFrame) -> DataFrame:
    return impact.groupBy("change").agg(F.count(F.lit(1)).alias("places"), F.avg("delta").alias("mean_delta"))


def delta_report(deltas: DataFrame, by: list[str], step: float = 3.0, shares=(0.2, 0.5, 0.8)) -> DataFrame:
    """Distribution of ``delta`` per group: pairs, mean, quantiles (p20 ..), and how many fall or rise by ``step`` or more, or neither."""
    d = deltas.where(F.col("delta").isNotNull())
    base = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("delta").alias("mean_delta"),
        F.count(F.when(F.col("delta") <= -step, 1)).alias("nearer"), F.count(F.when(F.col("delta") >= step, 1)).alias("farther"),
        F.count(F.when(F.abs("delta") < step, 1)).alias("same"),
    )
    quantiles = [F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{round(s * 100)}") for s in shares]
    if by:
        return base.join(percentiles(d, by, "delta", list(shares), "rounded").groupBy(*by).agg(*quantiles), by)
    one = percentiles(d, [], "delta", list(shares), "rounded").agg(*quantiles)
    return base.withColumn("_k", F.lit(1)).join(one.withColumn("_k", F.lit(1)), "_k").drop("_k")


def pair_churn(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pairs in both tables, gone, come, and the share of all pairs that changed sides."""
    c = compare_candidates(before, after, keys).withColumnsRenamed({"only_a": "gone", "only_b": "come"})
    return c.withColumn("churn", share((F.col("gone") + F.col("come")).cast("double"), F.col("both") + F.col("gone") + F.col("come")))


def top_churn(before: DataFrame, after: DataFrame, by: str, item: str, cost: str, k: int = 10) -> DataFrame:
    """The k cheapest items of each group in either table: (by, both, gone, come, moved).

    ``moved`` counts items that stay among the k but change their place. Ties go by the item.
    """
    def ranked(df: DataFrame, name: str) -> DataFrame:
        least = df.groupBy(by, item).agg(F.min(cost).alias("_c"))
        w = Window.partitionBy(by).orderBy("_c", item)
        return least.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k).select(by, item, name)

    both = ranked(before, "_a").join(ranked(after, "_b"), [by, item], "full")
    return both.groupBy(by).agg(
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("gone"), F.count(F.when(F.col("_a").isNull(), 1)).alias("come"),
        F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("moved"),
    )


def impact_report(before: DataFrame, after: DataFrame, step: float = 3.0, k: int = 10) -> DataFrame:
    """One row on what another walking table changes: nearest walks of places, station-place pairs, and each station's k nearest places.

    ``before``, ``after``: (group_code, spot_id, walk_min), possibly several rows per pair.
    """
    places = delta_report(access_impact(before, after, step), [], step)
    pairs = pair_churn(before, after, ["group_code", "spot_id"]).select(*[F.col(c).alias(f"pairs_{c}") for c in ("both", "gone", "come", "churn")])
    tops = top_churn(before, after, "group_code", "spot_id", "walk_min", k).agg(
        F.count(F.lit(1)).alias("stations"), F.count(F.when(F.col("gone") + F.col("come") > 0, 1)).alias("stations_changed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"top_{c}") for c in ("both", "gone", "come", "moved")],
    )
    one = F.lit(1).alias("_k")
    return places.select("*", one).join(pairs.select("*", one), "_k").join(tops.select("*", one), "_k").drop("_k")


def access_sources(access_points: DataFrame) -> DataFrame:
    """Sources of each place's access points, joined by a comma."""
    return access_points.groupBy("spot_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def pairwise_deltas(walks: DataFrame) -> DataFrame:
    """Differences between every two walking variants on the pairs both know.

    ``walks``: (variant, group_code, spot_id, walk_min), possibly several rows per pair. The
    variants of one pair are packed into an array, so pairs of variants come from one row.
    """
    least = walks.groupBy("variant", "group_code", "spot_id").agg(F.min("walk_min").alias("m"))
    packed = least.groupBy("group_code", "spot_id").agg(F.array_sort(F.collect_list(F.struct("variant", "m"))).alias("v"))
    a = packed.select("group_code", "spot_id", "v", F.explode("v").alias("x")).select("x", F.explode("v").alias("y"))
    return a.where(F.col("x.variant") < F.col("y.variant")).select(
        F.col("x.variant").alias("a"), F.col("y.variant").alias("b"), (F.col("y.m") - F.col("x.m")).alias("delta")
    )


def delta_matrix(walks: DataFrame, shares=(0.5, 0.9), step: float = 3.0) -> DataFrame:
    """Pairs, mean, quantiles and three-way counts of the difference between every two variants."""
    return delta_report(pairwise_deltas(walks), ["a", "b"], step, shares)


# ------------------------------------------------------------------ supplied travel-time tables


def od_compare(a: DataFrame, b: DataFrame, keys: list[str], column: str, tolerance: float = 5.0) -> DataFrame:
    """Two travel-time tables side by side: common pairs, within tolerance, faster, slower, one-sided; one row."""
    x = a.select(*keys, F.col(column).alias("_x"))
    y = b.select(*keys, F.col(column).alias("_y"))
    d = F.col("_y") - F.col("_x")
    return x.join(y, keys, "full").agg(
        F.count(d).alias("common"),
        F.count(F.when(F.abs(d) <= tolerance, 1)).alias("within"),
        F.count(F.when(d < -tolerance, 1)).alias("faster"),
        F.count(F.when(d > tolerance, 1)).alias("slower"),
        F.count(F.when(F.col("_x").isNotNull() & F.col("_y").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_y").isNotNull() & F.col("_x").isNull(), 1)).alias("only_b"),
        F.avg(d).alias("mean_diff"),
    )


def door_candidates(times: DataFrame, available: float, stay: float, extra: float = 20.0) -> DataFrame:
    """Candidates of supplied door-to-door tables ranked by similarity less detour.

    ``times``: (spot_id, t1, t2, direct, sim). The rank is a running count over the sorted rows.
    """
    from stopover.functions.stats import prefix_sum

    rows = times.where(F.col("t1") + F.col("t2") + stay <= available + extra).withColumn(
        "detour", F.col("t1") + F.col("t2") - F.col("direct")
    )
    rows = rows.withColumn("score", F.col("sim") - DETOUR_WEIGHT * F.col("detour") / 60.0)
    rows = rows.withColumn("_neg", -F.round("score", 12)).withColumn("_one", F.lit(1))
    return prefix_sum(rows, ["_neg", "spot_id"], "_one", "rank").drop("_neg", "_one")


def top_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Common places of two top-k lists; one row, with how many use the same alighting stop."""
    x = a.where(F.col("rank") <= k).select("spot_id", F.col("stop").alias("_s"))
    y = b.where(F.col("rank") <= k).select("spot_id", F.col("stop").alias("_t"))
    return x.join(y, "spot_id").agg(
        F.count(F.lit(1)).alias("overlap"), F.count(F.when(F.col("_s") == F.col("_t"), 1)).alias("same_stop")
    )


def itinerary_parts(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Access, transfer walk, egress, ride, first wait and total of itineraries.

    ``legs``: keys.., leg (order), mode, start, end in minutes, and ``depart`` of the request. The first and
    last leg count as access and egress when they are walks; what is left after all walks and
    rides is waiting.
    """
    ends = legs.groupBy(*keys).agg(F.min("leg").alias("_first"), F.max("leg").alias("_last"))
    rows = legs.join(ends, keys)
    dur = F.col("end") - F.col("start")
    walk = F.col("mode") == "WALK"
    first, last = F.col("leg") == F.col("_first"), F.col("leg") == F.col("_last")
    out = rows.groupBy(*keys).agg(
        (F.max("end") - F.min("depart")).alias("total"),
        (F.min("start") - F.min("depart")).alias("first_wait"),
        F.sum(F.when(walk & first, dur).otherwise(0.0)).alias("access"),
        F.sum(F.when(walk & last & ~first, dur).otherwise(0.0)).alias("egress"),
        F.sum(F.when(walk & ~first & ~last, dur).otherwise(0.0)).alias("transfer"),
        F.sum(F.when(~walk, dur).otherwise(0.0)).alias("ride"),
    )
    return out.withColumn(
        "wait", F.col("total") - F.col("first_wait") - F.col("access") - F.col("egress") - F.col("transfer") - F.col("ride")
    )


def parts_medians(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by).agg(
        *[F.percentile(c, 0.5).alias(c) for c in ("total", "first_wait", "access", "transfer", "egress", "wait", "ride")]
    )


def averaged_times(samples: DataFrame, keys: list[str], offsets: int = 5) -> DataFrame:
    """Mean over the departures that arrived, and p50/p80 only where all departures did."""
    got = samples.where(F.col("minutes").isNotNull())
    base = got.groupBy(*keys).agg(F.avg("minutes").alias("mean"), F.count(F.lit(1)).alias("n"))
    p = percentiles(got, keys, "minutes", [0.5, 0.8], "rounded").groupBy(*keys).agg(
        F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("_p50"),
        F.max(F.when(F.col("share") == 0.8, F.col("value"))).alias("_p80"),
    )
    full = F.col("n") == offsets
    return base.join(p, keys).select(*keys, "mean", "n", F.when(full, F.col("_p50")).alias("p50"), F.when(full, F.col("_p80")).alias("p80"))
