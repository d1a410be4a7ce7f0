"""Views that give the shared tables the shape of the operators' inputs.

Every view covers its whole table. The same rules are stated in SQL in ``derived_sql`` so
that each registered query can be checked end to end.

* a line is a supplier, a station a (supplier, part) pair that some line item holds, a
  station group is a part; the stations of a line follow each other by part key;
* a place is a customer, a road pair comes from each order;
* positions are spread over 0.25 degree tiles whose number grows with the keys, so density
  does not change with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopover.functions.geo import LINE
from stopover.operators.graph import prepare
from stopover.operators.network import (
    LazyNetwork,
    Network,
    build_walk_graph,
    group_centroids,
    of_lines,
    snap_to_network,
    walk_arcs,
)
from stopover.session import cut_lineage

TILE_DEG = 0.25
PART_TILE, CUSTOMER_TILE, ORDER_TILE = 2000, 1500, 15000
PLATFORM_DEG = 0.002
GRID = 100
STATION_BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_of(key: Column, tile: int) -> Column:
    t = F.floor(key / tile)
    return F.lit(139.5) + (t % 40) * F.lit(TILE_DEG) + ((key * 7919) % 10007) / 10007.0 * F.lit(TILE_DEG)


def lat_of(key: Column, tile: int) -> Column:
    t = F.floor(key / tile)
    return F.lit(35.4) + F.floor(t / 40) * F.lit(TILE_DEG) + ((key * 104729) % 10007) / 10007.0 * F.lit(TILE_DEG)


def _segment(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.array(
        F.struct(lon1.alias("lon"), lat1.alias("lat")), F.struct(lon2.alias("lon"), lat2.alias("lat"))
    ).cast(LINE)


def line_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier as a rail line: operator, line name, class and type codes."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("suppkey"),
        F.concat(F.lit("OP"), F.col("s_nationkey").cast("string")).alias("operator"),
        F.concat(F.lit("LINE"), k.cast("string")).alias("line_name"),
        F.element_at(F.array(*[F.lit(c) for c in ("11", "12", "13", "14", "16", "21", "12", "99")]), (k % 8 + 1).cast("int")).alias("rail_class"),
        F.when(k % 8 == 0, "1").when(k % 8 == 6, "3").otherwise("4").alias("operator_type"),
    )


def _station_keys() -> list[Column]:
    """Name, code and group of a stop."""
    part = F.col("partkey").cast("string")
    return [
        F.concat(F.lit("N"), part).alias("station_name"),
        F.concat_ws("-", F.col("suppkey").cast("string"), part).alias("station_code"),
        F.concat(F.lit("G"), part).alias("group_code"),
    ]


def stops(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, only=None) -> DataFrame:
    """Distinct (suppkey, partkey) with the position of the part.

    ``of``: some lines (suppkey) only. ``only`` keeps some rows by their station keys; that comes before the distinct rows are
    taken, so few are shuffled, and nothing is materialised.
    """
    k = F.col("partkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"))
    if of is not None:
        li = li.join(F.broadcast(of), "suppkey", "left_semi")
    if only is not None:
        li = only(li.select("*", *_station_keys())).select("suppkey", "partkey")
    li = li.distinct()
    return (cut_lineage(li) if only is None else li).withColumn("lon", lon_of(k, PART_TILE)).withColumn("lat", lat_of(k, PART_TILE))


def consecutive(df: DataFrame, part: str, order: str, carry: list[str], block: int = STATION_BLOCK) -> DataFrame:
    """Each row with the next row of its part by an integer order, block by block.

    Rows are paired inside bounded key blocks, and the last row of a block with the first of
    the next one, so a part of any size is never sorted in one task.
    """
    row = F.struct(order, *carry)
    b = df.withColumn("_b", F.floor(F.col(order) / block))
    inner = Window.partitionBy(part, "_b").orderBy(order)
    # Structs are made after the shuffle, which moves each column once.
    after = [F.lead(c).over(inner).alias(f"_n{i}") for i, c in enumerate([order, *carry])]
    paired = b.select(part, order, *carry, *after, F.lead(F.lit(True)).over(inner).alias("_more"))
    follow = F.struct(*[F.col(f"_n{i}").alias(c) for i, c in enumerate([order, *carry])])
    pairs = paired.select(part, row.alias("a"), F.when(F.col("_more"), follow).alias("b"))
    edges = b.groupBy(part, "_b").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    chain = edges.select(part, F.col("hi").alias("a"), F.lead("lo").over(Window.partitionBy(part).orderBy("_b")).alias("b"))
    return pairs.unionByName(chain).where(F.col("b").isNotNull())


def rail_features(
    spark: SparkSession, sf_dir: str, keep: bool = False, lines: DataFrame | None = None, only=None
) -> tuple[DataFrame, DataFrame]:
    """(station lines, sections): a short platform per station, and a section to the next station.

    Only keys are paired and materialised, positions follow from them. ``keep`` holds the pairs too, for callers that read
    the sections several times: a pair takes a fraction of the place of a section with its names and shape. ``lines``
    (line_id) asks for some lines only, ``only`` for some stations, by name, code and group.
    """
    line = line_attributes(spark, sf_dir)
    if lines is not None:
        line = of_lines(line, lines)
    st = stops(spark, sf_dir, line.select("suppkey") if lines is not None else None, only).join(line, "suppkey")
    head = ["operator", "line_name", "rail_class", "operator_type"]
    platform = _segment(F.col("lon"), F.col("lat"), F.col("lon") + PLATFORM_DEG, F.col("lat"))
    station_lines = st.select(
        *head,
        *_station_keys(),
        platform.alias("line"),
    )
    pairs = consecutive(st.select("suppkey", "partkey"), "suppkey", "partkey", []).select(
        "suppkey", F.col("a.partkey").alias("a"), F.col("b.partkey").alias("b")
    )
    links = (cut_lineage(pairs) if keep else pairs).join(line, "suppkey")
    here, there = ((lon_of(F.col(c), PART_TILE), lat_of(F.col(c), PART_TILE)) for c in "ab")
    between = links.select(*head, _segment(here[0] + PLATFORM_DEG, here[1], *there).alias("line"))
    return station_lines, station_lines.select(*head, "line").unionByName(between)


_MEMO: dict[tuple, object] = {}


def _memo(spark: SparkSession, name: str, sf_dir: str, make):
    """Built networks are prepared tables: they are kept per session, searches never are."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def rail_network(spark: SparkSession, sf_dir: str) -> Network:
    def make() -> Network:
        return LazyNetwork(
            lambda: rail_features(spark, sf_dir, keep=True), lambda lines: rail_features(spark, sf_dir, lines=lines),
            lambda only: rail_features(spark, sf_dir, only=only)[0],
        )

    return _memo(spark, "rail", sf_dir, make)


def places(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    """Customers as places; a vector is borrowed from the embeddings by key."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        k.alias("spot_id"), F.when(F.col("c_mktsegment") == "BUILDING", "sample").otherwise("wikidata").alias("source"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kinds"),
        lon_of(k, CUSTOMER_TILE).alias("lon"), lat_of(k, CUSTOMER_TILE).alias("lat"),
    )
    if not with_vectors:
        return c
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(n)).withColumn("vec_id", F.pmod("spot_id", "n")).join(e, "vec_id").drop("vec_id", "n")  # one row


def interest(spark: SparkSession, sf_dir: str) -> list[float]:
    """An interest vector: the mean vector of the whole embedding table, rounded."""
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    rows = e.groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m")).orderBy("i").collect()
    return [r["m"] for r in rows]


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grid roads per order, with attributes that exclude some and leave others NULL."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("_t", F.floor(k / ORDER_TILE)).withColumn("_c", k % (GRID * GRID))
    step = TILE_DEG / GRID
    gx = (F.col("_t") % 40) * GRID + F.col("_c") % GRID
    gy = F.floor(F.col("_t") / 40) * GRID + F.floor(F.col("_c") / GRID)

    def at(x: Column, y: Column) -> tuple[Column, Column]:
        return F.lit(139.5) + x * F.lit(step), F.lit(35.4) + y * F.lit(step)

    here, east, north = at(gx, gy), at(gx + 1, gy), at(gx, gy + 1)
    lines = F.array(_segment(*here, *east), _segment(*here, *north))
    return o.select(
        F.explode(lines).alias("line"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "2").when(F.col("o_orderstatus") == "F", "1").alias("toll"),
        F.when(F.col("o_orderstatus") == "O", "1").alias("road_class"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "5").alias("state"),
    )


def walk_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def make():
        nodes, edges = build_walk_graph(roads(spark, sf_dir))
        return cut_lineage(nodes), cut_lineage(edges)

    return _memo(spark, "walk", sf_dir, make)


def walk_access(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stations and places snapped to the walking network."""
    def make():
        nodes, _ = walk_network(spark, sf_dir)
        groups = group_centroids(rail_network(spark, sf_dir).stations)
        return (
            cut_lineage(snap_to_network(groups, nodes, "group_code")),
            cut_lineage(snap_to_network(places(spark, sf_dir), nodes, "spot_id")),
        )

    return _memo(spark, "access", sf_dir, make)


def walk_table(spark: SparkSession, sf_dir: str, max_min: float) -> DataFrame:
    from stopover.operators.suggest import station_place_walks

    _, edges = walk_network(spark, sf_dir)
    stations, spots = walk_access(spark, sf_dir)
    arcs = walk_arcs(edges)
    adj = _memo(spark, "walk_adj", sf_dir, lambda: prepare(arcs))
    return station_place_walks(arcs, stations, spots, max_min, adj)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as posts: reply links, gold topics and a predicted cluster from turn, role and length."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    pid = F.concat(F.lit("P"), F.col("turn").cast("string"))
    prev = F.concat(F.lit("P"), (F.col("turn") - 1).cast("string"))
    none = F.array().cast("array<string>")
    gold = F.concat(F.lit("T"), F.floor(F.col("turn") / 3).cast("string"))
    return c.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("int").alias("seq"), pid.alias("post_id"),
        F.lit(1).alias("day"), F.col("role").alias("author"),
        F.when((F.col("turn") == 0) | ((F.col("conv_id") * 31 + F.col("turn") * 17) % 4 == 0), none).otherwise(F.array(prev)).alias("reply_to"),
        "text",
        F.when(F.col("role") == "system", none)
        .when(n % 5 == 0, F.array(gold, F.lit("TX")))
        .otherwise(F.array(gold)).alias("topics"),
        F.when(n % 7 == 0, "OFF").otherwise(F.concat(F.lit("c"), (F.floor((F.col("turn") + n % 2) / 3)).cast("string"))).alias("assign"),
        (n % 3 == 0).alias("deferred"),
    )

