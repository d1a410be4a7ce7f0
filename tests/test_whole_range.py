"""Joins and readers that must not lose rows: high latitudes, the date line, large query sets, dropped posts."""

import math
import random

from pyspark.sql import functions as F

from stopover.operators import spatial, vectors
from stopover.sources import readers


def _metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(h))


def test_distances_everywhere(spark):
    rng = random.Random(5)
    centres = [(179.999, 0.0), (-179.9995, 70.0), (10.0, 85.0), (-60.0, -85.0), (139.7, 35.6), (0.0, 89.99)]
    spot = lambda c: ((c[0] + rng.uniform(-0.02, 0.02) / max(math.cos(math.radians(c[1])), 1e-3) + 540) % 360 - 180, min(c[1] + rng.uniform(-0.02, 0.02), 90.0))
    pts, anc = [spot(c) for c in centres for _ in range(40)], [spot(c) for c in centres for _ in range(40)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(pts)], "pid int, lon double, lat double")
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(anc)], "aid int, lon double, lat double")
    got = sorted((r["pid"], r["aid"]) for r in spatial.within_distance(p, a, 900.0, "pid").collect())
    far = {(i, j): _metres(x, y) for i, x in enumerate(pts) for j, y in enumerate(anc)}
    assert set(got) >= {k for k, d in far.items() if d < 899} and set(got) <= {k for k, d in far.items() if d < 901}
    assert len(got) == len(set(got)) > 300


def test_query_sets_of_any_size(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(25)]
    q = spark.createDataFrame(rows, "qid long, embedding array<double>")
    v = q.withColumnRenamed("qid", "item_id").where("item_id < 17")
    key = lambda df: sorted((r["qid"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    whole = key(vectors.similarities(q, v, "item_id"))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    assert key(vectors.similarities(q, v, "item_id")) == whole and len(whole) == 25 * 17


def test_posts_are_numbered_after_the_drop(spark):
    kind = "conv string, alias map<string,string>, written_by string, posts array<struct<id:string,day:int,author:string,reply_to:string,text:string,new_thread:boolean,topics:array<string>>>"
    posts = [(f"p{i}", 1, "a", None, "t", i in (2, 5), None) for i in range(9)]
    got = readers.flatten_posts(spark.createDataFrame([("c", None, None, posts)], kind)).orderBy("seq").select("seq", F.col("post_id")).collect()
    assert [tuple(r) for r in got] == list(enumerate(["p0", "p1", "p3", "p4", "p6", "p7", "p8"]))


def test_parallel_and_collinear_segments_do_not_cross(spark):
    at = "struct<lon:double,lat:double>"
    square = [[(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01), (0.0, 0.0)]]
    areas = spark.createDataFrame([("a", square)], f"area_idx string, rings array<array<{at}>>")
    lines = spark.createDataFrame(
        [("through", [(-0.005, 0.005), (0.015, 0.005)]), ("along", [(-0.005, 0.0), (0.015, 0.0)]), ("beside", [(0.0, 0.02), (0.01, 0.02)]), ("point", [(0.0, 0.0), (0.0, 0.0)])],
        f"way_id string, line array<{at}>",
    )
    hits = spatial.line_area_crossings(lines, areas, "way_id", "area_idx")
    # The filter on top is pushed into the crossing's own conditions, as other plans do it.
    got = {(r["way_id"], r["lon"], r["lat"]) for r in hits.where("lon < 0.02").collect()}
    assert {x for x in got if x[0] == "through"} == {("through", 0.0, 0.005), ("through", 0.01, 0.005)}
    assert {x for x in got if x[0] == "along"} == {("along", 0.0, 0.0), ("along", 0.01, 0.0)}  # only the upright sides
    assert not {x for x in got if x[0] in ("beside", "point")}
