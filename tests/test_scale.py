"""The paths that only large or skewed inputs take, forced on small ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopover.functions import stats
from stopover.functions.text import bigram_matrix
from stopover.operators import graph, relevance, spatial, vectors
from stopover.operators.containment import contains_join
from stopover.session import skew_join


def test_skew_join_equals_plain_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        a = sorted(map(tuple, skew_join(left, right, ["k"], ["id"], how, hot_rows=50).collect()), key=str)
        b = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
        assert a == b


def _vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)], f"{name} long, embedding array<double>")


def test_blocked_knn_equals_broadcast_knn(spark, monkeypatch):
    items, queries = _vectors(spark, 300, 1, "item_id"), _vectors(spark, 40, 2, "qid")
    want = sorted(map(tuple, vectors.knn_exact(items, queries, 5).select("qid", "rank", "id").collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 70)
    got = sorted(map(tuple, vectors.knn_exact(items, queries, 5).select("qid", "rank", "id").collect()))
    assert got == want


def test_blocked_self_join_and_group_blocks(spark, monkeypatch):
    items = _vectors(spark, 120, 3, "item_id")
    want = sorted(map(tuple, vectors.knn_exact(items, items.withColumnRenamed("item_id", "qid"), 3, exclude_self=True).select("qid", "rank", "id").collect()))
    within = items.select(F.lit(1).alias("g"), F.col("item_id").alias("id"), "embedding")
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 25)
    got = vectors.knn_within(within, within.withColumnRenamed("id", "qid"), "g", 3)
    assert sorted(map(tuple, got.select("qid", "rank", "id").collect())) == want
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 30)
    got = vectors.knn_exact(items, items.withColumnRenamed("item_id", "qid"), 3, exclude_self=True)
    assert sorted(map(tuple, got.select("qid", "rank", "id").collect())) == want


def test_knn_with_ties_keeps_all_candidates(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "item_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>")
    assert [r["id"] for r in vectors.knn_exact(items, q, 3).orderBy("rank").collect()] == [0, 1, 2]


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(4)
    arcs = [(rng.randrange(80), rng.randrange(80), rng.randint(1, 9)) for _ in range(200)] + [(0, i, 5) for i in range(1, 60)]
    return arcs, spark.createDataFrame(arcs, "source long, target long, cost long")


def _relaxed(arcs, start, cap):
    best = {start: 0}
    changed = True
    while changed:
        changed = False
        for a, b, c in arcs:
            if a in best and best[a] + c <= cap and best[a] + c < best.get(b, 10**9):
                best[b], changed = best[a] + c, True
    return best


@pytest.mark.parametrize("broadcast", [True, False])
def test_shortest_costs_with_a_hub(spark, random_graph, monkeypatch, broadcast):
    arcs, df = random_graph
    monkeypatch.setattr(graph, "ADJACENCY_CHUNK", 7)
    if not broadcast:
        monkeypatch.setattr(graph, "BROADCAST_ARCS", 0)
    seeds = spark.createDataFrame([("a", 0, 0), ("b", 5, 0)], "origin string, node long, cost long")
    got = {(r["origin"], r["node"]): r["cost"] for r in graph.shortest_costs(df, seeds, 14, hops=2).collect()}
    want = {("a", n): c for n, c in _relaxed(arcs, 0, 14).items()} | {("b", n): c for n, c in _relaxed(arcs, 5, 14).items()}
    assert got == want


@pytest.mark.parametrize("delta", [1, 3, 10, 1000, None])
@pytest.mark.parametrize("path", ["hashed", "broadcast", "merged"])
def test_bands_of_cost(spark, monkeypatch, delta, path):
    """Directed arcs of very different length, several bands, rows set aside at once: same costs as plain relaxation."""
    monkeypatch.setattr(graph, "HASHED_ROWS", 40 if path == "hashed" else 0)
    if path == "merged":
        monkeypatch.setattr(graph, "BROADCAST_ARCS", 0)
    if delta is None:
        monkeypatch.setattr(graph, "BAND_ROWS", 5)
    rng = random.Random(4)
    arcs = [(i, i + 1, rng.choice([0, 1, 2])) for i in range(25)] + [(rng.randrange(26), rng.randrange(26), rng.choice([1, 4, 9])) for _ in range(20)]
    arcs += [(25, 0, 1), (12, 3, 0)]
    df = spark.createDataFrame(arcs, "source long, target long, cost long")
    seeds = spark.createDataFrame([("a", 0, 0), ("b", 7, 2), ("b", 20, 0)], "origin string, node long, cost long")
    want = {("a", n): c for n, c in _relaxed(arcs, 0, 10**6).items()}
    for start, first in ((7, 2), (20, 0)):
        for n, c in _relaxed(arcs, start, 10**6).items():
            want["b", n] = min(want.get(("b", n), 10**6), c + first)
    got = graph.shortest_costs(df, seeds, None, hops=3, delta=delta, settled_rows=0).collect()
    assert len(got) == len(want) and {(r["origin"], r["node"]): r["cost"] for r in got} == want


def test_components_with_a_hot_centre(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_KEY_ROWS", 5)
    pairs = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201)]
    edges = spark.createDataFrame(pairs, "source long, target long")
    ids = sorted({n for p in pairs for n in p} | {999})
    nodes = spark.createDataFrame([(n,) for n in ids], "node_id long")
    got = {r["node"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert all(got[n] == 0 for n in range(40)) and all(got[n] == 100 for n in range(100, 131))
    assert got[201] == 200 and got[999] == 999


def test_within_distance_equals_brute_force(spark):
    rng = random.Random(9)
    p = [(i, 139.5 + rng.random() * 0.05, 35.4 + rng.random() * 0.05) for i in range(150)]
    a = [(i, 139.5 + rng.random() * 0.05, 35.4 + rng.random() * 0.05) for i in range(60)]
    pts = spark.createDataFrame(p, "pid int, lon double, lat double")
    anc = spark.createDataFrame(a, "aid int, lon double, lat double")
    got = {(r["pid"], r["aid"]) for r in spatial.within_distance(pts, anc, 700.0, "pid").collect()}

    def dist(u, v):
        la1, la2 = np.radians(u[2]), np.radians(v[2])
        s = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin(np.radians(v[1] - u[1]) / 2) ** 2
        return 2 * 6371000 * np.arcsin(np.sqrt(s))

    assert got == {(u[0], v[0]) for u in p for v in a if dist(u, v) <= 700.0}
    near = {r["pid"]: r["aid"] for r in spatial.nearest_within(pts, anc, 700.0, "pid", "aid").collect()}
    for u in p:
        d, best = min((dist(u, v), v[0]) for v in a)
        assert near.get(u[0]) == (best if d <= 700.0 else None)


def test_contains_join_equals_brute_force(spark):
    texts = [(1, "abcdefghijklm"), (2, "日本の城と庭園"), (3, "ab"), (4, "xxabcdefghxx")]
    names = ["abcdefghi", "abcdefgh", "城", "庭園", "ab", "zz", "bcd"]
    t = spark.createDataFrame(texts, "k int, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r["k"], r["name"]) for r in contains_join(t, n, "k", "text", "name").collect()}
    assert got == {(k, x) for k, s in texts for x in names if x in s}


def test_prefix_sum_and_percentiles(spark):
    rng = random.Random(2)
    rows = [("g%d" % (i % 3), float(rng.randint(0, 40))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    run = stats.prefix_sum(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g", "v"], "n", "c").orderBy("g", "v").collect()
    total = 0
    for r in run:
        total += r["n"]
        assert r["c"] == total
    for rule, pos in (("rounded", lambda n, p: int(round(p * (n - 1)))), ("floor", lambda n, p: min(n - 1, int(n * p)))):
        got = {(r["g"], r["share"]): r["value"] for r in stats.percentiles(df, ["g"], "v", [0.1, 0.5, 0.9], rule).collect()}
        for g in ("g0", "g1", "g2"):
            xs = sorted(v for k, v in rows if k == g)
            for p in (0.1, 0.5, 0.9):
                assert got[(g, p)] == xs[pos(len(xs), p)]


def test_result_quality_counts_short_and_disorder(spark):
    rows = [([1, 2, 3], [1, 2, 3], [0.1, 0.2, 0.3]), ([1, 2, 3], [2, 1], [0.3, 0.2])]
    df = spark.createDataFrame(rows, "t array<int>, g array<int>, d array<double>")
    r = relevance.result_quality(df, [], "t", "g", "d", 3).first()
    assert (round(r["recall"], 6), r["top1"], r["ordered"], r["short"]) == (round((1 + 2 / 3) / 2, 6), 0.5, 0.5, 0.5)


def test_plans_have_no_nested_loops(spark):
    """Search and spatial joins plan to equi-joins."""
    pts = spark.range(10).select(F.col("id").alias("pid"), (139.5 + F.col("id") * 0.001).alias("lon"), F.lit(35.4).alias("lat"))
    anc = pts.select(F.col("pid").alias("aid"), "lon", "lat")
    plan = spatial.within_distance(pts, anc, 500.0, "pid")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_chain_vectors_equal_vectors_of_chain_texts(spark):
    """Blank, null and one-letter posts, deep chains, several conversations: as if every chain's text were joined."""
    rng = random.Random(6)
    rows, whole = [], {}
    for conv in ("c", "d"):
        for i in range(40):
            text = rng.choice([None, "", "  ", "a", "駅", "ab c", "  x", "北口 から", "zz", "long post " * 5])
            parent = None if i == 0 or rng.random() < 0.15 else rng.choice([i - 1, i - 1, rng.randrange(i)])
            rows.append((conv, f"p{i}", i, [] if parent is None else [f"p{parent}", "gone"], text))
            whole[conv, i] = whole.get((conv, parent), "") + " " + (text or "")
    posts = spark.createDataFrame(rows, "conv string, post_id string, seq int, reply_to array<string>, text string")
    got = {(r.conv, r.post_id): r.embedding for r in vectors.chain_vectors(posts).collect()}
    want = bigram_matrix(list(whole.values()))
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert len(got) == len(rows)
    for (conv, i), v in zip(whole, want, strict=True):
        assert np.allclose(got[conv, f"p{i}"], v, atol=1e-12), (conv, i)
    assert vectors.chain_vectors(posts.limit(0)).count() == 0
