"""Centroid clustering and vector codes against plain Python, with missing, broken, tied and repeated vectors."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from stopover.llm import centroids, codes
from stopover.llm.codes import Balls, squared

KIND = "vec_id long, embedding array<float>, label int, cluster string, id string, v int"


def _kept(rows, dims=None):
    out = []
    for row in rows:
        e = row[1]
        if e and (dims is None or len(e) == dims) and all(x is not None and math.isfinite(x) for x in e):
            out.append((row[0], [math.floor(1024 * float(np.float32(x))) for x in e], row[2]))
    return out


def _nearest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(entries))


def _move(parts, found, entries):
    held = defaultdict(list)
    for v, (_, j) in zip(parts, found):
        held[j].append(v)
    return [[sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else c for j, c in enumerate(entries)]


def brute_clusters(rows, k, rounds, dims):
    kept = _kept(rows, dims)
    ranked = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    entries = [r[1] for r in ranked[:k]]
    vectors = [r[1] for r in kept]
    for _ in range(rounds):
        entries = _move(vectors, [_nearest(v, entries) for v in vectors], entries)
    found = [_nearest(v, entries) for v in vectors]
    inertia = defaultdict(int)
    for d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in entries]
    return sorted(((r[0], j, d, inertia[j], sum(inertia.values()), sha[j]) for r, (d, j) in zip(kept, found)), key=repr)


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(_kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    length = len(kept[0][1])
    w = length // parts
    fit = [r for r in kept if len(r[1]) == length]
    cut = [[r[1][p * w : (p + 1) * w] for r in fit] for p in range(parts)]
    books = [x[:entries] for x in cut]
    for _ in range(rounds):
        books = [_move(x, [_nearest(v, b) for v in x], b) for x, b in zip(cut, books)]
    found = [[_nearest(v, b) for v in x] for x, b in zip(cut, books)]
    sha = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    coded = [(r[0], "".join(f"{found[p][i][1]:02x}" for p in range(parts)), sum(found[p][i][0] for p in range(parts)), r[2]) for i, r in enumerate(fit)]
    coded += [(r[0], None, None, r[2]) for r in kept if len(r[1]) != length]
    by = defaultdict(lambda: None)
    for _, _, e, label in coded:
        if e is not None:
            by[label] = (by[label] or 0) + e
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in coded), key=repr)


def _rows(dims, n=150, seed=3):
    rng = random.Random(seed)
    few = [[rng.choice([-0.25, 0.0, 0.125, 0.5]) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.choice([0, 0, 1 / 1024, -1 / 1024]) for x in rng.choice(few)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(900 + i, few[0], 7) for i in range(60)]  # copies
    rows += [rows[3], rows[3], (None, few[1], None), (None, few[2], 1)]  # repeated rows, missing ids
    nan, inf = float("nan"), float("inf")
    rows += [(700, None, 1), (701, [], 1), (702, [None] + few[0][1:], 1), (703, [nan] + few[0][1:], 1), (704, [-inf] + few[0][1:], 1)]
    return [(*r, "x", "y", 5) for r in rows]


def test_clusters_equal_plain_python(spark):
    rows = _rows(8) + [(800, [0.5] * 7, 1, "x", "y", 5), (801, [0.5] * 9, 1, "x", "y", 5)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, KIND), k=8, rounds=10, dims=8)
    want = brute_clusters(rows, 8, 10, 8)
    assert sorted((tuple(r) for r in got.drop("n_compared").collect()), key=repr) == want and len(want) == 214


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = _rows(8, n=0)[-9:-7] + [(5, [0.1] * 8, 1, "x", "y", 5)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, KIND), dims=8).drop("n_compared")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, 8, 10, 8)
    none = centroids.cluster_vectors(spark.createDataFrame([], KIND), dims=8)
    assert none.collect() == [] and none.columns == got.columns[:3] + ["n_compared"] + got.columns[3:]


def test_threshold_walk_stops_early_and_keeps_ties():
    rng = np.random.default_rng(4)
    for spread, dims, k in ((3, 3, 40), (1000, 2, 300), (2, 6, 20)):
        x, c = rng.integers(-spread, spread, (500, dims)), rng.integers(-spread, spread, (k, dims))
        number, best, compared = centroids.SortedLists(c).nearest(x)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == every.argmin(1)).all() and (best == every.min(1)).all()
        if spread == 1000:
            assert compared.mean() < k / 4  # most centroids are never compared


def test_codes_equal_plain_python(spark):
    rows = _rows(8) + [(800, [0.5] * 12, 9, "x", "y", 5)]
    got = codes.compress_vectors(spark.createDataFrame(rows, KIND), parts=4, entries=40, rounds=4)
    want = brute_codes(rows, 4, 40, 4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert ("(800, None, None, None, " in str(want)) and len(want) == 215


def test_codes_of_few_and_no_vectors_and_uneven_parts(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)  # labels joined by a shuffle
    rows = _rows(8, n=5)[:5]
    got = codes.compress_vectors(spark.createDataFrame(rows, KIND))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(rows, 4, 256, 4)
    none = codes.compress_vectors(spark.createDataFrame([], KIND))
    assert none.collect() == [] and none.columns == got.columns
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress_vectors(spark.createDataFrame(rows, KIND), parts=3)


def test_rings_leave_out_what_cannot_be_nearer():
    rng = np.random.default_rng(6)
    near = rng.integers(-20, 20, (2000, 2)) + rng.choice([0, 400, 800, 1200], (2000, 2))
    entries = near[:60].copy()
    code, error = Balls(entries).search(near)
    moved = np.array([near[code == j].mean(0).astype(int) if (code == j).any() else e for j, e in enumerate(entries)])
    reach = np.array([codes._ceil_root(error[code == j].max(initial=0)) + codes._ceil_root(squared(entries[j][None], moved[j][None])[0]) if (code == j).any() else -1 for j in range(60)])
    code, error, compared = Balls(moved, reach).move(near, code)
    every = ((near[:, None] - moved[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (error == every.min(1)).all()
    assert compared < len(near) * 12  # of 60 entries


def test_components_beyond_the_range_are_an_error(spark):
    big = spark.createDataFrame([(1, [3e7] * 8, 1, "x", "y", 5)], KIND)
    with pytest.raises(Exception, match="2\\^27"):
        centroids.cluster_vectors(big, dims=8)
