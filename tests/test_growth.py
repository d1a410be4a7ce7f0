"""What grows with the input stays where it lies or is bounded for each task."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stopover.functions import text
from stopover.operators import graph, vectors


def test_ngram_weights_of_unique_keys_need_no_shuffle(spark):
    rows = [(1, "ab ab"), (2, "駅北口"), (3, None), (4, ""), (None, "lost")]
    got = vectors.ngram_weights(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.k for r in got.collect()} == {1, 2, 3, 4}
    assert [(r.bucket, r.weight) for r in got.where("k = 3").collect()] == [(None, 1.0)]


def test_ngram_weights_add_up_rows_of_one_key(spark, monkeypatch):
    rows = [(1, "ab ab"), (1, "日本語"), (1, None), (2, "x"), (2, "x"), (3, "plain"), (None, "a"), (None, "b"), (4, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    for few in (0, 10):
        monkeypatch.setattr(vectors, "BROADCAST_KEYS", few)
        got = {(r.k, r.bucket): r.weight for r in vectors.ngram_weights(df, "k", "t").collect()}
        want = {}
        for k in (1, 2, 3):
            v = text.bigram_matrix([t for key, t in rows if key == k and t is not None]).sum(axis=0)
            v = np.append(v, sum(t is None for key, t in rows if key == k))
            want |= {(k, int(i) if i < text.NGRAM_DIM else None): v[i] / np.sqrt((v * v).sum()) for i in np.flatnonzero(v)}
        want[4, None] = 1.0
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_seams_and_lengths_of_chains_are_computed_once_a_row(spark):
    posts = spark.createDataFrame([("c", "p0", 0, [], "ab"), ("c", "p1", 1, ["p0"], "cd")], "conv string, post_id string, seq int, reply_to array<string>, text string")
    plan = vectors.chain_vectors(posts)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"/ sqrt\(aggregate", plan, re.I) and not re.search(r"= CASE WHEN[^=]*md5", plan, re.I), plan


def test_exact_search_has_tasks_by_counts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SEARCH_ROWS", 30)
    queries = spark.createDataFrame([(i, f"red {'blue' if i % 2 else 'green'}") for i in range(100)], "qid long, text string")
    subjects = spark.createDataFrame([(1, "red"), (1, "blue"), (2, "green"), (3, "red")], "item_id long, normalized_name string")
    got = vectors.exact_search(queries, subjects)
    assert "hashpartitioning(qid" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 10)" in plan, plan
    rows = {(r.qid, r.rank): (r.item_id, r.score) for r in got.collect()}
    assert rows[1, 1] == (1, 2.0) and rows[1, 2] == (3, 1.0) and (1, 3) not in rows
    assert rows[2, 1] == (1, 1.0) and rows[2, 2] == (2, 1.0) and rows[2, 3] == (3, 1.0)


def test_a_batch_of_vectors_holds_one_step_beside_the_result():
    rng = random.Random(4)
    texts = pa.array([None if i % 9 == 0 else "".join(rng.choices("abc déf駅北口", k=2000)) for i in range(2000)])
    text.ngram_vector.func(texts[:50])
    tracemalloc.start()
    got = text.ngram_vector.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.null_count == texts.null_count
    assert peak < 2000 * text.NGRAM_DIM * 8 + 40 * 200_000 * 4
    want = text.bigram_matrix([t.as_py() for t in texts[1:9]])
    assert np.allclose(np.array(got[1:9].to_pylist()), want / np.linalg.norm(want, axis=1, keepdims=True))


def test_a_star_step_moves_its_edges_once_to_their_least_neighbours(spark):
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 50)], "u long, v long")
    try:
        found = []
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            joined = graph._with_min(edges)
            found.append(sorted(map(tuple, joined.collect())))
            if adaptive == "true":
                assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] == found[1] == [(i, i // 2, i // 2) for i in range(1, 50)]
