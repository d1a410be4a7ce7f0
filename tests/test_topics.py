"""Routers on short conversations worked through by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopover.functions.text import ngram_vector
from stopover.operators import routing, topics

POST = "conv long, seq int, post_id string, reply_to array<string>, text string, topics array<string>"


def _posts(spark, rows, conv=1):
    data = [(conv, i, f"P{i + 1}", r, t, g) for i, (t, r, g) in enumerate(rows)]
    return topics.prepare_posts(spark.createDataFrame(data, POST))


@pytest.fixture(scope="module")
def talk(spark):
    return _posts(spark, [
        ("公園の桜が咲いた", [], ["T1"]),
        ("桜なら公園の入口", ["P1"], ["T1"]),
        ("はい", ["P2"], ["T1"]),
        ("神社の祭りはいつですか", [], ["T2"]),
        ("祭りは来週の神社", ["P4"], ["T2"]),
        ("屋台どこ？", [], ["T2"]),
    ])


def _run(df):
    return {r["post_id"]: r for r in df.collect()}


def test_v1_pending_questions(talk):
    got = _run(topics.route_posts_v1(talk, branch_k=0))
    assert got["P1"]["assign"] == got["P2"]["assign"] == got["P3"]["assign"] == "t1"
    # The question waits; its answer opens a topic for both, and only the question is deferred.
    assert got["P4"]["assign"] == got["P5"]["assign"] == "t2"
    assert got["P4"]["deferred"] and not got["P5"]["deferred"]
    # A question nobody answered shares no noun and ends off topic.
    assert got["P6"]["assign"] == "OFF" and got["P6"]["deferred"]
    assert len(got) == 6


def test_v1_oracle_follows_gold(talk):
    got = _run(topics.route_posts_v1(talk, branch_k=0, oracle=True))
    assert got["P4"]["assign"] == got["P5"]["assign"] == got["P6"]["assign"]
    assert got["P4"]["deferred"] and got["P5"]["deferred"]


def test_v1_branch_on_fresh_nouns(talk):
    got = _run(topics.route_posts_v1(talk, branch_k=1))
    assert got["P2"]["deferred"] and got["P2"]["reason"] == "branch" and got["P2"]["assign"] == "t1"


def test_v2_tentative_topics(talk):
    got = _run(topics.route_posts_v2(talk, th_new=0.99, th_branch=0.0))
    assert got["P1"]["assign"] == got["P2"]["assign"] and not got["P1"]["deferred"]
    assert got["P4"]["assign"] == got["P5"]["assign"] and not got["P4"]["deferred"]
    assert got["P6"]["deferred"]  # alone at the end
    assert len(got) == 6


def test_concat_context_equals_embedding_of_joined_text(spark):
    rows = [("あいう", [], ["T"]), ("えお", [], ["T"]), ("か", [], ["T"])]
    posts = _posts(spark, rows).orderBy("seq").collect()
    t = routing.Contexts()
    for p in posts:
        t.add("T", p.asDict())
    want = topics.bigram_matrix(["。".join(r[0] for r in rows)])[0]
    assert abs(t.joined[0] - want).max() < 1e-12
    assert abs(t.likeness(routing.unit(want), "concat")["T"] - 1) < 1e-12


def test_conversations_are_independent(spark, talk):
    both = talk.unionByName(talk.withColumn("conv", F.lit(2).cast("long")))
    got = topics.route_posts_v1(both, branch_k=0).groupBy("conv").count().collect()
    assert {r["conv"]: r["count"] for r in got} == {1: 6, 2: 6}


def test_perfect_grouping_scores_one(spark):
    rows = [(1, i, f"P{i}", [], "x", [g], g) for i, g in enumerate("AABBB")]
    df = spark.createDataFrame(rows, POST + ", assign string")
    r = topics.bcubed(df, ["conv"]).first()
    assert (r["bp"], r["br"], r["bcubed"]) == (1.0, 1.0, 1.0)


def test_bcubed_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(1, i, f"P{i}", [], "x", rng.sample("ABC", rng.randint(0, 2)), rng.choice(["c1", "c2", "OFF"])) for i in range(60)]
    got = topics.bcubed(spark.createDataFrame(rows, POST + ", assign string"), ["conv"]).first()
    gold = [set(r[5]) or {"OFF"} for r in rows]
    bp = br = 0.0
    for i in range(60):
        sp = [j for j in range(60) if rows[j][6] == rows[i][6]]
        sg = [j for j in range(60) if gold[i] & gold[j]]
        both = sum(1 for j in sp if gold[i] & gold[j])
        bp, br = bp + both / len(sp), br + both / len(sg)
    assert abs(got["bp"] - bp / 60) < 1e-12 and abs(got["br"] - br / 60) < 1e-12


def test_chunks_resegment_and_refuse(spark):
    ids = lambda a, b: [f"P{i}" for i in range(a, b)]
    schema = "conv long, chunk int, kind string, post_ids array<string>, topics map<string,string>, assign map<string,string>"
    rows = [
        (1, 1, "chunk", ids(1, 11), {"A": "a"}, {i: "A" for i in ids(1, 11)}),
        (1, 2, "chunk", ids(11, 21), {"B": "b"}, {i: "B" for i in ids(11, 21)}),  # drops topic A
        (1, 3, "chunk", ids(11, 21), {"A": "a", "B": "b"}, {i: "B" for i in ids(11, 21)}),
        (1, 4, "reseg", ids(1, 21), {"Z": "z"}, {i: "Z" for i in ids(1, 21)}),
        (1, 5, "chunk", ids(11, 21), {"A": "a"}, {i: "A" for i in ids(11, 21)}),  # again: already merged
    ]
    merged = topics.merge_chunks(spark.createDataFrame(rows, schema))
    state = {r["chunk"]: (r["accepted"], r["problem"]) for r in merged.select("chunk", "accepted", "problem").distinct().collect()}
    assert state == {1: (True, None), 2: (False, "an earlier topic is missing"), 3: (True, None), 4: (True, None), 5: (False, "already merged")}
    assert {r["assign"] for r in topics.final_assignment(merged).collect()} == {"Z"}


def test_parse_conditions(spark):
    df = spark.createDataFrame([("p-m_seq10n_flow_reply",), ("p_api_object_noreply_r2",), ("odd_name",)], "condition string")
    got = {r["condition"]: (r["mode"], r["run"]) for r in topics.parse_conditions(df).collect()}
    assert got == {"p-m_seq10n_flow_reply": ("narrow", None), "p_api_object_noreply_r2": ("full", "r2")}


def test_ngram_vectors_keep_nulls_and_short_texts(spark):
    texts = ["ab ab", None, "", "a", "日本語"]
    got = {r.i: r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).select("i", ngram_vector("t").alias("v")).collect()}
    assert got[1] is None
    for i, grams in {0: ["ab", "ba", "ab"], 2: [""], 3: ["a"], 4: ["日本", "本語"]}.items():
        want = np.zeros(384)
        for g in grams:
            want[int.from_bytes(hashlib.md5(g.encode()).digest(), "big") % 384] += 1
        assert np.allclose(got[i], want / np.linalg.norm(want))
