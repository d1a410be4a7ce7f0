"""Streams give the batch result, also when a batch runs again; readers take the odd forms."""

import json

from pyspark.sql import functions as F

from stopover.functions import text as T
from stopover.operators import timetable
from stopover.sources import incremental, readers, writers
from stopover.streaming import texts as texts_stream
from stopover.streaming import versions


def test_text_stream_encodes_changes_only(spark, tmp_path):
    schema = "id long, source_text string, seq int"
    src, root, check = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.json(src)
    stream = spark.readStream.schema(schema).json(src)
    texts_stream.embed_stream(stream, root, check, ["id"], "seq").awaitTermination()
    spark.createDataFrame([(1, "a", 2), (2, "b2", 2), (3, "c", 2)], schema).write.mode("append").json(src)
    texts_stream.embed_stream(stream, root, check, ["id"], "seq").awaitTermination()
    v = versions.latest(spark, root)
    got = {r["id"]: r["source_text"] for r in versions.read(spark, root, v).collect()}
    assert v == 2 and got == {1: "a", 2: "b2", 3: "c"}


def test_upsert_can_keep_the_stored_row(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert {tuple(r) for r in incremental.upsert(old, new, ["id"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert {tuple(r) for r in incremental.upsert(old, new, ["id"], []).collect()} == {(1, "x"), (2, "y"), (3, "w")}


def test_normalise_and_grams(spark):
    df = spark.createDataFrame([("Ａｂ Ｃ", "日本 語"), ("ｶﾞ", "x")], "a string, b string")
    r = df.select(T.normalize_name(F.col("a")).alias("n"), T.char_bigrams(F.col("b")).alias("g")).collect()
    assert [x["n"] for x in r] == ["abc", "ガ"]
    assert [x["g"] for x in r] == [["日本", "本語"], ["x"]]


def test_feature_collection_and_bad_geometry(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"N02_001": "11", "N02_002": "2", "N02_003": "L", "N02_004": "O"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}},
    ]}
    p = tmp_path / "a.geojson"
    p.write_text(json.dumps(doc))
    got = readers.rail_features(readers.read_feature_collection(spark, str(p)), stations=False).first()
    assert got["line_name"] == "L" and got["line"][1]["lat"] == 4.0
    empty = spark.createDataFrame([], "n int, lon double, lat double")
    out = writers.feature_collection(empty, writers.feature({"n": F.col("n")}, writers.point_geometry(F.col("lon"), F.col("lat"))), [F.col("n")])
    assert json.loads(out.first()["collection"])["features"] == []


def test_conversation_document(spark, tmp_path):
    doc = {"posts": [
        {"id": "P1", "author": "a", "reply_to": None, "text": "x", "topics": ["T1"]},
        {"id": "P2", "author": "b", "reply_to": "P1", "text": "y", "topics": [], "day": 2},
        {"id": "P3", "author": "b", "reply_to": ["P1", "P2"], "text": "z", "topics": []},
        {"id": "P4", "author": "b", "text": "new", "new_thread": True},
    ]}
    p = tmp_path / "talk.json"
    p.write_text(json.dumps(doc))
    rows = readers.read_conversations(spark, str(p)).orderBy("seq").collect()
    assert [(r["post_id"], r["day"], r["reply_to"]) for r in rows] == [("P1", 1, []), ("P2", 2, ["P1"]), ("P3", 1, ["P1", "P2"])]
    assert rows[0]["conv"] == "talk"


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("問いID,判定\nq1,2\nq2,\n", encoding="utf-8-sig")
    got = readers.read_csv(spark, str(p), "問いID string, 判定 int").collect()
    assert [tuple(r) for r in got] == [("q1", 2), ("q2", None)]


def test_trails_cover_a_branching_line(spark):
    """A stem with two branches: every edge once, trails start at dead ends, the longer branch is followed."""
    e = [(1, 1, 1, 2, 1.0, "A"), (1, 2, 2, 3, 1.0, None), (1, 3, 3, 4, 1.0, "B"), (1, 4, 3, 5, 5.0, None), (1, 5, 5, 6, 5.0, "C")]
    df = spark.createDataFrame(e, "line_id long, edge_id long, source long, target long, cost double, group_code string")
    rows = timetable.cover_trails(df).orderBy("trail", "pos").collect()
    assert sorted(r["edge_id"] for r in rows) == [1, 2, 3, 4, 5]
    first = [r["edge_id"] for r in rows if r["trail"] == 1]
    assert first == [1, 2, 4, 5]
    second = [r for r in rows if r["trail"] == 2]
    # The short branch starts at its dead end and meets A (2 + half of 1) before C's far platform.
    assert [r["edge_id"] for r in second] == [3] and second[0]["tail_group"] == "A" and second[0]["tail_cost"] == 1.5


def test_trails_over_forks_and_rings(spark):
    """Every edge lies on one trail, trails hang together, and their number is the least that odd nodes allow."""
    pairs = [(1, 2), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (5, 7), (10, 11), (11, 12), (12, 10), (20, 20), (30, 31), (30, 31)]
    e = [(7, i, a, b, float(i + 1), "S" if i == 5 else None) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(e, "line_id long, edge_id long, source long, target long, cost double, group_code string")
    rows = timetable.cover_trails(df).orderBy("trail", "pos").collect()
    assert sorted(r["edge_id"] for r in rows) == list(range(len(pairs)))
    for x, y in zip(rows, rows[1:]):
        assert x["trail"] != y["trail"] or x["target"] == y["source"]
    for r in rows:
        assert {r["source"], r["target"]} == set(pairs[r["edge_id"]]) and r["cost"] == r["edge_id"] + 1.0
    odd = [n for n in {n for p in pairs for n in p} if sum((a == n) + (b == n) for a, b in pairs) % 2]
    assert len({r["trail"] for r in rows}) == len(odd) // 2 + 3  # and one for each ring apart
    assert rows[0]["source"] == 1
    # The stretch left between the forks 2 and 4: over 3, 4 and 5 to the middle of the platform, and over 5.
    short = next(r for r in rows if r["edge_id"] == 3)
    assert (short["head_group"], short["head_cost"], short["tail_group"], short["tail_cost"]) == ("S", 13.0, "S", 8.0)


def test_runs_are_split_and_short_ones_dropped(spark):
    df = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([True, True, False, True, False, True, True, True])], "k int, at int, ok boolean")
    got = timetable.split_runs(df, ["k"], "at", "ok").orderBy("at").collect()
    assert [r["at"] for r in got] == [0, 1, 5, 6, 7]
