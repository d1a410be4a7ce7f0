"""Questions of findings over two days: what they carry, what removes them."""

from stopover.operators import claims as C

MARK = C._MARK
CLAIM = f"conv string, id string, content string, kind string, src array<string>, day int, excluded {MARK}"
FIELDS = "content string, kind string, status string, related_places array<string>, aliases array<string>, claims array<string>"
FINDING = f"conv string, id string, {FIELDS}, day int, updated int, expired {MARK}"


def _delta(spark, **given):
    kinds = {
        "exclude": "conv string, id string, reason string", "add": f"conv string, pos int, id string, {FIELDS}", "update": f"conv string, id string, {FIELDS}",
        "expire": "conv string, id string, reason string", "ask": "conv string, pos int, about string, question string, type string, in_conversation boolean, question_src array<string>",
        "reask": "conv string, id string, question string, type string", "drop": "conv string, id string, reason string",
    }
    return {k: spark.createDataFrame(given.get(k, []), v) for k, v in kinds.items()}


def test_questions_keep_their_source(spark):
    finding = lambda i, c: ("a", 1, i, f"text {i}", "事実", None, None, None, c)
    state = {
        "claims": spark.createDataFrame([("a", "C1", "x", "k", ["P1", "P10", "P2"], 1, None), ("a", "C2", "y", "k", ["P3"], 1, None)], CLAIM),
        "findings": spark.createDataFrame([], FINDING),
        "questions": spark.createDataFrame([], f"conv string, id string, about string, question string, type string, day int, removed {MARK}"),
    }
    first = _delta(
        spark, add=[finding("N1", ["C1"]), ("a", 2, "N2", "text", "事実", None, None, None, ["C2"])],
        ask=[("a", 1, "N1", "why", "理由", True, ["P2"]), ("a", 2, "N2", "when", "条件", False, None), ("a", 3, "N1", "who", "範囲", None, ["P1"])],
    )
    state = C.apply_changes(state, first, 1)
    second = _delta(spark, exclude=[("a", "C2", "wrong")], reask=[("a", "Q1", "why so", None)], drop=[("a", "Q3", "old")])
    state = C.apply_changes(state, second, 2)
    findings, questions = C.finalise(state)
    assert [(r["id"], list(r["posts"])) for r in findings.collect()] == [("W1", ["P1", "P2", "P10"])]
    got = [(r["id"], r["about"], r["question"], r["type"], r["in_conversation"], r["question_src"]) for r in questions.collect()]
    assert got == [("Q1", "W1", "why so", "理由", True, ["P2"])]  # Q2's finding lost its only claim, Q3 was dropped
