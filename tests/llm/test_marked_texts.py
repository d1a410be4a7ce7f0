"""Texts that hold no shared anchor are left out before the shuffle."""

from __future__ import annotations

import random

from stopover.llm import passages


def test_texts_without_shared_anchors_stay(spark):
    draw = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(draw.choices("abcdefghij", k=20))) for i in range(400)], "doc_id long, text string")
    rows = passages._keyed(docs)
    wanted = rows.where("doc_id % 40 = 7").select("doc", "key")
    got = {r["doc_id"] for r in passages._marked(rows, wanted).collect()}
    assert {i for i in range(400) if i % 40 == 7} <= got and len(got) < 20
    assert passages._marked(rows, wanted.limit(0)).isEmpty()
    assert "Exchange hashpartitioning" not in passages._marked(rows, wanted)._jdf.queryExecution().executedPlan().toString()
