"""Decontamination on small odd tables against plain Python."""

import brute
import pytest

from stopover.llm import decontaminate as D

DOCS = "doc_id long, text string, w string, _n long, h long, item_id string"
LONG = " ".join(f"word{i}" for i in range(3000))
ITEM = " ".join(f"Term{i}" for i in range(20))


def judge(spark, docs, items):
    documents = spark.createDataFrame([(d, t, "w", 1, 2, "x") for d, t in docs], DOCS)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in D.decontaminate(documents, benchmark).select(*cols).collect()), key=repr)


@pytest.mark.parametrize("many", [D.BROADCAST_WINDOWS, 0])
def test_odd_rows(spark, monkeypatch, many):
    """Null, empty and very long texts, repeated rows, shared and missing ids, short items, items repeated under one id."""
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", many)
    docs = [
        (1, None), (2, ""), (3, f"{LONG} {ITEM} {LONG}"), (4, ITEM.upper()), (4, "quite another text"), (None, ITEM), (None, "two words"),
        (5, "a short item stands here"), (5, "a short item stands here"), (6, ITEM.rsplit(" ", 8)[0]), (7, "one"), (8, " ".join([ITEM] * 3)),
    ]
    items = [("a", ITEM), ("a", ITEM), ("b", "short item"), ("c", "ONE"), ("d", None), ("e", ""), ("f", "Term1 Term2 Term3 never held"), (None, "two words")]
    want = sorted((r for r in brute.hits(docs, [(i, t) for i, t in items if i is not None])), key=repr)
    got = judge(spark, docs, items)
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(r[0], r[1], r[3], r[4]) for r in want]
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]


@pytest.mark.parametrize("docs, items", [([], [("a", ITEM)]), ([(1, ITEM)], []), ([], []), ([(1, ITEM), (2, None)], [("a", None)])])
def test_empty_tables(spark, docs, items):
    assert judge(spark, docs, items) == sorted(brute.hits(docs, items), key=repr)
