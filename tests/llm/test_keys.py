"""Rows without an id, or with different texts under one id, lose only what their own text repeats."""

import hashlib
import random

import brute
import pytest

from stopover.llm import passages, suffixes


@pytest.fixture(scope="module", params=["null ids", "one id, several texts"])
def texts(request):
    rng = random.Random(5)
    new = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    a, b, c = new(120), new(120), new(120)
    again = 9 if request.param != "null ids" else None
    return [(1, a), (2, new(90) + " " + b), (again, a), (again, new(150)), (again, new(60) + " " + b + " " + new(20)), (again, c + " " + new(30)), (again, new(40) + " " + c), (3, None), (again, None)]


def removed(docs):
    """What the passages contract says, ids (null: largest) compared only with smaller ones."""
    order = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in docs:
        w = brute.blank_words(t)
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), order(d)), order(d))
    for d, t in docs:
        w = brute.blank_words(t)
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < order(d) for j in range(13)}
        yield d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_passages(spark, texts):
    got = passages.drop_repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, removed(texts)))


def test_suffixes(spark, texts):
    got = suffixes.drop_repeated_strings(spark.createDataFrame(texts, "doc_id long, text string"))
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.substrings(texts)))
