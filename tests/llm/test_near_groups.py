"""Near duplicates in large groups of copies that resemble each other more or less, against brute force."""

import random

import brute
import pytest

from stopover.llm import minhash

KIND = "doc_id long, text string, s1 string, id int, comp long, key string"


def _word(rng):
    return "".join(rng.choices("abcdefghij", k=6))


def _edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[_word(rng)], [], [out[at], _word(rng)]])
    return out


def _texts():
    rng = random.Random(8)
    out = []
    for size, length in ((120, 150), (60, 400), (8, 60)):
        base = [_word(rng) for _ in range(length)]
        other = _edited(rng, base, length // 30)  # a version of its own, with copies of its own
        for i in range(size):
            out.append(" ".join(_edited(rng, base if i % 3 else other, rng.choice([0, 1, length // 60, length // 30, length // 18, length // 10]))))
    out += [" ".join(_word(rng) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + out[:5]
    rng.shuffle(out)
    return out + ["", " \t", "One two", "one TWO", "a", "A"]


@pytest.fixture(scope="module")
def docs():
    return [(i * 7 % 1009 - 300, t) for i, t in enumerate(_texts())] + [(5000, None)]


@pytest.mark.parametrize("looks", [10**9, 1])
def test_groups_equal_brute_force(spark, docs, monkeypatch, looks):
    """By the join of differences in the first round, and after rounds of pivots."""
    monkeypatch.setattr(minhash, "LOOKS", looks)
    frame = spark.createDataFrame([(*d, "x", 1, 2, "k") for d in docs], KIND)
    got = minhash.near_duplicates(frame).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_groups(docs))
    assert 100 < len({r.component_id for r in got}) < 0.6 * len(docs)


def test_missing_and_shared_ids(spark):
    rng = random.Random(9)
    a, b, c = ([_word(rng) for _ in range(80)] for _ in range(3))
    near = lambda w: " ".join(_edited(rng, w, 1))
    rows = [(7, " ".join(a)), (7, " ".join(b)), (7, near(a)), (3, near(b)), (9, near(a)), (None, " ".join(a)), (None, " ".join(c)), (4, near(c)), (4, ""), (4, None), (7, " ".join(b))]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], KIND)).collect()
    found = sorted(((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in got), key=repr)
    want = [(7, True, 7, True), (7, True, 3, False), (7, True, 7, True), (3, True, 3, True), (9, True, 7, False), (None, True, None, True), (None, True, None, True), (4, True, 4, True), (4, False, 4, True), (4, False, 4, True), (7, True, 3, False)]
    assert found == sorted(want, key=repr)
    sevens = {r.component_set for r in got if r.doc_id == 7 and r.kept}
    assert len(sevens) == 1 and len({r.component_set for r in got if r.component_id == 3}) == 1


def test_empty_table(spark):
    got = minhash.near_duplicates(spark.createDataFrame([], KIND))
    assert got.collect() == [] and got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
