"""Language identification on small tables: rare languages, copies, odd rows."""

import random
import zlib

from stopover.llm import language

SHAPE = "doc_id long, text string, lang string, w string, o long, r int"


def table_of(spark, rows):
    return spark.createDataFrame([(d, t, g, "w", 1, 1) for d, t, g in rows], SHAPE)


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def test_a_rare_language_beside_copies(spark):
    """One language has 12 of 4,000 rows, and half of all rows are copies of one text; the sample is far smaller than either."""
    rng = random.Random(2)
    write = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(12))
    copy = write("abcdef")
    texts = [(copy, "aa")] * 2000 + [(write("abcdef"), "aa") for _ in range(988)] + [(write("ghijkl"), "bb") for _ in range(1000)] + [(write("mnopqr"), "cc") for _ in range(12)]
    rows = [(i, t, g) for i, (t, g) in enumerate(texts)]
    documents = table_of(spark, rows)
    model = language.fit(documents, sample_docs=60, language_docs=20)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.identify(documents, model).collect()}
    assert len(got) == len(rows)
    assert all(got[d].held_out == held(d) and 0 <= got[d].score <= 1 for d, _, _ in rows)
    for g in ("aa", "bb", "cc"):
        mine = [got[d].lang_pred == g for d, _, x in rows if x == g and held(d)]
        assert mine and sum(mine) >= 0.9 * len(mine)


def test_drawn_texts_are_distinct_and_bounded(spark):
    rows = table_of(spark, [(i, f"text {i % 300}", "aa") for i in range(900)] + [(i, f"other {i}", "bb") for i in range(5)])
    drawn = language._drawn(rows.select("text", "lang"), 80, 10).collect()
    assert sorted(r.r for r in drawn if r.lang == "aa") == list(range(1, 41)) and sum(r.lang == "bb" for r in drawn) == 5
    assert len({(r.o, r.lang) for r in drawn}) == len(drawn)


def test_odd_rows(spark):
    """Null, empty and letterless texts are und; missing ids count as not held out; very long and repeated texts pass."""
    rows = [(0, "abc abd abe " * 20, "aa"), (2, "xyz xyw xyv " * 20, "bb"), (3, None, "aa"), (4, "", None), (5, "12 34", "aa"),
            (None, "abc abe", None), (7, "xyv xyz " * 20000, None), (7, "xyv xyz " * 20000, None)]
    got = language.identify(table_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (d, t, _) in zip(got, rows, strict=True):
        assert r.doc_id == d and r.held_out == (d is not None and held(d))
        if not t or t == "12 34":
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_nothing_to_learn_and_empty(spark):
    assert [tuple(r) for r in language.identify(table_of(spark, [(0, "abc", None)])).collect()] == [(0, held(0), "und", 0.0)]
    assert language.identify(table_of(spark, [])).count() == 0
