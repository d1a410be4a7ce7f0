"""The stages of the pipeline, each against plain Python on its own input."""

import random

import brute
import corpus_pipeline as pipeline

from stopover.llm.common import table


def test_stages(spark, sf):
    assert [name.split("_")[0] for name, _ in pipeline.STAGES] == ["quality", "minhash", "suffix", "benchmark", "best"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = [docs.cache()]
    for _, stage in pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], sf).cache())
        assert seen[-1].columns == columns
    before = [[(r.doc_id, r.text) for r in x.collect()] for x in seen]
    assert {d for d, _ in before[1]} <= {d for d, t in before[0] if not brute.quality(t)[-1]}
    assert {d for d, _ in before[2]} == {r[0] for r in brute.near_groups(before[1]) if r[-1]}
    left = {r[0]: r[1] - r[2] for r in brute.substrings(before[2], pipeline.PASSAGE_BYTES)}
    assert all(left[d] - 3 * 50 <= len(t.encode()) <= left[d] for d, t in before[3]) and len(before[3]) == len(before[2])
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert {d for d, _ in before[4]} == {r[0] for r in brute.hits(before[3], items) if not r[-1]}
    packed = pipeline.STAGES[-1][1](spark, seen[-1], sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in before[4]}


def test_run_of_two_stages(spark, sf, monkeypatch):
    monkeypatch.setattr(pipeline, "STAGES", [pipeline.STAGES[0], pipeline.STAGES[-1]])
    kept = pipeline.quality_stage(spark, table(spark, sf, "documents"), sf)
    assert pipeline.run(spark, sf).select("doc_id").distinct().count() == kept.count()


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, w string, kept string, score string, n_words int, doc int, spans string, _row int, id string, s1 int, key string, text_key int"


def _rows(texts):
    return [(i, t, "en", "s", len(t or ""), "w", "kept", "score", 5, 6, "spans", 7, "id", 8, "key", 9) for i, t in texts]


def test_odd_rows_and_clashing_columns(spark, sf):
    rng = random.Random(2)
    words = [w for r in table(spark, sf, "documents").where("lang = 'en' and n_chars between 300 and 900").limit(40).collect() for w in r.text.split()]
    new = lambda n: " ".join(rng.sample(words, n))
    passage, a, b, c = new(60), new(120), new(130), new(140)
    texts = [(1, a), (1, b), (1, a), (None, c), (None, c), (None, a), (2, None), (3, ""), (4, new(100) + " " + passage), (5, new(90) + " " + passage + " " + new(20))]
    docs = spark.createDataFrame(_rows(texts), CLASHING)
    kept = pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} <= {5} and kept.where("text is null or text = ''").isEmpty()
    near = pipeline.near_duplicate_stage(spark, docs, sf)
    assert near.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted([*{(i, t) for i, t in texts if i is not None}, (None, c), (None, c), (None, a)], key=repr)
    apart = spark.createDataFrame(_rows([x for x in texts if x[0] not in (1, None)]), CLASHING)
    left = {r.doc_id: r for r in pipeline.suffix_stage(spark, apart, sf).collect()}
    assert left[4].spans == "spans" and left[4].doc == 6 and passage not in left[4].text and passage not in left[5].text
    assert all(left[i].text == texts[k][1] for i, k in ((3, 7),)) and left[4].n_chars == len(left[4].text) > 0
    clean = pipeline.decontamination_stage(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    packed = pipeline.packing_stage(spark, docs, sf)
    assert packed.where("doc_id is null").count() == 3 and packed.count() == len(texts)


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], CLASHING)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [c.split()[0] for c in CLASHING.split(", ")] and docs.isEmpty()
    assert pipeline.packing_stage(spark, docs, sf).isEmpty()
