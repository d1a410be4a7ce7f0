"""The registered queries over whole small tables against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import brute

from stopover.llm import packing, queries
from stopover.llm.common import table


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: r[0])


def test_op1(spark, sf):
    pages = [(r.page_id, (r.html or "").encode()) for r in table(spark, sf, "pages").collect()]
    first = defaultdict(list)
    for p, html in pages:
        first[html].append(p)
    want = []
    for p, html in pages:
        top = max(first[html])
        again = len(html) >= 1000 and p != top
        want.append((p, len(html), hashlib.sha1(html).hexdigest(), "revisit" if again else "response", top if again else None))
    assert rows(queries.op1_warc(spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want)


def test_op2(spark, sf, docs):
    got = queries.op2_packing(spark, sf).toPandas()
    words = packing._encoder(queries.tokenizer_path())
    import zlib

    pieces = {(r.doc_id, r.piece): r for r in got.itertuples()}
    assert len(pieces) == len(got)
    total = 0
    for doc, text in docs:
        ids = np.array(words.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        at = k = 0
        while at < len(ids):
            r = pieces.pop((doc, k))
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == min(2048, len(ids)) or k == 0 and len(ids) > 2048
            at, k = at + r.length, k + 1
    assert not pieces
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 2048 and (s.offset == s.length.cumsum() - s.length).all()
    assert got.sequence_id.nunique() <= -(-total // 2048) * 1.02 + 1


def test_op3(spark, sf, docs):
    got = rows(queries.op3_licenses(spark, sf), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted((d, *brute.licenses(t)) for d, t in docs)


def test_op4(spark, sf, docs):
    got = rows(queries.op4_passages(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.passages(docs))
    assert any(r[2] for r in got)


def test_op5(spark, sf, docs):
    got = rows(queries.op5_suffixes(spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.substrings(docs))
    assert any(r[2] for r in got)


def test_op6(spark, sf, docs):
    got = rows(queries.op6_quality(spark, sf), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted((d, *brute.quality(t)) for d, t in docs)


def test_op7(spark, sf, docs):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = rows(queries.op7_decontaminate(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.hits(docs, items))
    assert any(r[2] for r in got)


def test_op8(spark, sf, docs):
    got = rows(queries.op8_minhash(spark, sf), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_groups(docs))


def test_op9(spark, sf):
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = queries.op9_language(spark, sf).collect()
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(lang) and sum(right) >= 0.9 * len(right)


def test_op10(spark, sf):
    pages = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    for r in queries.op10_urls(spark, sf).collect():
        host, path, rule, verdict = brute.url(pages.pop(r.page_id))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict is None or r.verdict == verdict
    assert not pages
