"""Rule signals of odd texts, and what their plan costs."""

from __future__ import annotations

import re

from stopover.llm import packing, quality

TEXTS = ["", " \t\n\x0b\f\r", "a b # $x\n\n \n\x0b\na b # $x\nz|<>&%*", "日本 語　x\n日本 語　x\n \n ", None, "#\r\n#\r\n# "]


def test_signals_of_odd_blanks(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    signals = quality.text_signals(docs)
    assert "translate(" not in signals._jdf.queryExecution().executedPlan().toString()  # costs a string for each character
    for r in signals.collect():
        text = TEXTS[r["doc_id"]] or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want, text


def test_a_worker_remembers_few_words():
    # Six workers of a 3 GB executor hold two generations each, about 200 bytes an entry.
    assert 6 * 2 * packing.REMEMBERED * 200 < 300_000_000
