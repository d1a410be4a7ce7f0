"""Ids of packed documents: merged in numpy, the same as the tokenizer's own."""

from __future__ import annotations

import random

import numpy as np

from stopover.llm import packing, queries

LETTERS = ["a", "aa", "b", "'s", "'re", "'", " ", "  ", "\n", "\x1c", "\x85", "é", "漢字", "1", "½", "22", "!!!", "<|endoftext|>", "　", "😀", "the", " ing", "'ll" * 3, "e" * 70]


def _same(words, texts):
    ids, ends = words.encode(texts)
    want = [e.ids for e in words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want


def test_ids_are_the_tokenizers():
    words, draw = packing._Words(queries.tokenizer_path()), random.Random(3)
    assert words.merges is not None
    _same(words, ["".join(draw.choices(LETTERS, k=draw.randint(0, 25))) for _ in range(2000)] + ["", "'", "x" * 5000, "aaaaaaa", "", "it's", "'"])
    _same(words, [])
    _same(words, ["", ""])


def test_pre_tokens_do_not_go_to_the_library_one_by_one(monkeypatch):
    words, sent = packing._Words(queries.tokenizer_path()), []
    library = packing._Words._by_library
    monkeypatch.setattr(packing._Words, "_by_library", lambda self, texts: sent.extend(texts) or library(self, texts))
    words.encode([f"word{k} and another{k * 7919}" for k in range(500)])
    assert not sent


def test_equal_hashes_are_told_apart(monkeypatch):
    words = packing._Words(queries.tokenizer_path())
    monkeypatch.setattr(packing, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    _same(words, ["one two three", "four four"])


def test_other_vocabularies_go_to_the_library():
    words = packing._Words(queries.tokenizer_path())
    words.merges = None
    _same(words, ["it's a <|endoftext|> text", "", "漢字"])
