"""Token counts against the libraries themselves, and what the cache stores and encodes."""

import sentencepiece
import tokenizers

from stopover.llm import token_counts
from stopover.llm.queries import tokenizer_path

TEXTS = ["", " ", "two  blanks ", "<s> hi </s> <|endoftext|>", "a\tb\x00c\n\n", "ﬁ Å 日本語 \U0001f600", "word " * 30_000, "same", "same", None, None]


def _want(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    model = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def _frame(spark, texts):
    rows = [(None if i == 3 else i // 2, t, 7, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, content_digest string, n_bytes int")


def _expected(df, count):
    rows = [(r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or "")) for r in df.collect()]
    return sorted(((i, b, n, n > 4096) for i, b, n in rows), key=repr)


def test_counts_equal_the_libraries(spark, tmp_path):
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        path, docs = tokenizer_path(name), _frame(spark, TEXTS)
        got = token_counts.count_tokens(docs, path, str(tmp_path / "cache"))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(docs, _want(path))


def test_only_missing_texts_are_encoded_and_stored(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    version = token_counts.tokenizer_digest(path)
    token_counts.count_tokens(_frame(spark, TEXTS[:6]), path, cache).collect()
    assert token_counts.read_cache(spark, cache, version).count() == 6
    token_counts.count_tokens(_frame(spark, TEXTS[:6]), path, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 6  # nothing was encoded twice
    # A stored count is what the documents get: a marked one shows up instead of a new one.
    marked = stored.where("n_tokens = 0").selectExpr("content_digest", "99L as n_tokens", "tokenizer_digest")
    other = str(tmp_path / "other")
    marked.write.partitionBy("tokenizer_digest").parquet(other)
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", 0)  # missing digests joined by a shuffle
    got = {r["n_bytes"]: r["n_tokens"] for r in token_counts.count_tokens(_frame(spark, TEXTS), path, other).collect()}
    assert got[0] == 99 and got[4] == _want(path)("same") and spark.read.parquet(other).count() == 8


def test_another_tokenizer_has_its_own_counts(spark, tmp_path):
    cache, docs = str(tmp_path / "cache"), _frame(spark, TEXTS[:5])
    a, b = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
    token_counts.count_tokens(docs, a, cache).collect()
    got = token_counts.count_tokens(docs, b, cache)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(docs, _want(b))


def test_repeated_entries_and_empty_tables(spark, tmp_path):
    path, cache = tokenizer_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    docs = _frame(spark, TEXTS)
    assert token_counts.count_tokens(docs.limit(0), path, cache).collect() == []
    token_counts.count_tokens(docs, path, cache).collect()
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)  # as two jobs at once leave it
    got = token_counts.count_tokens(docs, path, cache)
    assert got.count() == len(TEXTS)
