"""Token counts through a cache keyed by digests of normalised content and of the tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib import metadata
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopover.llm.common import settle, steps
from stopover.session import skew_join

# Missing digests that are sent to every task (64 bytes each) so that texts already counted are not shuffled.
BROADCAST_MISSES = 50_000
CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer_digest string"


def null_as_empty(text: Column) -> Column:
    """The normalisation of the cache: a missing text counts as an empty one, nothing else is changed."""
    return F.coalesce(text, F.lit(""))


def library_of(path: str) -> str:
    if path.endswith(".model"):
        return "sentencepiece"
    if path.endswith(".json"):
        return "tokenizers"
    raise ValueError(f"no library for {path}: .json and .model files are known")


def tokenizer_digest(path: str) -> str:
    """Digest of what decides the counts: vocabulary file, library and its version."""
    library = library_of(path)
    return hashlib.sha256(f"{library} {metadata.version(library)}\n".encode() + Path(path).read_bytes()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of whole texts: no begin, end or added special tokens, no truncation, no padding."""
    if library_of(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in steps(batches):
            count = count or counter(path)
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(n, pa.int64())], names=["content_digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer: (content_digest, n_tokens), each digest once.

    Only that tokenizer's folder is read. Two jobs that met the same text at once may both have stored it, with the same count.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer_digest={version}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "content_digest binary, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == version)
    return stored.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, cache: str, limit: int = 4096, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = null_as_empty,
) -> DataFrame:
    """Tokens of every whole text: (key, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    ``cache``: folder that all executors reach; it may not exist yet. Rows get the digest (sha256) of their normalised
    content and meet stored counts by it and by the tokenizer's digest. Digests without a count are encoded once each,
    however many rows share them, and appended to the cache, so a second call over the same texts encodes nothing.
    ``normalise`` must not change a text's number of tokens. A null text counts as an empty one, 0 bytes and 0 tokens;
    repeated rows and ids, null ids too, keep their rows; an empty table gives none and adds nothing to the cache.
    Other columns are not read. A text is encoded whole, in one task; ``n_bytes`` is that of the given text in UTF-8.

    Copies meet map-side first: of a text that a third of the rows hold, each task sends one copy on.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    content = normalise(F.col("text"))
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    digest = F.unhex(F.sha2(F.encode(content, "UTF-8"), 256)).alias("content_digest")
    rows = settle(source.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest))
    stored = read_cache(spark, cache, version)
    missing = settle(rows.select("content_digest").distinct().join(stored, "content_digest", "left_anti"))
    n = missing.count()
    if n:
        texts = source.select(digest, content.alias("text"))
        few = n <= BROADCAST_MISSES
        if few:
            texts = texts.join(F.broadcast(missing), "content_digest", "left_semi")
        texts = texts.groupBy("content_digest").agg(F.first("text").alias("text"))
        if not few:
            texts = texts.join(missing, "content_digest", "left_semi")
        counted = texts.mapInArrow(_encode(path), "content_digest binary, n_tokens long")
        counted.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    stored = read_cache(spark, cache, version)
    found = skew_join(rows, stored, ["content_digest"], ["id", "n_bytes"], "left")
    return found.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
