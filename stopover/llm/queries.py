"""Registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopover.llm import centroids, codes, decontaminate, language, licenses, minhash, packing, passages, quality, sql, suffixes, token_counts, urls, warc
from stopover.llm.common import table
from stopover.session import ensure_checkpoint_dir

BASE_RULES = [
    ("com/", "allow", 1),
    ("example.com/en/", "block", 1),
    ("www.example.com/en/", "allow", 1),
    ("net/es/", "block", 1),
    ("net/fr/", "block", 1),
]
# Rules of the method, under the fixed ones: hosts named after spam.
OWN_RULES = [("spam-farm.*", "block", 0), ("cheap-pills.*", "block", 0)]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; every executor has the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.drop_repeated_passages(table(spark, sf_dir, "documents"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.drop_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.drop("text_key")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("component_set", "text_key")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(BASE_RULES + OWN_RULES, "rule string, verdict string, rank int")
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select(
        "page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("n_compared")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache of this call's own, so that every call does the whole work."""
    ensure_checkpoint_dir(spark)
    cache = f"{spark.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), cache)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_passages": op4_passages,
    "op5_suffixes": op5_suffixes,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_minhash": op8_minhash,
    "op9_language": op9_language,
    "op10_urls": op10_urls,
    "op11_centroids": op11_centroids,
    "op12_codes": op12_codes,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {
    "op11_centroids": sql.centroid_sql(),
    "op12_codes": sql.code_sql(),
}
