"""All trusted documents count, on both paths to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopover.llm import quality


def test_every_trusted_document_is_used(spark, monkeypatch):
    labels = spark.range(26_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    held = {r["_held"]: r["count"] for r in quality.trusted_ids(labels).groupBy("_held").count().collect()}
    assert sum(held.values()) == 26_000 and 4_000 < held[True] < 6_500

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id") % 40).alias("text"))
    some = labels.where("doc_id < 100")
    want = quality.fit_ratio(docs, some).first()
    monkeypatch.setattr(quality, "BROADCAST_TRUSTED", 10)
    assert quality.fit_ratio(docs, some).first() == want
