"""Change detection on a stream of texts: only new or edited texts are encoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopover.functions.text import ngram_vector
from stopover.sources.incremental import changed_texts, upsert
from stopover.streaming import versions


def embed_stream(texts: DataFrame, root: str, checkpoint: str, keys: list[str], order: str, encoder=ngram_vector, **trigger):
    """Keep the table below ``root`` at (keys, source_text, content_hash, embedding) of the latest texts.

    ``texts``: streaming keys, source_text and ``order``, by which the last of several texts of
    one key in a batch wins. A batch that runs again rewrites the same version.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = versions.latest(spark, root)
        if before is not None and before >= epoch + 1:
            return
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        now = batch.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*keys, "source_text")
        if before is None:
            stored = now.limit(0).withColumn("content_hash", F.lit("")).withColumn("embedding", F.array().cast("array<double>"))
        else:
            stored = versions.read(spark, root, before)
        changed = changed_texts(now, stored, keys).withColumn("embedding", encoder(F.col("source_text")))
        versions.write(upsert(stored, changed, keys), root, epoch + 1)

    return texts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
