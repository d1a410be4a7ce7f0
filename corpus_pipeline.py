"""Training corpus from raw documents: five stages, each over everything the one before kept.

Rows stay apart where they share an id with different texts, and where they have none; rows repeated in full count as one
from the second stage on. Null texts fail the first stage's base rules. An empty table passes all stages. Documents may
have any further columns, also of names that the stages use: a stage nests what it is given and returns it as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopover.llm import decontaminate, minhash, packing, quality, suffixes
from stopover.llm.common import table
from stopover.llm.queries import tokenizer_path
from stopover.session import ensure_checkpoint_dir

# Repeated strings of at least so many bytes go, from all places: passages of over 50 words have more, stock phrases fewer.
PASSAGE_BYTES = 200


def _nested(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row) with all columns of a row in ``_row``."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are not unlike the trusted ones; null and wordless texts go."""
    return quality.quality_rules(_nested(docs), table(spark, sf_dir, "labels")).where("kept").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the smallest id; rows without an id are in no group and all stay.

    Of several rows of that id in one group, the one with the smallest hash of its text stays.
    """
    judged = minhash.near_duplicates(docs).where("kept and doc_id is not null")
    chosen = judged.groupBy(F.col("doc_id").alias("_id"), "component_set").agg(F.min("text_key").alias("_key")).select("_id", "_key").distinct()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), F.struct(*docs.columns).alias("_row"))
    one = rows.join(chosen, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return one.select("_row.*").union(docs.where("doc_id is null"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of PASSAGE_BYTES that stand in several places: every copy goes, the first too."""
    left = suffixes.drop_repeated_strings(_nested(docs), PASSAGE_BYTES).withColumn("_chars", F.length("kept_text"))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.col("_chars").cast(docs.schema["n_chars"].dataType)
    return left.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage by the contamination rule."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key")).distinct()
    rows = _nested(docs)
    kept = rows.join(bad, rows["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(rows["text"]) == bad["_bad_key"]), "left_anti")
    return kept.select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

# The ratio of hashed n-grams, tokens and packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
