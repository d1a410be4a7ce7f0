"""Incremental maintenance: upserts, change detection by hash, caches and resumable lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.functions.text import content_hash


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Merge ``changes`` into ``current`` by key.

    ``update`` lists the columns a match overwrites: all by default, none (``[]``) keeps
    the stored row. Changes must be unique on the key.
    """
    others = [c for c in current.columns if c not in keys]
    update = others if update is None else update
    a = current.select(*keys, F.struct(*others).alias("_old"))
    b = changes.select(*keys, F.struct(*others).alias("_new"))

    def pick(c: str) -> Column:
        new_wins = F.col("_old").isNull() | (F.col("_new").isNotNull() if c in update else F.lit(False))
        return F.when(new_wins, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)

    return a.join(b, keys, "full").select(*keys, *[pick(c) for c in others]).select(*current.columns)


def changed_texts(texts: DataFrame, stored: DataFrame, keys: list[str], text: str = "source_text") -> DataFrame:
    """Rows whose text is new or whose hash differs from the stored one, with the new hash."""
    hashed = texts.withColumn("content_hash", content_hash(F.col(text)))
    old = stored.select(*keys, F.col("content_hash").alias("_old_hash"))
    return (
        hashed.join(old, keys, "left")
        .where(~F.col("content_hash").eqNullSafe(F.col("_old_hash")))
        .drop("_old_hash")
    )


def embed_missing(
    texts: DataFrame, cache: DataFrame, text: str, encoder: Callable[[Column], Column], digits: int = 20
) -> DataFrame:
    """Cache extended by the vectors of texts it lacks, keyed by a hash of the text.

    Each distinct text is encoded once, however many copies the table holds.
    """
    keyed = texts.select(content_hash(F.col(text), digits).alias("text_key"), F.col(text).alias("_text"))
    distinct = keyed.groupBy("text_key").agg(F.first("_text").alias("_text"))
    missing = distinct.join(cache.select("text_key"), "text_key", "left_anti")
    return cache.select("text_key", "embedding").unionByName(
        missing.select("text_key", encoder(F.col("_text")).alias("embedding"))
    )


def fetch_list(found: DataFrame, have: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Ids still to fetch, each once, in first-found order, at most ``limit`` per run."""
    first = found.groupBy(key).agg(F.min(order).alias(order))
    return first.join(have.select(key), key, "left_anti").orderBy(order, key).limit(limit)


def reaggregate_runs(runs: DataFrame, k: int, truth_condition: str = "exact") -> DataFrame:
    """Quality of every stored run against the first exact run of the same size and query.

    ``runs``: size, cond, run, query, ids (ordered array), dists.
    """
    truth = (
        runs.where(F.col("cond") == truth_condition)
        .groupBy("size", "query")
        .agg(F.min_by("ids", "run").alias("truth"))
    )
    joined = runs.where(F.col("cond") != truth_condition).join(truth, ["size", "query"])
    from stopover.operators.relevance import result_quality

    return result_quality(joined, ["size", "cond"], "truth", "ids", "dists", k)
