"""License scans: phrases word by word, and an exact containment join of lines and word windows with license templates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopover.llm.common import BREAKS, lower_ascii, settle, words
from stopover.session import skew_join

# Fixed values of the contract: phrase and label.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices as their licenses word them; the label is the method's own.
TEMPLATES = [
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "Released under the MIT License."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
]
THRESHOLD = 0.8


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Templates as a table: ``template`` number, ``label``, ``text``."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "template int, label string, text string")


def _stands(word: Column, parts: list[str]):
    return lambda i: reduce(and_, [word[i + j] == p for j, p in enumerate(parts)])


def phrase_places(word: Column, phrases: list[tuple[str, str]] = PHRASES) -> dict[str, Column]:
    """For each phrase the places in the word array (from 0) where its words stand consecutively."""
    out = {}
    for phrase, _ in phrases:
        parts = phrase.split(" ")
        n = len(parts)
        out[phrase] = F.when(F.size(word) >= n, F.filter(F.sequence(F.lit(0), F.size(word) - n), _stands(word, parts))).otherwise(F.array().cast("array<int>"))
    return out


def blocks(documents: DataFrame, wanted: list[str], lengths: list[int]) -> DataFrame:
    """Word lists of the blocks that hold a wanted word, as (doc_id, _key, length, block).

    Blocks are the lines of a text (length null) and, for each of ``lengths``, windows of twice so many words, one every
    ``length`` words, line ends or not: any ``length`` words in a row lie in one of them. Lower-cased.
    """
    known = F.array(*[F.lit(w) for w in wanted])
    sizes = F.array(*[F.lit(n) for n in lengths])
    text = lower_ascii(F.col("text"))
    rows = documents.select("doc_id", F.xxhash64("text").alias("_key"), text.alias("_text"), words(text, BREAKS).alias("_w")).where(F.arrays_overlap("_w", known))
    hits = F.filter(F.transform("_w", lambda w, i: F.when(F.array_contains(known, w), i)), lambda i: i.isNotNull())
    starts = "array_distinct(flatten(transform(_hits, i -> array(greatest(i div n - 1, 0), i div n))))"
    windows = f"flatten(transform(_sizes, n -> transform({starts}, k -> struct(n as length, slice(_w, cast(k * n + 1 as int), 2 * n) as block))))"
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda x: words(x, BREAKS)), lambda x: F.arrays_overlap(x, known))
    lines = F.transform(lines, lambda x: F.struct(F.lit(None).cast("int").alias("length"), x.alias("block")))
    every = rows.withColumns({"_hits": hits, "_sizes": sizes}).select("doc_id", "_key", F.explode(F.concat(lines, F.expr(windows))).alias("_b"))
    return every.select("doc_id", "_key", "_b.length", "_b.block")


def containment_join(documents: DataFrame, template: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every (doc_id, _key, template) with a block holding at least ``threshold`` of the template's distinct words.

    A block is a line, or a window of twice the template's words (see ``blocks``), so a notice may be wrapped over lines.
    Words are ordered by how few texts hold them. A block that reaches the threshold shares a word with the
    first |T| - ceil(t |T|) + 1 words of the template in that order, so only those are joined; blocks with too few template
    words (length) or too few after the matched one on either side (position) are dropped before the exact count.
    The template table is a parameter: its word list is held as one array. Blocks and documents may be of any number.
    """
    need = F.ceil(F.lit(threshold) * F.size("t_words") - F.lit(1e-9)).cast("int")
    sets = template.select("template", "label", words(lower_ascii(F.col("text")), BREAKS).alias("_w")).where(F.size("_w") > 0)
    sets = sets.select("template", "label", F.size("_w").alias("t_length"), F.array_distinct("_w").alias("t_words"))
    vocabulary = sorted(r[0] for r in sets.select(F.explode("t_words")).distinct().collect())
    if not vocabulary:
        return documents.select("doc_id", F.xxhash64("text").alias("_key")).limit(0).crossJoin(sets.select("template", "label", F.lit(0.0).alias("score")))
    least = sets.select(F.min(need)).first()[0]
    known = F.array(*[F.lit(v) for v in vocabulary])
    held = documents.select(F.explode(F.array_intersect(words(lower_ascii(F.col("text")), BREAKS), known)).alias("w"))
    rare = dict(held.groupBy("w").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (rare.get(w, 0), w)))}
    ordering = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    ordered = lambda c: F.array_sort(F.transform(c, lambda w: ordering[w]))
    index = (
        sets.withColumns({"need": need, "t_words": ordered("t_words")})
        .withColumn("prefix", F.slice("t_words", 1, F.size("t_words") - F.col("need") + 1))
        .select("template", "label", "t_length", "t_words", "need", F.posexplode("prefix").alias("t_at", "w"))
    )
    first = {r[0] for r in index.select("w").distinct().collect()}
    lengths = sorted(r[0] for r in sets.select("t_length").distinct().collect())
    found = blocks(documents, [w for w in vocabulary if rank[w] in first], lengths)
    probe = found.select("doc_id", "_key", "length", F.array_intersect("block", known).alias("b_words")).where(F.size("b_words") >= least)
    probe = probe.withColumn("b_words", ordered("b_words")).select("doc_id", "_key", "length", "b_words", F.posexplode("b_words").alias("b_at", "w"))
    left_over = F.least(F.size("t_words") - F.col("t_at"), F.size("b_words") - F.col("b_at")) + F.least("t_at", "b_at")
    shared = F.size(F.array_intersect("t_words", "b_words"))
    return (
        probe.join(F.broadcast(index), "w")  # a template table has at most its vocabulary's words times its rows
        .where(F.col("length").isNull() | (F.col("length") == F.col("t_length")))
        .where(F.size("b_words") >= F.col("need")).where(left_over >= F.col("need")).where(shared >= F.col("need"))
        .groupBy("doc_id", "_key", "template", "label").agg(F.max(shared / F.size("t_words")).alias("score"))
    )


def scan_licenses(documents: DataFrame, template: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``documents``: words, phrase places, labels and the best containment.

    A null text counts as empty; rows repeated in full give equal rows; rows that share a doc_id with different texts
    are told apart by their text. Other columns of ``documents`` are ignored. Labels are distinct, sorted and comma-joined,
    empty where there are none.
    """
    some = "|".join(f"[{BREAKS[1:-2]}]+".join(p.split(" ")) for p, _ in PHRASES)
    base = documents.select("doc_id", F.xxhash64("text").alias("_key"), lower_ascii(F.coalesce("text", F.lit(""))).alias("_text"))
    base = base.select("doc_id", "_key", F.col("_text").rlike(some).alias("_any"), words(F.col("_text"), BREAKS).alias("_w"))
    base = base.select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"), F.when(F.col("_any"), F.col("_w")).otherwise(F.array().cast("array<string>")).alias("_w"))
    places = phrase_places(F.col("_w"))
    base = base.select("doc_id", "_key", "n_words", *[c.alias(f"_p{i}") for i, c in enumerate(places.values())])
    spots = [F.col(f"_p{i}") for i in range(len(PHRASES))]
    every = F.concat(*spots)
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(spots, PHRASES, strict=True)]))
    base = base.select(
        "doc_id", "_key", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("_base"),
    )
    found = settle(
        containment_join(documents, template, threshold).groupBy("doc_id", "_key")
        .agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
        .select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), "_key", "_labels", "_score")
    )
    rows = base.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()})
    joined = skew_join(rows, found, ["_id", "_null", "_key"], [F.col("n_words")], "left")
    both = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
