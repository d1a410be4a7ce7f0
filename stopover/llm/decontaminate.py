"""Benchmark decontamination: item windows found in documents by their rarest shingle, then compared word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.llm.common import BREAKS, lower_ascii, settle, words
from stopover.session import skew_join

WINDOW = 13
SHINGLE = 3
# 64-bit words of the shingle filter: a quarter of a word for each counted shingle, between these sizes (0.1 and 16 MB).
# Beyond them more places pass on to the join, which decides.
FILTER_WORDS = (1 << 14, 1 << 21)
# Tables of windows and of documents that hold some prefix go to every executor up to this many rows; more are joined by shuffle.
BROADCAST_WINDOWS = 200_000


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, words) windows: every ``window`` consecutive words, or all words of a shorter item."""
    item = benchmark.select("item_id", words(lower_ascii(F.col("text")), BREAKS).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")
    return item.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.expr(f"slice(w, i + 1, {window})").alias("words")).distinct()


def _shingles(size: str, at: str = "i") -> str:
    """SQL of the hash of ``size`` words from place ``at``."""
    return f"xxhash64({size}, {', '.join(f'w[{at} + {j}]' for j in range(int(size)))})"


def _filter_of(hashes: DataFrame, size: int) -> DataFrame:
    """One row with a bit array of ``size`` 64-bit words (a power of two) that holds every hash ``h``."""
    spark = hashes.sparkSession
    bits = hashes.groupBy(F.expr(f"shiftrightunsigned(h, 6) & {size - 1}").alias("k")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")
    )
    return (
        spark.range(size).join(bits, F.col("id") == F.col("k"), "left")
        .agg(F.expr("transform(array_sort(collect_list(struct(id, coalesce(bits, 0L) as bits))), x -> x.bits)").alias("_bits"))
    )


def _marked(documents: DataFrame, hashes: DataFrame, n_hashes: int, sizes: list[int], more: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``documents``: doc_id, _key, _n (words) and _x, places (i, h) of shingles that may be among ``hashes``.

    The filter has one row of bounded size, which every task holds. ``more`` may ask for ``w``, the words, too.
    """
    low, high = FILTER_WORDS
    size = min(max(low, 1 << max(n_hashes // 4, 1).bit_length()), high)
    bit = f"shiftrightunsigned(_bits[cast(shiftrightunsigned(x.h, 6) & {size - 1} as int)], cast(x.h & 63 as int)) & 1"
    parts = [
        f"if(_n >= {s}, filter(transform(sequence(0, _n - {s}), i -> named_struct('i', i, 'h', {_shingles(str(s))})), x -> {bit} = 1), array())"
        for s in sizes
    ]
    rows = documents.select("doc_id", F.xxhash64("text").alias("_key"), words(lower_ascii(F.col("text")), BREAKS).alias("w"))
    rows = rows.select("doc_id", "_key", "w", F.size("w").alias("_n")).crossJoin(F.broadcast(_filter_of(hashes, size)))
    marks = f"concat({', '.join(parts)})" if parts else "cast(array() as array<struct<i: int, h: bigint>>)"
    return rows.select("doc_id", "_key", "_n", *more, F.expr(marks).alias("_x"))


def contained_windows(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every (doc_id, _key, item_id, start, size) where a window of an item stands in a document, and (doc_id, _key, _n) of every row.

    The tokens of the set join are shingles of three words (fewer in shorter items), ordered by how rarely they occur
    in all documents. A window lies in a document only if its rarest shingle does, so that one is its prefix, and no window
    lies anywhere that has a shingle which no document holds. One pass over all texts leaves the places of possible
    shingles; only documents that hold some prefix are split again. A place passes if the window fits between the document's
    first and last word from there, and is then compared word by word.
    """
    shingled = item_windows(benchmark).withColumn("size", F.size("words")).withColumn("s", F.least("size", F.lit(SHINGLE)))
    per_size = F.expr("case " + " ".join(
        f"when s = {s} then transform(sequence(0, size - {s}), i -> named_struct('o', i, 'h', {_shingles(str(s)).replace('w[', 'words[')}))"
        for s in range(1, SHINGLE + 1)) + " end")
    shingled = settle(shingled.withColumn("sh", per_size))
    sizes = sorted(r[0] for r in shingled.select("s").distinct().collect())  # at most SHINGLE values
    hashes = shingled.select(F.explode("sh.h").alias("h")).distinct()
    n_hashes = hashes.count()
    marked = settle(_marked(documents, hashes, n_hashes, sizes))
    near = F.broadcast if n_hashes <= BROADCAST_WINDOWS else (lambda df: df)
    counts = marked.select(F.explode("_x.h").alias("h")).join(near(hashes), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    each = shingled.select("item_id", "words", "size", F.size("sh").alias("_all"), F.inline("sh"))
    prefix = settle(
        each.join(counts, "h").groupBy("item_id", "words", "size", "_all")
        .agg(F.min(F.struct("n", "h", "o")).alias("p"), F.count("*").alias("_held"))
        .where("_held = _all")
        .select("item_id", "words", "size", "p.h", "p.o")
    )
    n_prefix = prefix.count()
    near = F.broadcast if n_prefix <= BROADCAST_WINDOWS else (lambda df: df)
    starts = prefix.select("h").distinct()
    holders = settle(
        marked.select("doc_id", "_key", F.explode("_x.h").alias("h")).join(near(starts), "h", "left_semi")
        .select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), "_key").distinct()
    )
    texts = documents.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.xxhash64("text").alias("_key"))
    few = F.broadcast if holders.count() <= BROADCAST_WINDOWS else (lambda df: df)
    again = _marked(texts.join(few(holders), ["_id", "_null", "_key"], "left_semi"), starts, n_prefix, sizes, ("w",)).where("size(_x) > 0")
    around = f"transform(_x, x -> named_struct('i', x.i, 'h', x.h, 'w', slice(w, greatest(x.i - {WINDOW - 1}, 0) + 1, {2 * WINDOW})))"
    start = F.col("i") - F.col("o")
    found = (
        again.select("doc_id", "_key", "_n", F.expr(f"inline({around})")).join(near(prefix), "h")
        .where((start >= 0) & (start + F.col("size") <= F.col("_n")))
        .where(F.expr(f"slice(w, i - o - greatest(i - {WINDOW - 1}, 0) + 1, size) = words"))
        .select("doc_id", "_key", "item_id", start.alias("start"), "size")
    )
    return found, marked.select("doc_id", "_key", "_n")


def hit_words(spans: Column) -> Column:
    """Words covered by an array of (start, size), overlaps once."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["to"], x["start"] + x["size"]).alias("to"),
        (acc["n"] + F.greatest(x["start"] + x["size"] - F.greatest(acc["to"], x["start"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), step)["n"]


def decontaminate(documents: DataFrame, benchmark: DataFrame, part: int = 20) -> DataFrame:
    """One row per row of ``documents``: words, hit words, items found and the verdict.

    Null texts have no words; null item ids count as no item; items repeated under one id count once; rows of ``documents``
    that share a doc_id with different texts are told apart by their text, rows repeated in full give equal rows. Other
    columns are ignored. ``text_key`` is the hash of the text. ``contaminated``: some word is hit and at least one in ``part`` is.
    """
    found, read = contained_windows(documents, benchmark)
    hits = settle(
        found.groupBy("doc_id", "_key")
        .agg(F.collect_set(F.struct("start", "size")).alias("_spans"), F.collect_set(F.col("item_id").cast("string")).alias("_items"))
        .select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), "_key",
                hit_words(F.col("_spans")).alias("_hit"), F.array_sort("_items").alias("_items"))
    )
    rows = read.select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), "_key",
        F.col("_n").cast("long").alias("n_words"),
    )
    return skew_join(rows, hits, ["_id", "_null", "_key"], [F.col("n_words")], "left").select(
        "doc_id", F.col("_key").alias("text_key"), "n_words", F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("_items", F.array().cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(part) * F.col("n_hit") >= F.col("n_words")))
