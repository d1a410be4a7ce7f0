"""Quality rules: repeated and short texts fail; a hashed n-gram likelihood ratio judges every other text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.llm.common import BLANKS, settle, words

BUCKETS = 10_000
# Up to so many trusted ids go to every task (about 16 bytes each); beyond, the texts are dealt by id. All of them are used.
BROADCAST_TRUSTED = 1_000_000
# One in so many trusted documents is left out of the fit; these set the cut: at most the share QUANTILE of them scores less.
HELD_OUT = 5
QUANTILE = 0.01
# The cut in nats per n-gram where no trusted document is left to set it.
THRESHOLD = -0.5
MIN_WORDS = 50


def repeated_words(word: str = "w") -> Column:
    """Words lying in a window of three that the text holds at least twice, the first one included.

    Windows are told apart by a 64-bit hash; most texts repeat none and stop there.
    """
    hashes = f"transform(sequence(0, size({word}) - 3), i -> xxhash64({word}[i], {word}[i + 1], {word}[i + 2]))"
    return F.expr(f"if(size({word}) < 3, array(), {hashes})").cast("array<bigint>")


def _covered(h: str) -> Column:
    """Words covered by the windows whose hash occurs twice or more in the array ``h``."""
    order = f"array_sort(transform({h}, (x, i) -> named_struct('h', x, 'i', i)))"
    twice = "transform(filter(transform(s, (x, k) -> named_struct('i', x.i, 'd', coalesce(x.h = get(s, k - 1).h, false) or coalesce(x.h = get(s, k + 1).h, false))), y -> y.d), y -> y.i)"
    starts = f"array_sort(flatten(transform(array({order}), s -> {twice})))"
    cover = "aggregate(p, named_struct('to', 0, 'n', 0), (a, x) -> named_struct('to', x + 3, 'n', a.n + x + 3 - greatest(a.to, x)), a -> a.n)"
    return F.expr(f"if(size({h}) = size(array_distinct({h})), 0, transform(array({starts}), p -> {cover})[0])").cast("long")


def text_signals(documents: DataFrame) -> DataFrame:
    """``documents`` with its words ``w`` and the rule signals of every whole text (null: none)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    rows = documents.withColumns({
        "w": words(F.col("text"), BLANKS),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "_lines": lines,
    })
    rows = rows.withColumns({"word_chars": F.length(F.array_join("w", "")).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_words": F.size("w").cast("long"), "_h": repeated_words()})
    return rows.withColumn("n_repeat_words", _covered("_h")).drop("_lines", "_h")


def _grams(word: str = "w") -> str:
    """SQL of the hashed unigrams and bigrams of a word array."""
    one = f"transform({word}, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int))"
    two = f"if(size({word}) > 1, transform(sequence(0, size({word}) - 2), i -> cast(pmod(xxhash64({word}[i], {word}[i + 1]), {BUCKETS}) as int)), array())"
    return f"concat({one}, {two})"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, _held): all documents labelled as of quality and not toxic; ``_held``: not fitted on."""
    ids = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return ids.withColumn("_held", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(HELD_OUT)) == 0)


def _sent(ids: DataFrame) -> DataFrame:
    """Counted ids as the side of a join: sent to every task while they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_TRUSTED else ids.hint("merge")


def fit_ratio(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the log ratio of trusted over raw probability of each bucket, both smoothed by one.

    Trusted are those of ``trusted_ids`` that are not held out; raw are all documents.
    """
    spark = documents.sparkSession
    trusted = trusted_ids(labels).where("not _held").select("doc_id", F.lit(1).alias("_t"))
    grams = (
        documents.select("doc_id", "text")
        .join(_sent(trusted), "doc_id", "left")
        .select(F.coalesce("_t", F.lit(0)).alias("t"), words(F.col("text"), BLANKS).alias("w"))
        .select("t", F.explode(F.expr(_grams())).alias("b"))
    )
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    filled = spark.range(BUCKETS).join(counts, F.col("id") == F.col("b"), "left").select("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = filled.agg(F.array_sort(F.collect_list(F.struct("id", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = f"transform(c, x -> ln((x.target + 1) / (n_target + {BUCKETS})) - ln((x.raw + 1) / (n_raw + {BUCKETS})))"
    return table.select(F.when(F.col("n_target") > 0, F.expr(ratio)).otherwise(F.expr("transform(c, x -> 0D)")).alias("_ratio"))


def _judged(documents: DataFrame, ratio: DataFrame) -> DataFrame:
    """``documents`` with its signals, ``base_failed``, ``score`` and the other columns of the one row of ``ratio``."""
    rows = text_signals(documents).crossJoin(F.broadcast(ratio))  # one row of BUCKETS numbers
    total = F.expr(
        "aggregate(w, 0D, (a, x) -> a + _ratio[cast(pmod(xxhash64(x), {b}) as int)])"
        " + if(size(w) > 1, aggregate(sequence(0, size(w) - 2), 0D, (a, i) -> a + _ratio[cast(pmod(xxhash64(w[i], w[i + 1]), {b}) as int)]), 0D)".format(b=BUCKETS)
    )
    return rows.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "score": F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0)),
    })


def fit_cut(documents: DataFrame, labels: DataFrame, ratio: DataFrame) -> DataFrame:
    """One row ``_cut``: the QUANTILE of the scores of held-out trusted documents that pass the base rules (none: THRESHOLD)."""
    held = documents.select("doc_id", "text").join(_sent(trusted_ids(labels).where("_held")), "doc_id", "left_semi")
    cut = F.expr(f"percentile_disc({QUANTILE}) within group (order by score)")
    judged = _judged(held, ratio).select(F.inline(F.array(F.struct("base_failed", "score"))))  # as in quality_rules
    return judged.where("not base_failed").agg(F.coalesce(cut, F.lit(THRESHOLD)).alias("_cut"))


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """``documents`` with word counts, rule signals, ``base_failed``, ``score`` and ``kept``.

    ``score`` is the mean log-likelihood ratio of a text's hashed unigrams and bigrams; texts without words score 0 and
    fail the base rules. Texts that score less than the cut go: ``threshold``, or else what ``fit_cut`` takes from the data.
    Null texts have no words; null or repeated ids only matter for finding trusted documents; without
    trusted documents every score is 0. Columns of ``documents`` that clash with the new ones are replaced.
    """
    new = ("w", "word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words", "base_failed", "score", "kept")
    ratio = settle(fit_ratio(documents, labels))
    cut = documents.sparkSession.range(1).select(F.lit(float(threshold)).alias("_cut")) if threshold is not None else fit_cut(documents, labels, ratio)
    judged = _judged(documents.drop(*new), settle(ratio.crossJoin(cut))).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("_cut")))
    # a filter on the verdict must not be moved down and written out in terms of the text, once for each word
    return judged.select(*[c for c in documents.columns if c not in new], F.inline(F.array(F.struct(*new[1:]))))
