"""Relevance evaluation of ranked lists: nDCG, separation, thresholds, selection rules, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopover.functions.stats import prefix_sum, share
from stopover.session import cut_lineage

TOP = 5
MIN_SCORE = 1e-6
RELEVANT = 2

# Selection rules tried in the evaluation.
TOP_K = (1, 3, 5, 10)
GAPS = (0.005, 0.01, 0.02, 0.03, 0.05)
GAP_WINDOW = 10
GRID_STEP = 0.01


def positive(grade: Column) -> Column:
    return grade >= RELEVANT


def negative(grade: Column) -> Column:
    """Grade 0 or not judged; grade 1 is neither positive nor negative."""
    return F.coalesce(grade, F.lit(0)) == 0


def rank_scores(scores: DataFrame, by: list[str], item: str = "item_id") -> DataFrame:
    """Scores at or below 1e-6 dropped, then ranked per query, ties by item."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), item)
    return scores.where(F.col("score") > MIN_SCORE).withColumn("rank", F.row_number().over(w))


def with_grades(ranked: DataFrame, judgments: DataFrame, item: str = "item_id") -> DataFrame:
    """Ranked rows with the grade of their judgment, NULL when not judged."""
    return ranked.join(judgments.select("qid", F.col("item_id").alias(item), "grade"), ["qid", item], "left")


def ndcg(ranked: DataFrame, judgments: DataFrame, by: list[str] | None = None, top: int = TOP) -> DataFrame:
    """nDCG with linear gain per query (and method); 0 when the ideal is 0.

    The ideal is the ``top`` highest grades of all judgments of the query, found or not.
    """
    by = by or ["qid"]
    gain = F.coalesce(F.col("grade"), F.lit(0)) / F.log2(F.col("rank") + 1)
    dcg = (
        with_grades(ranked.where(F.col("rank") <= top), judgments)
        .groupBy(*by)
        .agg(F.sum(gain).alias("dcg"))
    )
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "item_id")
    ideal = (
        judgments.withColumn("i", F.row_number().over(w))
        .where(F.col("i") <= top)
        .groupBy("qid")
        .agg(F.sum(F.col("grade") / F.log2(F.col("i") + 1)).alias("idcg"))
    )
    rest = [c for c in by if c != "qid"]
    if rest:
        cells = ideal.join(F.broadcast(ranked.select(*rest).distinct()))  # one row per method compared
    else:
        cells = ideal
    out = cells.join(dcg, by, "left")
    return out.select(
        *by, F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg")
    )


def separation(graded: DataFrame, by: list[str]) -> DataFrame:
    """Lowest positive score less highest negative score; NULL when a side is empty."""
    return graded.groupBy(*by).agg(
        (
            F.min(F.when(positive(F.col("grade")), F.col("score")))
            - F.max(F.when(negative(F.col("grade")), F.col("score")))
        ).alias("separation")
    )


def common_threshold(graded: DataFrame) -> DataFrame:
    """One cut for all queries: most queries cleanly split, then fewest missed and leaked, then lowest.

    One row: t, clean, n, missed, leaked, pos, neg. Queries with an empty side do not count.
    Every count at a candidate cut is a cumulative count over the sorted scores, so the work
    is a sort, not candidates times scores.
    """
    sides = graded.select(
        "qid", F.round("score", 12).alias("score"),
        positive(F.coalesce("grade", F.lit(0))).alias("p"), negative(F.col("grade")).alias("q"),
    )
    per_query = sides.groupBy("qid").agg(
        F.min(F.when(F.col("p"), F.col("score"))).alias("lo"),
        F.max(F.when(F.col("q"), F.col("score"))).alias("hi"),
    ).where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    per_query = cut_lineage(per_query)
    used = sides.join(per_query.select("qid"), "qid", "left_semi")
    # A query is clean for hi < t <= lo: +1 just above hi, -1 just above lo.
    clean = per_query.where(F.col("hi") < F.col("lo"))
    zero = F.lit(0).cast("long")

    def events(df: DataFrame, **amounts: Column) -> DataFrame:
        return df.select(
            F.col("score"), *[amounts.get(n, zero).cast("long").alias(n) for n in ("is_pos", "is_neg", "opens", "closes")]
        )

    marks = (
        events(used, is_pos=F.col("p").cast("long"), is_neg=F.col("q").cast("long"))
        .unionByName(events(clean.withColumn("score", F.col("hi")), opens=F.lit(1)))
        .unionByName(events(clean.withColumn("score", F.col("lo")), closes=F.lit(1)))
        .groupBy("score")
        .agg(*[F.sum(n).alias(n) for n in ("is_pos", "is_neg", "opens", "closes")])
    )
    kinds = ["is_pos", "is_neg", "opens", "closes"]
    marks = prefix_sum(marks, ["score"], kinds, [f"c_{n}" for n in kinds])
    totals = used.agg(F.count(F.when(F.col("p"), 1)).alias("pos"), F.count(F.when(F.col("q"), 1)).alias("neg"))
    n_query = per_query.agg(F.count(F.lit(1)).alias("n"))
    rows = marks.where(F.col("is_pos") > 0).join(F.broadcast(totals)).join(F.broadcast(n_query))  # one-row totals
    below = {n: F.col(f"c_{n}") - F.col(n) for n in ("is_pos", "is_neg", "opens", "closes")}
    rows = rows.select(
        F.col("score").alias("t"),
        (below["opens"] - below["closes"]).alias("clean"),
        "n",
        below["is_pos"].alias("missed"),
        (F.col("neg") - below["is_neg"]).alias("leaked"),
        "pos",
        "neg",
    )
    return rows.orderBy(F.desc("clean"), F.col("missed") + F.col("leaked"), "t").limit(1)


def topic_hit_rank(topic_ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Best rank among the expected topics per query and variant, with the topic ranked first."""
    hit = topic_ranked.join(expected.withColumn("_e", F.lit(True)), ["qid", "topic_id"], "left")
    return (
        hit.join(expected.select("qid").distinct(), "qid", "left_semi")
        .groupBy("qid", "variant")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("topic_id"))).alias("first_topic"),
            F.min(F.when(F.col("_e"), F.col("rank"))).alias("hit_rank"),
        )
        .withColumn("hit_at_1", F.coalesce(F.col("hit_rank") == 1, F.lit(False)))
    )


def category_means(per_query: DataFrame, queries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean nDCG and number of queries of each category; a missing category is その他."""
    by = by or []
    cat = queries.select("qid", F.coalesce("category", F.lit("その他")).alias("category"))
    return per_query.join(cat, "qid").groupBy(*by, "category").agg(
        F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("queries")
    )


# ------------------------------------------------------------------ selection rules


def rule_table(spark, thresholds: list[float], top5_threshold: float | None = None) -> DataFrame:
    """Selection rules as rows: (rule, value)."""
    rows = [("top", float(k)) for k in TOP_K]
    rows += [("threshold", float(t)) for t in thresholds]
    rows += [("gap", g) for g in GAPS]
    if top5_threshold is not None:
        rows.append(("top5_threshold", float(top5_threshold)))
    return spark.createDataFrame(rows, "rule string, value double")


def _selected(rule: Column, value: Column) -> Column:
    return (
        F.when(rule == "top", F.col("rank") <= value)
        .when(rule == "threshold", F.col("score") >= value)
        .when(rule == "gap", (F.col("rank") <= GAP_WINDOW) & (F.col("score") >= F.col("first_score") - value))
        .when(rule == "top5_threshold", (F.col("rank") <= TOP) & (F.col("score") >= value))
    )


def rule_stats(ranked: DataFrame, judgments: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, rows selected and distractors of each rule, averaged over queries, 3 digits.

    ``ranked``: by.., qid, rank, item_id, score, judged (False for a distractor). Precision
    skips queries that select nothing graded 0 or relevant; recall skips queries without a
    relevant judgment. ``rules`` is a small table: each ranked row is repeated per rule.
    """
    by = by or []
    first = ranked.where(F.col("rank") == 1).select(*by, "qid", F.col("score").alias("first_score"))
    graded = with_grades(ranked, judgments).join(first, [*by, "qid"])
    picked = graded.join(F.broadcast(rules), _selected(F.col("rule"), F.col("value")))
    per = picked.groupBy(*by, "rule", "value", "qid").agg(
        F.count(F.when(positive(F.col("grade")), 1)).alias("pos"),
        F.count(F.when(negative(F.col("grade")), 1)).alias("neg"),
        F.count(F.lit(1)).alias("sel"),
        F.count(F.when(~F.col("judged") & negative(F.col("grade")), 1)).alias("dis"),
    )
    relevant = judgments.groupBy("qid").agg(F.count(F.when(positive(F.col("grade")), 1)).alias("total"))
    # Queries where a rule selects nothing still count for recall and size.
    grid = first.select(*by, "qid").join(F.broadcast(rules.select("rule", "value")))
    full = grid.join(per, [*by, "rule", "value", "qid"], "left").join(relevant, "qid", "left").fillna(
        0, ["pos", "neg", "sel", "dis", "total"]
    )
    return full.groupBy(*by, "rule", "value").agg(
        F.round(F.avg(share(F.col("pos"), F.col("pos") + F.col("neg"))), 3).alias("precision"),
        F.round(F.avg(share(F.col("pos"), F.col("total"))), 3).alias("recall"),
        F.round(F.avg("sel"), 3).alias("selected"),
        F.round(F.avg("dis"), 3).alias("distractors"),
    )


def threshold_grid(ranked: DataFrame, window: int = 10) -> list[float]:
    """Two-digit grid from the floor to the ceiling of the top-10 scores, in hundredths."""
    lo, hi = ranked.where(F.col("rank") <= window).agg(
        F.floor(F.min("score") * 100), F.ceil(F.max("score") * 100)
    ).first()
    return [i / 100 for i in range(int(lo), int(hi) + 1)] if lo is not None else []


def best_f1(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Threshold with the highest F1 of mean precision and recall; the lowest wins a tie."""
    by = by or []
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    rows = stats.where(F.col("rule") == "threshold").withColumn("f1", f1)
    best = F.max_by(F.struct("value", "f1"), F.struct(F.round("f1", 12), -F.col("value")))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.value").alias("threshold"), F.col("b.f1").alias("f1"))


def distractor_mix(judged: DataFrame, distractors: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """Corpora of the judged items plus the first n distractors of one seeded permutation.

    Smaller corpora are subsets of larger ones. Output: (size, item_id, embedding, judged).
    The permutation is the order of a hash, so only the largest prefix is ever sorted.
    """
    base = distractors.withColumn("_h", F.xxhash64(F.lit(seed), "item_id"))
    top = base.orderBy("_h", "item_id").limit(max(sizes))
    packed = prefix_sum(top.withColumn("_one", F.lit(1)), ["_h", "item_id"], "_one", "_pos")
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    a = judged.select(size, "item_id", "embedding", F.lit(True).alias("judged"))
    b = packed.select(size, "item_id", "embedding", F.lit(False).alias("judged"), "_pos").where(
        F.col("_pos") <= F.col("size")
    ).drop("_pos")
    return a.unionByName(b)


def apply_review(judgments: DataFrame, review: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgments plus the human grades of items that are in the corpus; a blank grade is no grade.

    A human grade replaces an existing one.
    """
    graded = review.where(F.col("grade").isNotNull()).join(corpus.select("item_id").distinct(), "item_id", "left_semi")
    kept = judgments.join(graded.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
    return kept.select("qid", "item_id", "grade").unionByName(graded.select("qid", "item_id", "grade"))


def size_report(ranked: DataFrame, judgments: DataFrame, by: list[str]) -> DataFrame:
    """Per corpus size and query: best relevant and best distractor score, distractors in the top 5."""
    graded = with_grades(ranked, judgments)
    noise = ~F.col("judged") & negative(F.col("grade"))
    return graded.groupBy(*by, "qid").agg(
        F.max(F.when(positive(F.col("grade")), F.col("score"))).alias("best_relevant"),
        F.max(F.when(noise, F.col("score"))).alias("best_distractor"),
        F.count(F.when(noise & (F.col("rank") <= TOP), 1)).alias("distractors_top5"),
        F.max(F.when(F.col("rank") == 1, noise)).alias("first_is_distractor"),
    )


def review_sheet(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """Distractors in the top 5, with an empty grade for a person to fill in."""
    return ranked.where(~F.col("judged") & (F.col("rank") <= top)).select(
        "qid", "rank", "item_id", F.round("score", 4).alias("score"), F.lit(None).cast("int").alias("grade")
    )


def build_pairs(reviews: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Pairs with stable ids and no grades: (pair_id, qid, item_id).

    ``reviews``: (seq, qid, item_id, ..). Without an index ids count the rows in order; with
    one the stored ids are reused, and a key on one side only is an error.
    """
    keys = reviews.select("seq", "qid", "item_id")
    if index is None:
        numbered = prefix_sum(keys.withColumn("_one", F.lit(1)), ["seq", "qid", "item_id"], "_one", "_n")
        return numbered.select(F.format_string("P%03d", F.col("_n")).alias("pair_id"), "qid", "item_id")
    joined = keys.join(index.select("pair_id", "qid", "item_id"), ["qid", "item_id"], "full")
    ok = F.col("pair_id").isNotNull() & F.col("seq").isNotNull()
    checked = F.when(ok, F.col("pair_id")).otherwise(F.raise_error(F.lit("review and pair index differ")).cast("string"))
    return joined.select(checked.alias("pair_id"), "qid", "item_id")


# ------------------------------------------------------------------ approximate against exact


def result_quality(df: DataFrame, by: list[str], truth: str, got: str, dists: str, k: int) -> DataFrame:
    """Recall at k, first-place agreement, share in order, share short of k."""
    t, g = F.slice(F.col(truth), 1, k), F.slice(F.col(got), 1, k)
    size = F.greatest(F.lit(1), F.least(F.lit(k), F.size(truth)))
    d = F.col(dists)
    n = F.greatest(F.size(d) - 1, F.lit(0))
    ordered = F.forall(
        F.zip_with(F.slice(d, F.lit(1), n), F.slice(d, F.lit(2), n), lambda a, b: a <= b + 1e-9), lambda x: x
    )
    first = F.coalesce(F.get(F.col(truth), F.lit(0)) == F.get(F.col(got), F.lit(0)), F.lit(False))
    return df.groupBy(*by).agg(
        F.avg(F.size(F.array_intersect(t, g)) / size).alias("recall"),
        F.avg(first.cast("double")).alias("top1"),
        F.avg(ordered.cast("double")).alias("ordered"),
        F.avg((F.size(got) < k).cast("double")).alias("short"),
    )


def neighbour_lists(near: DataFrame, ids: str, dists: str) -> DataFrame:
    """Ranked neighbours packed into arrays per query; at most k entries each."""
    packed = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("l"))
    return packed.select(
        "qid", F.transform("l", lambda x: x["id"]).alias(ids), F.transform("l", lambda x: x["dist"]).alias(dists)
    )


def ann_quality(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """One row comparing approximate with exact neighbours over all queries."""
    t = neighbour_lists(exact, "truth", "_d")
    g = neighbour_lists(approx, "got", "dists")
    both = t.join(g, "qid", "left").withColumn(
        "got", F.coalesce("got", F.slice("truth", 1, 0))
    ).withColumn("dists", F.coalesce("dists", F.array().cast("array<double>")))
    return result_quality(both, [], "truth", "got", "dists", k)
