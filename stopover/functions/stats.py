"""Ranks, percentiles, thresholds and agreement as distributed aggregates.

Everything that needs a global or per-group order goes through :func:`prefix_sum`, which
range-partitions the rows and adds partition offsets, so no group is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopover.session import cut_lineage


def prefix_sum(df: DataFrame, order: list[str], value: str | list[str], out: str | list[str]) -> DataFrame:
    """Running total of one or more value columns in ``order``; the order columns must identify a row.

    Rows are range-partitioned on the order, totalled per partition, and each partition's
    running total is shifted by the sum of the partitions before it. Only one row per
    partition is ever sorted in a single task.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(values))]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = placed.select("*", *[F.sum(v).over(inside).alias(f"_r{i}") for i, v in enumerate(values)])
    shifted = runs.join(before, "_part")
    return shifted.select(*df.columns, *[(F.col(f"_r{i}") + F.col(f"_b{i}")).alias(o) for i, o in enumerate(outs)])


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Distinct values per group with their count and the cumulative count up to each."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    run = prefix_sum(counts, [*group, value], "n", "_cum")
    if not group:
        return run.withColumnRenamed("_cum", "cum")
    base = run.groupBy(*group).agg(F.min(F.col("_cum") - F.col("n")).alias("_base"))
    return run.join(base, group).withColumn("cum", F.col("_cum") - F.col("_base")).drop("_cum", "_base")


# How each percentile rule turns a share p and a size n into a 0-based position.
_POSITION = {
    # nearest rank: ceil(p * n)
    "nearest": lambda p, n: F.greatest(F.lit(1), F.ceil(F.round(p * n, 9))) - 1,
    # round half to even of p * (n - 1)
    "rounded": lambda p, n: F.bround(p * (n - 1), 0).cast("long"),
    # whole part of n * p
    "floor": lambda p, n: F.floor(p * n),
}


def percentiles(df: DataFrame, group: list[str], value: str, shares: list[float], rule: str) -> DataFrame:
    """One row per group and share: the value at the position the rule names.

    Rules: ``nearest``, ``rounded``, ``floor`` (positions of a sorted list) and ``median``
    (mean of the two middle values, for the share 0.5).
    """
    counts = value_counts(df, group, value)
    size = counts.groupBy(*group).agg(F.max("cum").alias("_size"))
    if rule == "median":
        middle = F.array(F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2))
        wanted = size.select(*group, F.explode(middle).alias("_pos"))
        met = counts.join(wanted, group) if group else counts.join(F.broadcast(wanted))  # two rows
        inside = met.where((F.col("_pos") >= F.col("cum") - F.col("n")) & (F.col("_pos") < F.col("cum")))
        return inside.groupBy(*group).agg(F.avg(value).alias("value")).select(*group, F.lit(0.5).alias("share"), "value")
    wanted = size.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn(
        "_pos",
        F.least(F.col("_size") - 1, _POSITION[rule](F.col("share"), F.col("_size").cast("double")).cast("long")),
    )
    if group:
        hits = counts.join(wanted, group)
    else:
        hits = counts.join(F.broadcast(wanted))  # one row per share
    return hits.where((F.col("_pos") >= F.col("cum") - F.col("n")) & (F.col("_pos") < F.col("cum"))).select(
        *group, "share", F.col(value).alias("value")
    )


def auc(df: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """P(positive > negative) + half the ties per group; NULL when a side is empty."""
    tallies = (
        df.where(F.col(score).isNotNull())
        .groupBy(*group, score)
        .agg(
            F.count(F.when(F.col(positive), 1)).alias("p"),
            F.count(F.when(~F.col(positive), 1)).alias("q"),
        )
    )
    run = prefix_sum(tallies, [*group, score], "q", "_cum")
    base = run.groupBy(*group).agg(F.min(F.col("_cum") - F.col("q")).alias("_base"))
    with_base = run.join(base, group) if group else run.join(F.broadcast(base))
    below = F.col("_cum") - F.col("_base") - F.col("q")
    agg = with_base.groupBy(*group).agg(
        F.sum(F.col("p") * (below + F.col("q") / 2)).alias("_wins"),
        F.sum("p").alias("_np"),
        F.sum("q").alias("_nq"),
    )
    return agg.select(
        *group,
        F.when((F.col("_np") > 0) & (F.col("_nq") > 0), F.col("_wins") / (F.col("_np") * F.col("_nq"))).alias("auc"),
    )


def best_threshold(df: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """Cut that maximises the mean of P(pos >= t) and P(neg < t); the lowest such cut wins.

    Candidates are the smallest value and the midpoints between neighbouring distinct values.
    Groups with an empty side have no threshold.
    """
    tallies = (
        df.where(F.col(score).isNotNull())
        .groupBy(*group, score)
        .agg(
            F.count(F.when(F.col(positive), 1)).alias("p"),
            F.count(F.when(~F.col(positive), 1)).alias("q"),
        )
    )
    packed = tallies.withColumn("_one", F.lit(1))
    run = prefix_sum(packed, [*group, score], ["q", "p", "_one"], ["_cq", "_cp", "_pos"])
    bounds = run.groupBy(*group).agg(
        F.min(F.col("_cq") - F.col("q")).alias("_bq"),
        F.min(F.col("_cp") - F.col("p")).alias("_bp"),
        F.sum("p").alias("_np"),
        F.sum("q").alias("_nq"),
    )
    rows = run.join(bounds, group) if group else run.join(F.broadcast(bounds))
    # The neighbour below a value is the row one position earlier in the same group.
    prev = run.select(*group, (F.col("_pos") + 1).alias("_pos"), F.col(score).alias("_prev"))
    rows = rows.join(prev, [*group, "_pos"], "left")
    cut = F.when(F.col("_prev").isNull(), F.col(score)).otherwise((F.col("_prev") + F.col(score)) / 2)
    neg_below = F.col("_cq") - F.col("_bq") - F.col("q")
    pos_below = F.col("_cp") - F.col("_bp") - F.col("p")
    balanced = ((F.col("_np") - pos_below) / F.col("_np") + neg_below / F.col("_nq")) / 2
    return (
        rows.where((F.col("_np") > 0) & (F.col("_nq") > 0))
        .select(*group, cut.alias("_cut"), balanced.alias("_ba"))
        .groupBy(*group)
        .agg(F.max(F.struct(F.round("_ba", 12).alias("ba"), (-F.col("_cut")).alias("neg_cut"))).alias("_b"))
        .select(*group, (-F.col("_b.neg_cut")).alias("threshold"), F.col("_b.ba").alias("balanced_accuracy"))
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole, NULL when there is nothing to divide by."""
    return F.when(whole > 0, part / whole)


def weighted_mean(value: str, weight: str) -> Column:
    """Size-weighted average that skips missing values."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.sum(F.col(value) * w) / F.sum(w)


def line_fit(df: DataFrame, group: list[str], x: str, y: str, at: list[float]) -> DataFrame:
    """Least-squares line per group and its value at each x of ``at``."""
    fit = df.groupBy(*group).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept")
    )
    return fit.withColumn("x", F.explode(F.array(*[F.lit(float(v)) for v in at]))).withColumn(
        "estimate", F.col("intercept") + F.col("slope") * F.col("x")
    )


def latency_summary(df: DataFrame, config: list[str], seconds: str, started: str | None = None) -> DataFrame:
    """Count, mean, median, nearest-rank p95 and calls per second of each configuration.

    ``started``: begin of each call in seconds; calls per second are then over the time from the first begin to the last
    end, in which calls may overlap. Without it calls count as one after the other.
    """
    wall = F.sum(seconds) if started is None else F.max(F.col(started) + F.col(seconds)) - F.min(started)
    base = df.groupBy(*config).agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg(seconds).alias("mean_sec"),
        F.max(seconds).alias("max_sec"),
        F.try_divide(F.count(F.lit(1)), wall).alias("per_sec"),
    )
    median = percentiles(df, config, seconds, [0.5], "median").select(*config, F.col("value").alias("p50_sec"))
    high = percentiles(df, config, seconds, [0.95], "nearest").select(*config, F.col("value").alias("p95_sec"))
    return base.join(median, config).join(high, config)


def category_shares(df: DataFrame, category: str, flags: dict[str, Column]) -> DataFrame:
    """Counts of each flag per category, shares of the category, and a totals row."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count(F.when(c, 1)).alias(k) for k, c in flags.items()]
    rows = df.rollup(category).agg(*aggs, F.grouping(category).alias("_g"))
    out = rows.withColumn(category, F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col(category))).drop("_g")
    for k in flags:
        out = out.withColumn(f"{k}_share", share(F.col(k), F.col("n")))
    return out
