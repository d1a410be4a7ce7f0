"""Agreement between raters from contingency counts.

``pairs``: by.., a, b with integer grades 0..3, ``a`` the rater under test and ``b`` the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.functions.rules import three_levels

REASONS = ("same_target", "same_place", "same_viewpoint", "similar_topic", "none")


def contingency(pairs: DataFrame, by: list[str], a: Column | None = None, b: Column | None = None) -> DataFrame:
    a = F.col("a") if a is None else a
    b = F.col("b") if b is None else b
    return pairs.groupBy(*by, a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _margins(table: DataFrame, by: list[str]):
    na = table.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    nb = table.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    return na, nb


def kappa(pairs: DataFrame, by: list[str], collapse: bool = False) -> DataFrame:
    """Observed agreement and Cohen's kappa; kappa is 0 when chance agreement is certain."""
    pick = three_levels if collapse else (lambda c: c)
    table = contingency(pairs, by, pick(F.col("a")), pick(F.col("b")))
    total = table.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")
    )
    na, nb = _margins(table, by)
    chance = (
        na.join(nb.withColumnRenamed("b", "a"), [*by, "a"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    )
    out = total.join(chance, by, "left") if by else total.join(F.broadcast(chance))
    po = F.col("same") / F.col("n")
    pe = F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*by, po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0)).alias("kappa"))


def weighted_kappa(pairs: DataFrame, by: list[str], levels: int = 4) -> DataFrame:
    """Kappa with quadratic weights; 0 when no disagreement is expected."""
    table = contingency(pairs, by)

    def weight(a: Column, b: Column) -> Column:
        return (a - b) * (a - b) / float((levels - 1) ** 2)

    obs = table.groupBy(*by).agg(
        F.sum(weight(F.col("a"), F.col("b")) * F.col("n")).alias("o"), F.sum("n").alias("n")
    )
    # Expected weight from the moments of the two margins: sum w(a,b) na nb = N(Sa2 + Sb2) - 2 Sa Sb, scaled.
    m = table.groupBy(*by).agg(
        F.sum(F.col("a") * F.col("n")).alias("sa"), F.sum(F.col("b") * F.col("n")).alias("sb"),
        F.sum(F.col("a") * F.col("a") * F.col("n")).alias("sa2"), F.sum(F.col("b") * F.col("b") * F.col("n")).alias("sb2"),
    )
    rows = obs.join(m, by) if by else obs.join(F.broadcast(m))
    n = F.col("n")
    expected = (n * (F.col("sa2") + F.col("sb2")) - 2 * F.col("sa") * F.col("sb")) / float((levels - 1) ** 2) / (n * n)
    return rows.select(*by, F.when(expected > 0, 1 - (F.col("o") / n) / expected).otherwise(F.lit(0.0)).alias("weighted_kappa"))


def agreement_bands(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Opposite verdicts, both ends of the scale against the reference, too loose and too strict."""
    a, b = F.col("a"), F.col("b")
    a3, b3 = three_levels(a), three_levels(b)

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        n(((a3 == 0) & (b3 == 2)) | ((a3 == 2) & (b3 == 0))).alias("opposite"),
        n(a3 > b3).alias("higher"), n(a3 < b3).alias("lower"),
        n(a >= 2).alias("a_high"), n((a >= 2) & (b >= 2)).alias("a_high_b_high"), n((a >= 2) & (b == 0)).alias("a_high_b_zero"),
        n(a == 0).alias("a_zero"), n((a == 0) & (b == 0)).alias("a_zero_b_zero"), n((a == 0) & (b >= 2)).alias("a_zero_b_high"),
        n(a == 1).alias("a_middle"),
        n((b == 0) & (a >= 1)).alias("too_loose"), n((b >= 2) & (a <= 1)).alias("too_strict"),
    )


def reason_histogram(judgements: DataFrame, by: list[str]) -> DataFrame:
    """Reasons given for grades of 1 or more."""
    used = judgements.where(F.col("a") >= 1)
    return used.groupBy(*by).agg(*[F.count(F.when(F.col("reason_type") == r, 1)).alias(r) for r in REASONS])
