"""URL rules looked up by their rarest literal token; only the fetched rules run their pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.llm.common import lower_ascii, settle
from stopover.session import skew_join

# Rules up to this many go to every executor; more are joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path after the host, up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _patterns(rules: DataFrame) -> DataFrame:
    """Regular expression of each rule and the tokens that every match must hold."""
    escaped = F.regexp_replace("rule", r"([.\\+?^${}()|\[\]])", r"\\$1")
    # a run of letters or digits is a whole token of every match only if the rule itself ends it on both sides
    literal = F.regexp_extract_all(F.concat(F.lit("."), F.col("rule")), F.lit(r"(?<=[^0-9A-Za-z*])([0-9A-Za-z]+)(?=[^0-9A-Za-z*])"), 1)
    return rules.withColumns({
        "pattern": F.concat(F.lit(r"^(?:[^/]*\.)?"), F.regexp_replace(escaped, r"\*", "[^/]*")),
        "tokens": F.when(F.size(literal) > 0, F.array_distinct(literal)).otherwise(F.array(F.lit(""))),
    })


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Best rule of every distinct url: columns ``url``, ``rule``, ``verdict``, ``rank``.

    ``rules`` holds ``rule`` (host and path prefix, ``*`` within a part), ``verdict`` and ``rank``; a rule
    fits its host and all subdomains where the path starts with the rule's. The higher rank wins, then the longer
    rule, then the greater one. Null and rule-less urls have no row here. Rules that are null are ignored, repeated
    ones count once, and rules without a whole literal token are tried on every url.
    """
    target = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    seen = urls.where(F.col(url).contains("://")).select(F.col(url).alias("url")).distinct()
    tokens = seen.select("url", target.alias("_target")).select(
        "url", "_target", F.explode(F.array_distinct(F.array_append(F.split("_target", "[^0-9A-Za-z]+"), F.lit("")))).alias("token")
    )
    known = _patterns(rules.where("rule is not null").select("rule", "verdict", "rank").distinct())
    small = known.count() <= BROADCAST_RULES
    near = F.broadcast if small else (lambda df: df)
    literals = known.select("rule", F.explode("tokens").alias("token"))
    counts = tokens.join(near(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("_n"))
    rarest = (
        literals.join(counts, "token", "left").groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), "token")).alias("_rare"))
        .select("rule", F.col("_rare.token").alias("token"))
    )
    index = settle(known.join(rarest, "rule").select("rule", "verdict", "rank", "pattern", "token"))
    return (
        tokens.join(near(index), "token").where(F.expr("_target rlike pattern"))
        .groupBy("url").agg(F.max(F.struct("rank", F.length("rule"), "rule", "verdict")).alias("_best"))
        .select("url", "_best.rule", "_best.verdict", "_best.rank")
    )


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (null: no rule fits) and ``rank``.

    Repeated rows stay repeated, an empty table gives an empty one, columns of ``pages`` that clash are replaced.
    """
    best = settle(judge_urls(pages, rules)).withColumnRenamed("url", "_url")
    rows = pages.drop("host", "path", "rule", "verdict", "rank").withColumn("_url", F.col("url"))
    return skew_join(rows, best, ["_url"], [F.col("page_id")], "left").drop("_url").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    )
