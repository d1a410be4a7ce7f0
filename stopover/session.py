"""Session construction, lineage cuts and skew-safe joins used by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A key is "hot" when it holds more rows than one task should process.
HOT_KEY_ROWS = 500_000


def adaptive_skew(spark: SparkSession) -> bool:
    """Whether Spark itself splits oversized join partitions at run time."""
    on = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(c, "true") == "true" for c in on)


def get_spark(app: str = "stopover", cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session with the settings the operators assume (AQE, skew joins, UTC).

    On a cluster build the session with spark-submit instead: no operator depends on
    anything but the SQL confs set here, and each of them is a Spark default or a
    cluster-wide choice.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stopover-checkpoint-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so a lost executor costs one stage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: list[str | Column],
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi-join whose hot keys on the left are split over several tasks.

    With adaptive skew joins on, Spark measures the shuffled partitions and splits the big
    ones, so the plain join is enough and no counting pass is needed. Otherwise, or when
    ``hot_rows`` is given, hot keys are salted here: keys with more than ``hot_rows`` left rows get ``ceil(rows / hot_rows)`` salts. A left
    row picks one salt from the hash of ``spread``; the matching right rows are repeated
    once per salt, so every pair still meets exactly once. ``how`` may be inner, left,
    left_semi or left_anti.
    """
    if hot_rows is None:
        if adaptive_skew(left.sparkSession):
            return left.join(right, keys, how)
        hot_rows = HOT_KEY_ROWS
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    )
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("_salts").cast("long")).cast("int")
        ),
    ).drop("_salts")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
