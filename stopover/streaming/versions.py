"""Tables kept as numbered full versions, so a repeated micro-batch finds its own result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _done(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, root: str) -> int | None:
    """Highest complete version below ``root``."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(base)]
    done = [int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and _done(spark, f"{root}/{n}")]
    return max(done, default=None)


def read(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v{version}")


def write(df: DataFrame, root: str, version: int) -> None:
    """Write a version; the success marker comes last, so a broken write is never read."""
    df.write.mode("overwrite").parquet(f"{root}/v{version}")
