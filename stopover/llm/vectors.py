"""Embedding vectors as whole numbers, and exact sums of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Components up to this size keep squared distances of 64 components within a long.
LARGEST = 1 << 27


def finite(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector is there, is not empty, holds finite components only and, if given, has ``dims`` of them."""
    sized = F.size(vector) == dims if dims else F.size(vector) > 0
    # NaN is larger than every number in Spark, so one comparison leaves out NaN and both infinities.
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & sized & whole, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as longs.

    A component of 2^27 or more cannot be told apart by long distances and raises an error instead of a wrong result.
    """
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * float(scale))
        return F.when(F.abs(x.cast("double")) * float(scale) < float(LARGEST), y).otherwise(
            F.raise_error(F.lit(f"a vector component times {scale} reaches 2^27")).cast("long")
        )

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all lists of one width, as rows of int64."""
    values = column.flatten()
    return np.asarray(values, np.int64).reshape(-1, width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return cuts, np.r_[cuts[1:], np.full(min(len(keys), 1), len(keys))]


def means(sums: DataFrame, keys: list[str], width: int) -> list:
    """Rows (keys.., means, n, extras): componentwise floor(sum / n) of partial rows (keys.., sums, n, far).

    One row for each key: as many as there are centroids, whatever the input.
    """
    total = sums.groupBy(*keys).agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("n").alias("n"), F.max("far").alias("far")
    )
    return [(*(r[k] for k in keys), [s // r["n"] for s in r["sums"]], r["n"], r["far"]) for r in total.collect()]
