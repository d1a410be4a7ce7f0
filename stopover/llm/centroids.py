"""Centroid clustering by the threshold algorithm: sorted centroid lists per dimension, walked outward from each value."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopover.llm.common import settle
from stopover.llm.vectors import chunks, finite, floored, matrix, means, runs

# Cells (vectors x centroids, vectors x dimensions) that one numpy step holds.
CELLS = 2_000_000


class SortedLists:
    """Centroids (k x d whole numbers) with their numbers sorted by value in every dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # d x k numbers
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)  # d x k, ascending

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``x``: number of the nearest centroid (ties: the smaller), squared distance, centroids compared.

        Every round takes the next nearest entry of each dimension's list, on whichever side of the vector's value it
        lies. Centroids met for the first time are compared in full. No centroid still unmet can be nearer than the
        squared distances of the lists' last entries add up to; a row ends when that sum is larger than its best
        distance. While both are equal an unmet centroid of a smaller number could tie, so the walk goes on.
        """
        n, d = x.shape
        k = len(self.centroids)
        dims = np.arange(d)
        right = np.stack([np.searchsorted(self.values[j], x[:, j], "left") for j in range(d)], axis=1) if d else np.zeros((n, 0), np.int64)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k, np.int64)
        seen = np.zeros((n, k), bool)
        live = np.arange(n)
        end = np.iinfo(np.int64).max
        for _ in range(k):
            if not len(live):
                break
            lo, hi, v = left[live], right[live], x[live]
            down = np.where(lo >= 0, v - self.values[dims, np.maximum(lo, 0)], end)
            up = np.where(hi < k, self.values[dims, np.minimum(hi, k - 1)] - v, end)
            take = down <= up
            met = self.order[dims, np.where(take, np.maximum(lo, 0), np.minimum(hi, k - 1))]
            left[live] = lo - take
            right[live] = hi + ~take
            new = np.zeros((len(live), k), bool)
            new[np.arange(len(live))[:, None], met] = True
            new &= ~seen[live]
            seen[live] |= new
            row, centroid = np.nonzero(new)  # by row, then by number: the first least is the smaller number
            if len(row):
                gap = v[row] - self.centroids[centroid]
                distance = np.einsum("ij,ij->i", gap, gap)
                order = np.lexsort((centroid, distance, row))
                first = order[runs(row[order])[0]]
                at, found, which = live[row[first]], distance[first], centroid[first]
                better = (found < best[at]) | ((found == best[at]) & (which < number[at]))
                best[at[better]], number[at[better]] = found[better], which[better]
            frontier = np.where(take, down, up)
            live = live[np.einsum("ij,ij->i", frontier, frontier) <= best[live]]
        return number, best, seen.sum(axis=1)

    def step_rows(self) -> int:
        k, d = self.centroids.shape
        return max(1, CELLS // max(k * max(d, 1), 1))


def _sums(lists: SortedLists):
    """Partial sums of each centroid's vectors, one row for each centroid that a task met."""
    k, d = lists.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in chunks(batches, lists.step_rows()):
            x = matrix(batch.column("v"), d)
            number, _, _ = lists.nearest(x)
            order = np.argsort(number, kind="stable")
            starts, _ = runs(number[order])
            met = number[order][starts]
            sums[met] += np.add.reduceat(x[order], starts, axis=0)
            n += np.bincount(number, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(used, pa.int32()), "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64())),
            "n": pa.array(n[used], pa.int64()), "far": pa.array(np.zeros(len(used)), pa.int64()),
        })

    return run


def _assigned(lists: SortedLists, names: list[str]):
    d = lists.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, lists.step_rows()):
            number, distance, compared = lists.nearest(matrix(batch.column("v"), d))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(number, pa.int32()), pa.array(distance, pa.int64()), pa.array(compared, pa.int32())],
                names=[*names, "cluster", "distance", "n_compared"],
            )

    return run


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Clusters of whole-number vectors: (key, cluster, distance, n_compared, cluster_inertia, inertia, centroid_sha256).

    Kept are vectors of exactly ``dims`` components, none null or non-finite; components become floor(scale * x). The
    first centroids are the ``k`` kept rows with the smallest sha256 of "seed:key" (a missing key last; rows of one key
    by their components), so repeated rows count and may be centroids more than once. With fewer than ``k`` kept rows
    there are that many centroids; a table without any gives no rows. Each round assigns all vectors to the nearest
    centroid (ties: the smaller number) and moves every centroid that has vectors to their componentwise
    floor(sum / count). Other columns of ``vectors`` are not read. A component of 2^27 / scale or more is an error.

    Vectors stay where they are: a round moves one partial sum for each centroid and task, and the centroids, k x dims
    numbers, go to every task.
    """
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).alias("raw")).where(finite(F.col("raw"), dims))
    kept = settle(kept.select("id", floored(F.col("raw"), scale).alias("v")))
    ranked = kept.select("v", "id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))
    first = ranked.orderBy(F.asc_nulls_last("h"), F.asc_nulls_last("id"), "v").limit(k).collect()
    out = T.StructType([
        T.StructField(key, vectors.schema[key].dataType), T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()), T.StructField("n_compared", T.IntegerType()),
    ])
    columns = ["cluster_inertia", "inertia", "centroid_sha256"]
    if not first:
        empty = vectors.sparkSession.createDataFrame([], out)
        return empty.select("*", F.lit(None).cast("long").alias(columns[0]), F.lit(None).cast("long").alias(columns[1]), F.lit(None).cast("string").alias(columns[2]))
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        partial = kept.mapInArrow(_sums(SortedLists(centroids)), "cluster int, sums array<long>, n long, far long")
        for number, mean, _, _ in means(partial, ["cluster"], dims):
            centroids[number] = mean
    lists = SortedLists(centroids)
    rows = settle(kept.select(F.col("id").alias(key), "v").mapInArrow(_assigned(lists, [key]), out))
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, s, sum(inertia.values()), digests[c]) for c, s in sorted(inertia.items())]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each of at most k centroids.
    return rows.join(F.broadcast(facts), "cluster").select(*out.names, *columns)
