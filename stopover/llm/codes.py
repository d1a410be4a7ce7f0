"""Vector codes from codebooks of vector parts, trained by ball k-means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopover.llm.common import settle
from stopover.llm.vectors import chunks, finite, floored, lists, matrix, means, runs
from stopover.session import skew_join

# Rows of one numpy step.
STEP_ROWS = 10_000
# Labels whose sums are sent to every task (16 bytes each); more of them are joined by a shuffle.
BROADCAST_LABELS = 100_000


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def block(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c``, exact; by floating-point products while those are exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(largest) ** 2 < 1 << 53:
        y, d = x.astype(float), c.astype(float)
        return (np.einsum("ij,ij->i", y, y)[:, None] - 2.0 * (y @ d.T) + np.einsum("ij,ij->i", d, d)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, entry in enumerate(c):
        out[:, j] = squared(x, entry)
    return out


class Balls:
    """One codebook (entries x width) with, for each entry's ball, the neighbour entries sorted by distance.

    ``reach``: per entry, a whole number no smaller than the distance of any of its members, or -1 without members.
    An entry is a neighbour if it is no farther than twice that. A member nearer than half the way to the nearest
    neighbour lies in the stable core and stays. Others lie in a ring: with m neighbours no farther than twice the
    member's distance, these m are its only candidates. All comparisons are of whole squares, so ties are exact:
    an entry at exactly twice the distance may tie and is compared.
    """

    def __init__(self, entries: np.ndarray, reach: np.ndarray | None = None):
        self.entries = entries
        if reach is None:
            return
        apart = np.stack([squared(entries, e) for e in entries]) if len(entries) else np.zeros((0, 0), np.int64)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.order = np.argsort(apart, axis=1, kind="stable")
        apart = np.take_along_axis(apart, self.order, axis=1)
        limit = [min(4 * int(r) ** 2, np.iinfo(np.int64).max - 1) if r >= 0 else -1 for r in reach]
        # What is no neighbour of the ball lies behind all of them.
        apart[apart > np.array(limit, np.int64)[:, None]] = np.iinfo(np.int64).max
        self.quarter = -(-apart // 4)  # the least squared distance of a member that an entry concerns

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row among all, as the first round needs it."""
        distance = block(x, self.entries)
        return distance.argmin(axis=1), distance.min(axis=1)  # the first least

    def move(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row from the entry it had: (code, squared distance, pairs compared)."""
        code = code.copy()
        error = squared(x, self.entries[code])
        at, ring = self.rings(code, error)
        old = code[at]
        for a, b in zip(*runs(old), strict=True):
            row, many = at[a:b], ring[a:b]
            near = self.order[old[a], : many.max()]
            distance = block(x[row], self.entries[near])
            distance[np.arange(len(near)) >= many[:, None]] = np.iinfo(np.int64).max
            least = distance.min(axis=1)
            entry = np.where(distance == least[:, None], near, len(self.entries)).min(axis=1)
            better = (least < error[row]) | ((least == error[row]) & (entry < code[row]))
            code[row[better]], error[row[better]] = entry[better], least[better]
        return code, error, len(x) + int(ring.sum())

    def rings(self, code: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows outside their entry's stable core, and how many of its neighbours each must be compared with."""
        if self.quarter.shape[1] == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(error >= self.quarter[code, 0])
        ring = np.zeros(len(at), np.int64)
        by = np.argsort(code[at], kind="stable")
        at = at[by]
        held = code[at]
        for a, b in zip(*runs(held), strict=True):
            ring[a:b] = np.searchsorted(self.quarter[held[a]], error[at[a:b]], "right")
        return at, ring


def _coded(balls: list[Balls], names: list[str], width: int):
    """Codes and errors of every part; ``codes`` of the last round are moved, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, STEP_ROWS):
            v = matrix(batch.column("v"), width * len(balls))
            old = matrix(batch.column("codes"), len(balls)) if "codes" in batch.schema.names else None
            found = []
            for p, ball in enumerate(balls):
                x = v[:, p * width : (p + 1) * width]
                found.append(ball.search(x) if old is None else ball.move(x, old[:, p])[:2])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), lists(np.stack([f[0] for f in found], axis=1), pa.int32()), lists(np.stack([f[1] for f in found], axis=1), pa.int64())],
                names=[*names, "codes", "errors"],
            )

    return run


def _sums(parts: int, entries: int, width: int):
    """Per part and entry that a task met: sum and number of its parts and the largest squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, far = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64), np.zeros(parts * entries, np.int64)
        for batch in chunks(batches, STEP_ROWS):
            v = matrix(batch.column("v"), width * parts).reshape(-1, width)
            at = (matrix(batch.column("codes"), parts) + np.arange(parts) * entries).ravel()
            error = matrix(batch.column("errors"), parts).ravel()
            order = np.argsort(at, kind="stable")
            starts, _ = runs(at[order])
            met = at[order][starts]
            sums[met] += np.add.reduceat(v[order], starts, axis=0)
            n += np.bincount(at, minlength=parts * entries)
            far[met] = np.maximum(far[met], np.maximum.reduceat(error[order], starts))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(used // entries, pa.int32()), "entry": pa.array(used % entries, pa.int32()),
            "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64())), "n": pa.array(n[used], pa.int64()), "far": pa.array(far[used], pa.int64()),
        })

    return run


def _ceil_root(x: int) -> int:
    r = isqrt(int(x))
    return r + (r * r < x)


def compress_vectors(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Codes of whole-number vectors: (key, code, error, label_error, codebooks_sha256), one row for each kept row.

    Rows whose vector is null, empty or holds null or non-finite components are dropped; components become
    floor(scale * x). Vectors are cut into ``parts`` equal parts. Each part position's codebook starts as that part of
    the ``entries`` kept rows with the smallest keys (a missing key last; rows of one key by their components); with
    fewer rows it has that many entries, and a table without any gives no rows. The vector of the smallest key fixes
    the length; its length must be a multiple of ``parts``, and kept vectors of another length keep their row with null
    code and error. ``label_error`` is summed over equal labels, missing ones together. Repeated rows count. Other
    columns are not read. A component of 2^27 / scale or more is an error.

    Each round moves the parts from the codes of the round before by :class:`Balls`; only the first one searches whole
    codebooks. An entry's ball must hold its members after the entry moved: the farthest member it had, from a maximum
    taken with the sums, plus the entry's own way. Codebooks (parts x entries x width numbers) go to every task;
    vectors stay where they are, and each round writes them with their codes to the shared folder.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    kept = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("raw")).where(finite(F.col("raw")))
    kept = settle(kept.select("id", "label", floored(F.col("raw"), scale).alias("v")))
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    length = len(first[0]["v"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    width = length // parts
    fits = F.size("v") == length
    start = kept.where(fits).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    held = books.shape[1]
    label_kind = vectors.schema[label].dataType.simpleString()
    schema = f"id {kind}, label {label_kind}, v array<long>, codes array<int>, errors array<long>"
    state, reach = kept.where(fits), [None] * parts
    for turn in range(rounds + 1):
        balls = [Balls(b, r) for b, r in zip(books, reach, strict=True)]
        state = settle(state.mapInArrow(_coded(balls, ["id", "label", "v"], width), schema))
        if turn == rounds:
            break
        partial = state.mapInArrow(_sums(parts, held, width), "part int, entry int, sums array<long>, n long, far long")
        moved, reach = books.copy(), [np.full(held, -1, np.int64) for _ in range(parts)]
        for part, entry, mean, _, far in means(partial, ["part", "entry"], width):
            moved[part, entry] = mean
            way = squared(books[part, entry][None], moved[part, entry][None])[0]
            reach[part][entry] = _ceil_root(far) + _ceil_root(way)
        books = moved
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    hexed = F.concat(*[F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(parts)])
    done = state.select("id", "label", hexed.alias("code"), F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    other = kept.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    done = done.unionByName(other)
    # Missing labels share a key of their own; partial sums meet, not rows.
    named = done.select("*", F.col("label").isNull().alias("_none"), F.coalesce(F.col("label"), F.lit(0).cast(label_kind)).alias("_label"))
    totals = settle(named.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")))
    if totals.count() <= BROADCAST_LABELS:
        out = named.join(F.broadcast(totals), ["_none", "_label"])
    else:
        out = skew_join(named, totals, ["_none", "_label"], ["id", "code"])
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
