"""Helpers shared by the training-data operators: word columns, packed word hashes, lineage cuts."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopover.session import cut_lineage

BLANKS = "[\\x20\\x09-\\x0D]+"
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Bytes of text that one numpy step looks at; a longer text is a step of its own.
STEP_BYTES = 2_000_000

# The driver's garbage is collected after a checkpoint, if the last time is so many seconds ago.
COLLECT_EVERY_S = 1
_collected = [0.0]

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; what only led to it can then be freed.

    The JVM is asked to collect, so that Spark's cleaner drops the shuffle files of plans
    that nothing refers to any more instead of keeping them to the end of the job.
    """
    out, context = cut_lineage(df), df.sparkSession.sparkContext
    del df
    if time.monotonic() - _collected[0] > COLLECT_EVERY_S:
        gc.collect()
        for _ in range(2):  # what holds the plan's shuffles goes with the first collection, they with the second
            context._jvm.System.gc()
            time.sleep(0.1)
        _collected[0] = time.monotonic()
    return out


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character left alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column, breaks: str) -> Column:
    """Words of ``text`` between ``breaks``; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), breaks)
    return F.array_remove(parts, "")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about STEP_BYTES of text each, so that memory stays bounded."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        run = np.cumsum(sizes) // STEP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the bounds of its rows (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(U), (len(data) + 1,), (1,)) if len(data) else np.zeros(1, U)
    out = (end - start).astype(U) * _ODD
    live, at = np.arange(len(start)), start
    while len(live):
        left = end[live] - at
        chunk = eight[np.minimum(at, len(data))]
        short = left < 8
        chunk = np.where(short, chunk & ((U(1) << (U(8) * np.clip(left, 0, 7).astype(U))) - U(1)), chunk)
        out[live] = mix(out[live] * _ODD ^ chunk)
        more = left > 8
        live, at = live[more], at[more] + 8
    return out


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between blanks of all rows of a buffer: (row bounds in words, start byte, end byte, hash).

    Blanks are \\x20 and \\x09-\\x0D; no word crosses a row. ``lower`` hashes A-Z as a-z.
    """
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(start, bounds), start, end, span_hashes(data, start, end)


def run_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (rows are not told apart)."""
    n = max(len(word) - k + 1, 0)
    out = np.zeros(n, U)
    for j in range(k):
        out = mix(out * _ODD + word[j : j + n])
    return out


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a long column."""
    return pa.array(x.view(np.int64))
