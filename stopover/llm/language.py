"""Language identification: logistic regression on TF-IDF character n-grams, FTRL with elastic net, temperature scaling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopover.llm.common import U, buffer_of, mix, settle, steps

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
# Different texts that the regression takes: so many shared evenly by the languages, but at least the second number for each
# language that has them. One in CALIBRATION_STEP sets the temperature instead. Document frequencies take all texts.
SAMPLE_DOCS = 5_000
LANGUAGE_DOCS = 200
CALIBRATION_STEP = 5
# A text's n-gram shares are small numbers; they are multiplied by this before the regression.
SCALE = 30.0
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 after division by 3 (null id: learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and number of every character of valid UTF-8 bytes; A-Z are folded to a-z, blanks to one space."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(data)))
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    code = padded[lead]
    for k in range(1, 4):
        code = np.where(size > k, code << 8 | padded[lead + k], code)
    code = np.where((code >= 65) & (code <= 90), code + 32, code)
    return lead, np.where(code <= 32, 32, code)


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram of the rows of a buffer and the row it lies in; no n-gram crosses rows."""
    lead, code = _code_points(data)
    row = np.searchsorted(bounds, lead, "right") - 1
    out, rows = [], []
    run = np.zeros(len(code), U)
    for k in range(max(ORDERS)):
        run = run[: len(code) - k] * U(0x100000001B3) + code[k:].astype(U) + U(1)
        if k + 1 in ORDERS:
            same = row[: len(run)] == row[k : k + len(run)]
            out.append((mix(run[same] ^ U(k)) & U(BUCKETS - 1)).astype(np.int32))
            rows.append(row[: len(run)][same])
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Model:
    """Languages, document-frequency weights, regression weights (bucket by language, IDF folded in), bias, temperature."""

    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Summed weights over TF (share of the text's n-grams) and IDF of every row; zero features give the bias."""
        n = len(bounds) - 1
        bucket, row = grams(data, bounds)
        total = np.maximum(np.bincount(row, minlength=n), 1)
        folded = self.weight * self.idf[:, None]
        sums = [np.bincount(row, weights=folded[:, j][bucket], minlength=n) for j in range(len(self.languages))]
        return SCALE * np.stack(sums, 1) / total[:, None] + self.bias


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and in how many of them each bucket occurs, over all rows; one array of BUCKETS counts leaves a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in steps(batches):
            data, bounds = buffer_of(batch.column("text"))
            bucket, row = grams(data, bounds)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(len(bounds)))
            bucket = bucket[order]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                seen[np.bincount(bucket[a:b], minlength=BUCKETS) > 0] += 1
            n += batch.num_rows
        held = np.flatnonzero(seen)
        yield pa.record_batch([pa.array([-1, *held.tolist()], pa.int32()), pa.array([n, *seen[held].tolist()], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    df, n = np.zeros(BUCKETS), 0
    for bucket, count_ in rows:
        if bucket < 0:
            n = count_
        else:
            df[bucket] = count_
    return n, df


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets of every whole text."""
    for batch in steps(batches):
        data, bounds = buffer_of(batch.column("text"))
        bucket, row = grams(data, bounds)
        key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
        cuts = pa.array(np.searchsorted(key, np.arange(len(bounds)) * BUCKETS).astype(np.int32))
        yield pa.record_batch(
            [batch.column("o"), batch.column("lang"), batch.column("r"), pa.ListArray.from_arrays(cuts, pa.array((key % BUCKETS).astype(np.int32))),
             pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32)))], ["o", "lang", "r", "bucket", "n"],
        )


def _ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Follow-the-regularised-leader (proximal) for multinomial logistic regression with elastic-net penalties."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(x)):
            at, value = x[i]
            w = weights(at)
            p = value @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = np.outer(value, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def _drawn(rows: DataFrame, sample_docs: int, language_docs: int) -> DataFrame:
    """(o, lang, r): hash and rank of the different texts drawn for each language, the first in the order of the hash.

    Copies of a text count once, so no group of copies takes the place of other texts. The languages' different texts are
    counted first; a share of the hashes that holds about twice the number wanted is then ranked, never a whole language.
    """
    keys = rows.select(F.xxhash64("text", F.lit(7)).alias("o"), "lang").distinct()
    held = keys.groupBy("lang").agg(F.count("*").alias("n"))
    wanted = F.greatest(F.ceil(F.lit(sample_docs) / F.col("languages")), F.lit(language_docs))
    held = held.crossJoin(F.broadcast(held.agg(F.count("*").alias("languages")))).select("lang", "n", wanted.alias("wanted"))  # one row
    first = keys.join(F.broadcast(held), "lang").where(  # one row a language
        F.shiftrightunsigned("o", 11) < (2 * F.col("wanted") + 64) / F.col("n") * F.lit(float(1 << 53))
    )
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("o", 11), "o")))
    return ranked.where("r <= wanted").select("o", "lang", "r")


def fit(
    documents: DataFrame, sample_docs: int = SAMPLE_DOCS, language_docs: int = LANGUAGE_DOCS, epochs: int = 2,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3,
) -> Model | None:
    """Fit on labelled documents that are not held out; None if there is none.

    Document frequencies take every such text. The regression takes at most ``sample_docs`` different texts, or
    ``language_docs`` for each language if that is more, by a hash of the text, so repeated runs take the same ones and every
    language that is labelled at all is learned.
    """
    rows = documents.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("text", "lang")
    n, df = document_frequencies(rows)
    if n == 0:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    drawn = settle(_drawn(rows, sample_docs, language_docs))
    texts = rows.withColumn("o", F.xxhash64("text", F.lit(7))).join(F.broadcast(drawn), ["o", "lang"]).dropDuplicates(["o", "lang"])
    sample = texts.select("o", "lang", "r", "text").mapInArrow(_features, "o long, lang string, r int, bucket array<int>, n array<int>")
    sample = sample.orderBy("o", "lang").toArrow()  # the documented sample, at most BUCKETS counts a text
    lang, rank = np.array(sample["lang"].to_pylist(), object), np.asarray(sample["r"])
    languages, y = np.unique(lang.astype(str), return_inverse=True)
    at, count = sample["bucket"].combine_chunks(), sample["n"].combine_chunks()
    cuts, at, count = np.asarray(at.offsets) - at.offsets[0].as_py(), np.asarray(at.flatten()).astype(np.int64), np.asarray(count.flatten()).astype(float)
    x = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x.append((np.append(at[a:b], BUCKETS), np.append(SCALE * count[a:b] / max(count[a:b].sum(), 1) * idf[at[a:b]], 1.0)))
    aside = rank % CALIBRATION_STEP == 0
    learn = np.flatnonzero(~aside)
    tune = np.flatnonzero(aside) if aside.any() else learn
    w, bias = _ftrl([x[i] for i in learn], y[learn], len(languages), epochs, alpha, beta, l1, l2)
    model = Model(languages.tolist(), idf, w, bias)
    full = np.vstack([w, bias])
    logits = np.array([x[i][1] @ full[x[i][0]] for i in tune])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    model.temperature = float(min(grid, key=lambda t: _loss(logits / t, y[tune])))
    return model


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    logits = logits - logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(y)), y]).mean())


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (calibrated probability) of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned. Null ids count as not
    held out; repeated rows give equal rows; an empty table gives none; other columns are ignored; nothing but the text enters
    a prediction. Without ``model`` one is fitted.
    """
    model = model or fit(documents)
    shape = "doc_id long, held_out boolean, lang_pred string, score double"
    rows = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in steps(batches):
            data, bounds = buffer_of(batch.column("text"))
            logits = model.logits(data, bounds) / model.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            letters = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool)
            names = np.array(model.languages, object)[p.argmax(axis=1)]
            names[~letters] = UNKNOWN
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(np.where(letters, p.max(axis=1), 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(predict, shape)
