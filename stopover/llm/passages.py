"""Repeated passages: a word-level De Bruijn graph of repeated windows, compacted and traced back to source coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopover.llm.common import U, buffer_of, mix, run_hashes, settle, steps, word_hashes
from stopover.session import skew_join

WINDOW = 13
# Every window holds six runs of eight words; the one with the smallest hash is its anchor.
ANCHOR = 8
NO_ID = (1 << 63) - 1  # a null doc_id counts as larger than any
WHOLE = (1 << 31) - 1
# Bits of the map of documents that go on (8 MB): a document marked by chance only costs its way through the shuffle.
SLOTS = 1 << 26


def _anchors(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor and the anchor's hash (rows are not told apart)."""
    value = mix(run_hashes(word, ANCHOR))
    place = np.arange(len(value))
    width, want = 1, WINDOW - ANCHOR + 1
    while width < want and len(value):
        s = min(width, want - width)
        smaller = value[s:] < value[: len(value) - s]
        place = np.where(smaller, place[s:], place[: len(place) - s])
        value = np.where(smaller, value[s:], value[: len(value) - s])
        width += s
    return place, value


def _windows(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word, and which windows lie within one row."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    m = max(n - WINDOW + 1, 0)
    return row, row[:m] == row[n - m :]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc, key, pos) of every anchor, once a place."""
    for batch in steps(batches):
        rows, _, _, word = word_hashes(*buffer_of(batch.column("text")))
        row, inside = _windows(rows, len(word))
        place, value = _anchors(word)
        place, value = place[: len(inside)][inside], value[: len(inside)][inside]
        new = np.append(True, place[1:] != place[:-1])[: len(place)]
        place, value = place[new], value[new]
        doc, key = (pa.array(batch.column(c).to_numpy()[row[place]]) for c in ("doc", "key"))
        yield pa.record_batch([pa.array(value.view(np.int64)), doc, key, pa.array((place - rows[row[place]]).astype(np.int32))], ["h", "doc", "key", "pos"])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e, nodes, doc, key, pos) of the windows at the given anchors: e is the window's hash, nodes those of its first and last 12 words."""
    for batch in steps(batches):
        rows, _, _, word = word_hashes(*buffer_of(batch.column("text")))
        row, inside = _windows(rows, len(word))
        place, _ = _anchors(word)
        wanted = np.zeros(len(word) + 1, bool)
        anchors = batch.column("anchors")
        wanted[np.repeat(rows[:-1], np.diff(np.asarray(anchors.offsets))) + np.asarray(anchors.flatten())] = True
        at = np.flatnonzero(inside & wanted[place[: len(inside)]])
        edge, node = run_hashes(word, WINDOW)[at], mix(run_hashes(word, WINDOW - 1)) >> U(32)
        nodes = node[at] << U(32) | node[at + 1]
        doc, key = (pa.array(batch.column(c).to_numpy()[row[at]]) for c in ("doc", "key"))
        yield pa.record_batch(
            [pa.array(edge.view(np.int64)), pa.array(nodes.view(np.int64)), doc, key, pa.array((at - rows[row[at]]).astype(np.int32))],
            ["e", "nodes", "doc", "key", "pos"],
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts and the hash of the words that no removed window covers."""
    for batch in steps(batches):
        rows, start, end, _ = word_hashes(*buffer_of(batch.column("text")))
        data, _ = buffer_of(batch.column("text"))
        n_words, n_removed, digest = np.diff(rows), [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            a, b = rows[i], rows[i + 1]
            change = np.zeros(b - a + 1, np.int64)
            for x in spans or ():
                if x["start"] + WINDOW <= b - a:
                    change[x["start"]] += 1
                    change[min(x["start"] + x["n"] - 1 + WINDOW, b - a)] -= 1
            keep = np.flatnonzero(np.cumsum(change[:-1]) <= 0) + a
            n_removed.append(b - a - len(keep))
            digest.append(hashlib.sha256(b" ".join([data[s:e].tobytes() for s, e in zip(start[keep], end[keep], strict=True)])).hexdigest())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n_words), pa.array(n_removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, doc (its order: the id, null last) and key: rows of one doc and key are one document.

    The key is the text's hash for rows without an id, and for all rows if any id has different texts; else zero, which costs
    no room in the shuffles.
    """
    own = F.xxhash64("text")
    rows = documents.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    texts = rows.where("doc_id is not null and text is not null").groupBy("doc").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    one = texts.where("lo <> hi").isEmpty()
    return rows.withColumn("key", F.when(F.col("doc_id").isNull(), own).otherwise(F.lit(0).cast("long")) if one else own)


def _copies(rows: DataFrame) -> DataFrame:
    """Documents (doc, key) whose whole text also belongs to a smaller one."""
    named = rows.select("doc", "key", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    shared = settle(named.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("t1", "t2", "first"))
    return settle(skew_join(named, shared, ["t1", "t2"], [F.col("doc")]).where("doc > first").select("doc", "key").distinct())


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most documents (doc, key) that ``wanted`` does not hold; they are told apart where they lie, by a map of bits."""
    slot = F.pmod(F.xxhash64("doc", "key"), F.lit(SLOTS)).alias("slot")
    bits = wanted.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    met = rows.withColumn("slot", slot).withColumn("bucket", F.bitmap_bucket_number("slot")).join(F.broadcast(settle(bits)), "bucket")
    place = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(rows.columns)


def _repeated(edges: DataFrame) -> DataFrame:
    """Edges seen twice or more, with their nodes and their first place."""
    first = edges.groupBy("e").agg(F.min(F.struct("doc", "key", "pos", "nodes")).alias("s"), F.count("*").alias("c")).where("c > 1")
    return first.select("e", F.col("s.doc").alias("sdoc"), F.col("s.key").alias("skey"), F.col("s.pos").alias("spos"), "s.nodes")


def _paths(edges: DataFrame) -> DataFrame:
    """Edges with the start of the nonbranching path they lie on, in the coordinates of the path's first source.

    A node is passed through if one repeated edge enters and one leaves it. Edges whose first occurrences follow each other
    in one source over such a node are one path.
    """
    node = F.shiftrightunsigned("nodes", 32).alias("node"), F.expr("nodes & 4294967295").alias("node")
    degree = edges.select(node[0], F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(node[1], F.lit(1).alias("i"), F.lit(0).alias("o")))
    through = degree.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i = 1 and o = 1").select("node")
    flagged = edges.withColumn("node", node[0]).join(through.withColumn("on", F.lit(True)), "node", "left")
    order = Window.partitionBy("sdoc", "skey").orderBy("spos")
    breaks = F.when(F.col("on") & (F.lag("spos").over(order) == F.col("spos") - 1), None).otherwise(F.col("spos"))
    return flagged.withColumn("breaks", breaks).select("e", "sdoc", "skey", "spos", F.last("breaks", True).over(order).alias("path"))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(doc, key, spans) of ``_keyed`` rows: runs of windows, as (start, n), whose words also start in a document with a smaller id.

    1. Windows that are equal have equal anchors: only those at anchors that two documents share go on.
    2. Their windows are the edges of a De Bruijn graph; those seen twice are repeated.
    3. Repeated edges are compacted into nonbranching paths, placed at the first source that holds them.
    4. Each later document's windows on one path at one distance from its source, without a gap, are a span.
    Whole copies of a smaller document are one span and stay out of the graph. Hashes have 64 bits.
    """
    rows = keyed.select("doc", "key", "text").where("text is not null")
    copies = _copies(rows)
    anchors = rows.mapInArrow(_anchor_rows, "h long, doc long, key long, pos int")
    shared = settle(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    near = skew_join(anchors, shared, ["h"], [F.col("doc")]).select("doc", "key", "pos")
    near = near.groupBy("doc", "key").agg(F.collect_set("pos").alias("anchors"))
    # not an anti join: it would be moved below the join on h and deal all anchors out by document first
    near = settle(near.join(copies.withColumn("copy", F.lit(True)), ["doc", "key"], "left").where("copy is null").drop("copy"))
    # most texts may have no such anchor, and need not be dealt out to find that
    edges = _marked(rows, near).join(near, ["doc", "key"]).mapInArrow(_edge_rows, "e long, nodes long, doc long, key long, pos int")
    paths = settle(_paths(settle(_repeated(edges))))  # unnamed steps, so that their shuffles and the edges' checkpoint can go
    on_path = skew_join(edges.select("e", "doc", "key", "pos"), paths, ["e"], [F.col("doc")]).where("doc > sdoc")
    on_path = on_path.withColumn("shift", F.col("pos") - F.col("spos"))
    run = Window.partitionBy("doc", "key").orderBy("sdoc", "skey", "path", "shift", "pos")  # a document's windows
    spans = on_path.withColumn("island", F.col("pos") - F.row_number().over(run)).groupBy("doc", "key", "sdoc", "skey", "path", "shift", "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"))
    spans = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return settle(spans.unionByName(copies.select("doc", "key", F.expr(f"array(struct(0 as start, {WHOLE} as n))").alias("spans"))))


def drop_repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words, one row per row of ``documents``.

    Words lie between blanks (\\x20, \\x09-\\x0D) and stay unchanged. A null text has none; a null doc_id counts as larger than
    any other; rows repeated in full are one document; rows without an id, or that share one with different texts, lose
    the places of their own text, as nothing that they repeat of each other starts in a smaller id. An empty table gives an empty result; other columns are ignored.
    """
    rows = _keyed(documents)
    spans = repeated_spans(rows).groupBy("doc", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
