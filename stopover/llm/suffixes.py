"""Repeated byte strings: anchored segments, and a difference-cover suffix sort, bucket by bucket, of those that differ."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.llm.common import STEP_BYTES, U, buffer_of, mix, settle, steps
from stopover.session import skew_join

SIZE = 400
GRAM = 32  # bytes of an anchor; each window's anchor is its byte string of this length with the smallest hash
RANGE = 93  # windows of an anchor are told apart by the part, of about so many places, in which the anchor lies
# Difference cover: any two places have a distance under COVER to places that both lie in it.
ROOT = 8
COVER = ROOT * ROOT
# Text sorted together, suffixes in one bucket, and distinct segments of one key above which its windows are counted by hash.
BLOCK_BYTES = 4_000_000
BUCKET = 1 << 17
HOT_SEGMENTS = 2_000



@dataclass(frozen=True)
class Window:
    """Windows of ``size`` bytes, the places their anchor can have, and how many of these count as one part."""

    size: int = SIZE

    @property
    def places(self) -> int:
        return self.size - GRAM + 1

    @property
    def range(self) -> int:
        return -(-self.places // max(round(self.places / RANGE), 1))


_BASES = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_CODES = mix(np.arange(1, 257, dtype=U))


class _Hashes:
    """Hashes of any byte range of a buffer, from prefix sums of a polynomial modulo 2^64."""

    powers: dict = {}

    def __init__(self, data: np.ndarray, which: int):
        base, n = _BASES[which], len(data) + 1
        have = self.powers.get(which)
        if have is None or len(have[0]) < n:
            inverse = U(pow(int(base), -1, 1 << 64))
            have = self.powers[which] = tuple(np.multiply.accumulate(np.append(U(1), np.full(max(n, STEP_BYTES + 4 * SIZE), b))) for b in (base, inverse))
        self.down = have[1]
        self.sums = np.zeros(n, U)
        np.cumsum(_CODES[data] * have[0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, ~U(0))]).reshape(-1, width)
    head = np.minimum.accumulate(padded, 1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def _slices(batch: pa.RecordBatch, w: Window) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row bounds, document of each row, place of each row in its document); very long texts in overlapping rows."""
    data, bounds = buffer_of(batch.column("text"))
    doc = batch.column("doc").to_numpy()
    if len(data) <= 2 * STEP_BYTES:
        yield data, bounds, doc, np.zeros(len(doc), np.int64)
        return
    for i in range(len(doc)):
        for a in range(bounds[i], bounds[i + 1], STEP_BYTES):
            part = data[a : min(a + STEP_BYTES + w.size - 1, bounds[i + 1])]
            yield part, np.array([0, len(part)]), doc[i : i + 1], np.array([a - bounds[i]])


def _segments(data: np.ndarray, bounds: np.ndarray, w: Window = Window()) -> dict[str, np.ndarray]:
    """Maximal runs of windows of one row whose anchor is the same and lies in the same range.

    ``key`` hashes the bytes that all windows of that range share around the anchor, ``d`` the bytes of the run itself.
    Equal windows always fall into runs with equal keys, at the same distance from the anchor.
    """
    n = max(len(data) - w.size + 1, 0)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = row[:n] == row[w.size - 1 :] if n else np.zeros(0, bool)
    if not valid.any():
        empty = np.zeros(0, np.int64)
        return {"key": empty.view(U), "d": empty.view(U), "row": empty, "start": empty, "n": empty, "o": empty}
    one, two = _Hashes(data, 0), _Hashes(data, 1)
    at = np.arange(len(data) - GRAM + 1)
    gram = one.of(at, at + GRAM) & U(0xFFFFFFFF00000000) | at.astype(U)
    anchor = (_sliding_min(gram, w.places)[:n] & U(0xFFFFFFFF)).astype(np.int64)
    place = np.arange(n)
    part = (anchor - place) // w.range
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (row[1:n] != row[: n - 1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    start, size = start[valid[start]], size[valid[start]]
    a, r = anchor[start], part[start]
    low = r * w.range
    high = np.minimum(low + w.range, w.places) - 1
    o = a - start
    return {
        "key": mix(one.of(a - low, a - high + w.size) + r.astype(U)), "d": mix(two.of(start, start + size - 1 + w.size) ^ (o * w.places + size).astype(U)),
        "row": row[start], "start": start - bounds[row[start]], "n": size, "o": o,
    }


def _segment_rows(batches: Iterator[pa.RecordBatch], w: Window) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        for data, bounds, doc, base in _slices(batch, w):
            s = _segments(data, bounds, w)
            yield pa.record_batch(
                [pa.array(s["key"].view(np.int64)), pa.array(s["d"].view(np.int64)), pa.array(doc[s["row"]]), pa.array(s["start"] + base[s["row"]]), pa.array((s["o"] << 16 | s["n"]).astype(np.int32))],
                ["key", "d", "doc", "start", "on"],
            )


def _contents(batches: Iterator[pa.RecordBatch], w: Window) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each text; ``d`` is checked, should rows share an id."""
    for batch in steps(batches):
        data, bounds = buffer_of(batch.column("text"))
        out: dict[str, list] = {k: [] for k in ("key", "d", "o", "n", "open", "doc", "start", "bytes")}
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            for x in wanted:
                n, o = x["on"] & 0xFFFF, x["on"] >> 16
                a = bounds[i] + x["start"]
                part = data[a : min(a + n - 1 + w.size, bounds[i + 1])]
                if len(part) < n - 1 + w.size or (mix(_Hashes(part, 1).of(np.array([0]), np.array([len(part)])) ^ U(o * w.places + n)).view(np.int64)[0] != x["d"]):
                    continue
                for k, v in zip(out, (x["key"], x["d"], o, n, x["open"], batch.column("doc")[i].as_py(), x["start"], part.tobytes()), strict=True):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


# The cover: ROOT consecutive places and every multiple of ROOT.
_IN_COVER = np.zeros(COVER, bool)
_IN_COVER[[*range(ROOT), *range(0, COVER, ROOT)]] = True
_NEXT = np.array([[next(k for k in range(COVER) if _IN_COVER[(a + k) % COVER] and _IN_COVER[(b + k) % COVER]) for b in range(COVER)] for a in range(COVER)])


def _eights(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every place as a big-endian number (zeros after the end)."""
    padded = np.concatenate([text, np.zeros(8 + COVER, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(text) + COVER,), (1,))


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks along ``order``, equal where all keys are."""
    new = np.zeros(len(order), np.int64)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(text: np.ndarray, depth: int = SIZE) -> np.ndarray:
    """Rank among the cover places by their first ``depth`` bytes or more (-1 elsewhere): prefixes of COVER bytes, then doubling."""
    eight = _eights(text)
    sample = np.flatnonzero(_IN_COVER[np.arange(len(text)) % COVER])
    keys = [eight[np.minimum(sample + 8 * j, len(text) + COVER - 1)] for j in range(COVER // 8)]
    rank = np.full(len(text) + 1, -1, np.int64)
    rank[sample] = _dense(np.lexsort(keys[::-1]), *keys)
    reach = COVER
    while reach < depth:
        first, second = rank[sample], rank[np.minimum(sample + reach, len(text))]
        second = np.where(sample + reach < len(text), second, -1)
        rank[sample] = _dense(np.lexsort((second, first)), first, second)
        reach *= 2
    return rank


def _settle_ties(place: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of ``place`` (tied within each group over COVER bytes) by the ranks at the nearest cover places.

    Within a residue class all places look the same distance ahead; classes of one group are merged with the distance at
    which both lie in the cover.
    """
    kind = place % COVER
    ahead = rank[np.minimum(place + _NEXT[kind, kind], len(rank) - 1)]
    order = np.lexsort((place, ahead, kind, group))
    first = np.append(True, group[order][1:] != group[order][:-1])
    lone = np.append(True, (group[order][1:] != group[order][:-1]) | (kind[order][1:] == kind[order][:-1]))
    mixed = np.unique(group[order][~lone])
    if not len(mixed):
        return order
    at = np.arange(len(order))
    start = np.maximum.accumulate(np.where(first, at, 0))
    turn = at - start
    pick = np.flatnonzero(np.isin(group[order], mixed))
    g, k, p = group[order][pick], kind[order][pick], place[order][pick]
    span = len(rank) + 2
    position = np.zeros(len(pick), np.int64)
    for a in np.unique(k):
        mine = np.flatnonzero(k == a)
        for b in np.unique(k):
            theirs = np.flatnonzero(k == b)
            d = _NEXT[a, b]
            rank_of = lambda i, d=d: g[i] * span + rank[np.minimum(p[i] + d, len(rank) - 1)] + 1
            sorted_b = np.sort(rank_of(theirs))
            side = "left" if a <= b else "right"
            if a == b:
                position[mine] += np.argsort(np.argsort(rank_of(mine), kind="stable"), kind="stable") - np.searchsorted(np.sort(g[mine] * span), g[mine] * span)
            else:
                position[mine] += np.searchsorted(sorted_b, rank_of(mine), side) - np.searchsorted(sorted_b, g[mine] * span)
    turn[pick] = position
    return order[np.lexsort((turn, start))]


def repeated_windows(text: np.ndarray, place: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Which of the windows at ``place`` occur at another of these places as well.

    Suffixes are sorted one bucket of leading bytes at a time; those equal over COVER bytes are told apart by the ranks of
    cover places behind them, so a bucket needs no more memory than its own keys. Neighbours are compared over ``size`` bytes.
    """
    rank, eight = cover_ranks(text, size), _eights(text)
    lead = eight[place]
    cuts = np.unique(np.quantile(lead.astype(float), np.linspace(0, 1, len(place) // BUCKET + 2))[1:-1]) if len(place) > BUCKET else np.zeros(0)
    bucket = np.searchsorted(cuts, lead.astype(float), "right")
    out = np.zeros(len(place), bool)
    for b in range(len(cuts) + 1):
        own = np.flatnonzero(bucket == b)
        if len(own) < 2:
            continue
        p = place[own]
        keys = [eight[p + 8 * j] for j in range(COVER // 8)]
        group = _dense(np.lexsort(keys[::-1]), *keys)
        order = _settle_ties(p, group, rank)
        left, right = p[order][:-1], p[order][1:]
        live = np.flatnonzero(group[order][:-1] == group[order][1:])
        for j in range(COVER, size, 8):
            j = min(j, size - 8)
            live = live[eight[left[live] + j] == eight[right[live] + j]]
        out[own[order[live]]] = True
        out[own[order[live + 1]]] = True
    return out


def _sorted_blocks(batches: Iterator[pa.RecordBatch], w: Window) -> Iterator[pa.RecordBatch]:
    """Spans (doc, start, n) of repeated windows in the open segments; rows come sorted by key, keys stay together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work() -> pa.RecordBatch:
        block = pa.Table.from_batches(held)
        parts, o, n = block["bytes"].to_pylist(), block["o"].to_numpy(), block["n"].to_numpy()
        # anchors of all segments stand at the same place of the cover, so windows that can be equal do too
        text, base, at = bytearray(), np.empty(len(parts), np.int64), 0
        for i, part in enumerate(parts):
            text += bytes((-int(o[i]) - len(text)) % COVER)
            base[i] = len(text)
            text += part
        place = np.repeat(base - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        found = repeated_windows(np.frombuffer(bytes(text), np.uint8), place, w.size)
        own = np.repeat(np.arange(len(parts)), n)
        found &= np.asarray(block["open"].to_numpy(zero_copy_only=False), bool)[own]
        change = np.ones(len(place), bool)
        change[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1])
        first = np.flatnonzero(change)
        length = np.diff(np.append(first, len(place)))
        first, length = first[found[first]], length[found[first]]
        at = own[first]
        return pa.record_batch(
            [pa.array(block["doc"].to_numpy()[at]), pa.array(block["start"].to_numpy()[at] + place[first] - base[at]), pa.array(length.astype(np.int32))], ["doc", "start", "n"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        total = np.cumsum(np.asarray(pc.binary_length(batch.column("bytes"))))
        changes = np.flatnonzero(np.append(key[0] != last, key[1:] != key[:-1]))
        at = 0
        while True:  # the block ends at the first new key after it is full
            done = total[at - 1] if at else 0
            full = np.searchsorted(total, done + max(BLOCK_BYTES - size, 0))
            full = max(int(full), at)
            ends = changes[changes >= full] if size else changes[changes > full]
            if not len(ends):
                held.append(batch.slice(at))
                size += int(total[-1] - done)
                break
            held.append(batch.slice(at, int(ends[0]) - at))
            yield work()
            held, size, at = [], 0, int(ends[0])
        last = key[-1]
    if held:
        yield work()


def _window_rows(batches: Iterator[pa.RecordBatch], w: Window) -> Iterator[pa.RecordBatch]:
    """Every window of the segments of hot keys by two hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = np.frombuffer(batch.column("bytes")[i].as_py(), np.uint8)
            n = batch.column("n")[i].as_py()
            at = np.arange(n)
            w1, w2 = (_Hashes(part, k).of(at, at + w.size).view(np.int64) for k in (0, 1))
            same = [pa.array([batch.column(c)[i].as_py()] * n, batch.column(c).type) for c in ("doc", "open")]
            yield pa.record_batch([pa.array(w1), pa.array(w2), *same, pa.array(at + batch.column("start")[i].as_py())], ["w1", "w2", "doc", "open", "at"])


def _kept(batches: Iterator[pa.RecordBatch], w: Window) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        data, bounds = buffer_of(batch.column("text"))
        removed, runs, digest, text = [], [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            part = data[bounds[i] : bounds[i + 1]]
            if spans:
                a = np.array([s["start"] for s in spans])
                b = np.minimum(a + np.array([s["n"] for s in spans]) - 1 + w.size, len(part))
                a, b = a[b > a], b[b > a]
                change = np.bincount(a, minlength=len(part) + 1) - np.bincount(b, minlength=len(part) + 1)
                gone = np.cumsum(change[:-1]) > 0
                part, n, k = part[~gone], int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
            else:
                n = k = 0
            left = part.tobytes()
            removed.append(n)
            runs.append(k)
            digest.append(hashlib.sha256(left).hexdigest())
            text.append(left.decode(errors="ignore"))
        yield pa.record_batch(
            [batch.column("_row"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(text)],
            ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def _doc() -> Column:
    """A row's key: 64-bit hash of its id (or that it has none) and its text; only rows repeated in full share one."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "text")


def repeated_spans(documents: DataFrame, w: Window = Window()) -> DataFrame:
    """(doc, spans), doc as in ``_doc``, with spans (start, n): runs of windows of w.size bytes that also start anywhere else.

    1. Every window belongs to a segment by its anchor. Keys that occur once have no repeated window.
    2. Keys whose segments are all equal, and segments that occur twice, are repeated as a whole.
    3. One text of each other distinct segment goes, with those of its key, into the suffix sort of a block.
    4. Keys with more than HOT_SEGMENTS distinct segments have their windows counted by hash instead, spread over all tasks.
    """
    rows = documents.select(_doc().alias("doc"), "text").where(F.octet_length("text") >= w.size)
    segments = rows.mapInArrow(partial(_segment_rows, w=w), "key long, d long, doc long, start long, on int")
    keys = segments.groupBy("key").agg(F.count("*").alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi")).where("c > 1")
    keys = settle(keys.select("key", (F.col("lo") != F.col("hi")).alias("mixed")))
    shared = settle(skew_join(segments, keys, ["key"], [F.col("doc")]))
    kinds = settle(shared.where("mixed").groupBy("key", "d").agg(F.count("*").alias("c"), F.min(F.struct("doc", "start", "on")).alias("s")))
    per_key = settle(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("least = 1").select("key", "kinds"))
    whole = shared.where("not mixed").select("doc", "start", "on").union(
        skew_join(shared.where("mixed"), kinds.where("c > 1").select("key", "d"), ["key", "d"], [F.col("doc")], "left_semi").select("doc", "start", "on"))
    spans = [whole.select("doc", "start", F.expr("on & 65535").alias("n"))]
    wanted = kinds.join(per_key, "key").select("s.doc", F.struct("key", "d", "s.start", "s.on", (F.col("c") == 1).alias("open")).alias("w"), "kinds")
    texts = rows.join(wanted.groupBy("doc").agg(F.collect_list("w").alias("wanted")), "doc")
    shape = "key long, d long, o int, n int, open boolean, doc long, start long, bytes binary"
    contents = settle(texts.mapInArrow(partial(_contents, w=w), shape))
    hot = per_key.where(F.col("kinds") > HOT_SEGMENTS).select("key")
    cold = contents.join(hot, "key", "left_anti")
    blocks = max(contents.sparkSession.sparkContext.defaultParallelism, contents.count() * (w.size + w.range) // (4 * BLOCK_BYTES) + 1)
    spans.append(cold.repartition(int(blocks), "key").sortWithinPartitions("key").mapInArrow(partial(_sorted_blocks, w=w), "doc long, start long, n int"))
    windows = settle(skew_join(contents, hot, ["key"], [F.col("doc")], "left_semi").mapInArrow(partial(_window_rows, w=w), "w1 long, w2 long, doc long, open boolean, at long"))
    twice = settle(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"))
    spans.append(skew_join(windows.where("open"), twice, ["w1", "w2"], [F.col("doc")], "left_semi").select("doc", F.col("at").alias("start"), F.lit(1).alias("n")))
    return settle(spans[0].union(spans[1]).union(spans[2]).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans")))


def drop_repeated_strings(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """``documents`` with n_bytes, n_removed, n_spans, kept_sha256 and kept_text (what is left; cut characters drop out).

    Bytes covered by a string of ``size`` bytes (2 x GRAM at least) that also starts elsewhere go, in all places alike.
    A null text is empty. Occurrences in rows repeated in full count; rows without an id, or that
    share one with different texts, lose the places of their own text. An empty table gives an empty result; clashing columns are replaced.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    w = Window(size)
    rows = documents.drop(*new).withColumn("doc", _doc())
    joined = rows.join(repeated_spans(documents, w), "doc", "left").drop("doc")
    carried = [c for c in joined.columns if c not in ("text", "spans")]
    packed = joined.select(F.struct(*carried).alias("_row"), "text", "spans")
    row = packed.schema["_row"].dataType.simpleString()
    out = packed.mapInArrow(partial(_kept, w=w), f"_row {row}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.select("_row.*", *new)
