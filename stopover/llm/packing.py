"""Best-fit packing of tokenised documents into sequences under token, document and attention capacities."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopover.llm.common import settle, span_hashes, steps

CAPACITY = 2048
END_ID = 0
# Pieces packed together in one task; a group of this size leaves about one sequence part-filled.
GROUP_PIECES = 16_384
# Sequences of a group that are fuller than this stay; the rest of all groups meet again in the next round.
FULL = 0.97
# Bytes of the longest pre-token merged in numpy steps; a longer one takes too many rounds and goes to the tokenizer itself.
LONGEST = 64
# Pre-tokens whose ids a worker keeps beyond a step.
REMEMBERED = 0

# Fixed values of the vocabulary: the pre-token pattern, with the Unicode blanks spelled out.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


@cache
def _encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words:
    """Ids of texts by a byte-level vocabulary; each different pre-token of a step is merged once, all of them together."""

    def __init__(self, path: str):
        self.tokenizer = _encoder(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = _Merges.of(json.loads(self.tokenizer.to_str()))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of whole texts, one after the other, and the bounds of each text."""
        apart = [i for i, t in enumerate(texts) if any(s in t for s in self.special)] if self.merges else list(range(len(texts)))
        if not apart:
            return self._merged(texts)
        plain, ends = self._merged([t for i, t in enumerate(texts) if i not in set(apart)]) if self.merges else (None, [0])
        whole, tops = self._by_library([texts[i] for i in apart])
        merged, own = zip(ends, ends[1:], strict=False), dict(zip(apart, zip(tops, tops[1:], strict=False), strict=True))
        lists = [whole[slice(*own[i])] if i in own else plain[slice(*next(merged))] for i in range(len(texts))]
        return np.concatenate(lists), np.append(0, np.cumsum([len(x) for x in lists]))

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of each text as the tokenizer itself gives them."""
        lists = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*lists, np.zeros(0, np.uint32)]), np.append(0, np.cumsum([len(x) for x in lists], dtype=np.int64))

    def _merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without special tokens."""
        letter = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        edges = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        begins = _pre_tokens(letter, edges)
        byte = np.append(0, np.cumsum(1 + (letter > 0x7F).astype(np.int8) + (letter > 0x7FF) + (letter > 0xFFFF), dtype=np.int64))
        start, end = byte[begins], byte[np.append(begins[1:], len(letter))[: len(begins)]]
        _, first, part = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        size = end - start
        if (size != size[first][part]).any() or (data != data[_spread(start[first][part], size)]).any():
            first = part = np.arange(len(start))  # two pre-tokens with one hash: each is merged where it stands
        ids, bounds = self._ids(data, start[first], size[first])
        n_ids = np.diff(bounds)[part]
        return ids[_spread(bounds[:-1][part], n_ids)], np.append(0, np.cumsum(n_ids))[np.searchsorted(begins, edges)]

    def _ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every pre-token and their bounds."""
        long = np.flatnonzero(size > LONGEST)
        ids, ends = self._by_library([data[start[i] : start[i] + size[i]].tobytes().decode() for i in long.tolist()])
        done = [(np.repeat(long, np.diff(ends)), ids), *self.merges.apply(data, start, size, np.flatnonzero(size <= LONGEST))]
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(word, kind="stable")].astype(np.uint32), np.append(0, np.cumsum(np.bincount(word, minlength=len(size))))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


LETTER, NUMBER, BLANK, OTHER = range(4)


@cache
def _kinds() -> np.ndarray:
    """Kind of every character: letter, number, blank or other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, f"[{_S}]")):
        found = "".join(regex.findall(pattern, every))
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return kinds


def _pre_tokens(letter: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where each pre-token of PRE_TOKENS begins; none crosses one of ``edges``.

    Letters, numbers and others run on with their kind and take a space before them along. Of other blanks the last one
    before a run stands alone. An apostrophe that begins a pre-token and one of the endings make one of their own.
    """
    n = len(letter)
    kind = _kinds()[letter]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    edge[n] = True
    new = edge[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]  # a run of one kind begins
    blank = kind == BLANK
    led = np.zeros(n, bool)  # a space right before takes the place of the beginning
    led[1:] = (letter[:-1] == 32) & ~edge[1:n]
    lone = np.zeros(n, bool)
    lone[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
    begin = np.where(blank, new | lone, new & ~led)
    mark = np.flatnonzero(begin & (letter == 39))
    stops = np.append(np.flatnonzero(edge), n)
    room = stops[np.searchsorted(stops, mark, "right").clip(max=len(stops) - 1)] - mark
    a, b = (np.append(letter, [0, 0])[mark + k] for k in (1, 2))
    two = (room > 1) & np.isin(a, [ord(c) for c in "stmd"])
    three = (room > 2) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    for short, length in ((mark[two], 2), (mark[three], 3)):
        begin[short + 1] = False
        rest = short + length
        begin[rest[rest < n]] = True
    return np.flatnonzero(begin)


class _Merges:
    """The merges of a byte-level BPE vocabulary as arrays, applied to many pre-tokens at once.

    Each round merges in every word all places of its lowest-ranked pair, from left to right. That is the order of one merge
    at a time as long as a merge never makes a pair of lower rank than its own, which ``of`` checks.
    """

    def __init__(self, first: np.ndarray, keys: np.ndarray, made: np.ndarray):
        self.first, self.made, self.none = first.astype(np.int32), made.astype(np.int32), len(keys)
        self.pairs = pd.Index(keys)

    @classmethod
    def of(cls, vocabulary: dict) -> _Merges | None:
        """None if the vocabulary cannot be applied in this order or has options beyond plain merging."""
        model, before = vocabulary["model"], vocabulary["pre_tokenizer"] or {}
        vocab = model["vocab"]
        bytewise = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not vocabulary["normalizer"]
        letters = _byte_letters()
        plain = bytewise and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or not all(c in vocab for c in letters):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[t] for t in x], np.int64) for x in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        rank = np.arange(len(pairs))
        latest = np.full(max(vocab.values()) + 1, -1)
        latest[made] = rank  # the last merge that makes a token
        keys = left << 32 | right
        if (np.maximum(latest[left], latest[right]) >= rank).any() or len(np.unique(keys)) < len(keys):
            return None
        return cls(np.array([vocab[c] for c in letters]), keys, made)

    def apply(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(word, id) of the given words, none of them empty, in the order of each word's ids."""
        if not len(words):
            return []
        size = size[words]
        starts = np.cumsum(size) - size
        token, done = self.first[data[_spread(start[words], size)]], []
        rank = np.full(len(token), self.none, np.int32)  # of the pair that a token begins

        def look(i: np.ndarray) -> None:
            found = self.pairs.get_indexer(token[i].astype(np.int64) << 32 | token[i + 1])
            rank[i] = np.where(found < 0, self.none, found)

        last = np.zeros(len(token), bool)
        last[starts + size - 1] = True
        look(np.flatnonzero(~last))
        while True:
            low = np.minimum.reduceat(rank, starts)
            live = low < self.none
            if not live.all():
                on = np.repeat(live, size)
                done.append((np.repeat(words[~live], size[~live]), token[~on]))
                token, rank, last = token[on], rank[on], last[on]
                words, size, low = words[live], size[live], low[live]
                if not len(words):
                    return done
                starts = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # of places that overlap, as in a run of one letter, every second one
            run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
            if len(run) < len(hit):
                hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            token[hit] = self.made[rank[hit]]
            last[hit] = last[hit + 1]
            stay = np.ones(len(token), bool)
            stay[hit + 1] = False
            size = np.add.reduceat(stay, starts, dtype=np.int64)
            starts = np.cumsum(size) - size
            token, rank, last = token[stay], rank[stay], last[stay]
            at = hit - np.arange(len(hit))
            rank[at] = self.none
            look(at[~last[at]])
            before = at[at > 0] - 1
            look(before[~last[before]])


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = count(256)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@cache
def _words_of(path: str) -> _Words:
    """The vocabulary of one Python worker, kept from task to task."""
    return _Words(path)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and one end id; a null text is the end id alone. Only documents longer than ``capacity`` are cut,
    the first piece taking what is left over, so that all further ones are full. Pre-tokens never share a token in a
    byte-level vocabulary, so each different one of a step is encoded at most once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words_of(tokenizer), struct.pack("<I", END_ID)
        for batch in steps(batches):
            out: list[list] = [[], [], [], [], []]
            ids_of_all, ends = words.encode([text or "" for text in batch.column("text").to_pylist()])
            held = memoryview(ids_of_all.astype("<u4").tobytes())
            for doc, x, y in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids = memoryview(bytes(held[4 * x : 4 * y]) + end)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(value)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fit(length: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str, weight: tuple[float, float, float]) -> np.ndarray:
    """Bin of each length, longest first, by vector best fit.

    A bin's residual is (tokens, documents, attention cost), each as a share of its capacity; attention costs length squared.
    Of the bins where all three fit, ``rule`` "norm" takes the one that leaves the smallest weighted residual norm, "dot" the
    one whose used shares have the largest weighted dot product with the piece's. Ties take the oldest bin.
    """
    order = np.argsort(-length, kind="stable")
    bins = np.empty(len(length), np.int64)
    rest = np.empty((len(length), 3))
    live = np.empty(len(length), np.int64)
    n_live = made = 0
    least = length.min() if len(length) else 0
    w = np.array(weight)
    full = np.array([1.0, 1.0, 1.0])
    for i in order:
        need = np.array([length[i] / capacity, 1 / max_docs, length[i] ** 2 / max_cost])
        open_bins = live[:n_live]
        have = rest[open_bins]
        fits = np.flatnonzero((have >= need - 1e-12).all(axis=1))
        if len(fits):
            left = have[fits] - need
            best = (left**2 @ w).argmin() if rule == "norm" else (-(1 - left) @ (w * need)).argmin()
            b = open_bins[fits[best]]
        else:
            b, made = made, made + 1
            rest[b] = full
            live[n_live] = b
            n_live += 1
        rest[b] -= need
        bins[i] = b
        if rest[b][0] * capacity < least - 1e-6 or rest[b][1] * max_docs < 1 - 1e-6:
            keep = open_bins != b if len(fits) else np.append(open_bins != b, False)
            kept = live[:n_live][keep]
            n_live = len(kept)
            live[:n_live] = kept
    return bins


def pack(
    piece: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None,
    rule: str = "norm", weight: tuple[float, float, float] = (1.0, 0.0, 0.0), group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Give every piece a ``sequence_id`` and a gapless ``offset``.

    Full pieces are sequences of their own. The others are dealt by the hash of their content into groups of about
    ``group_pieces`` that each task packs by vector best fit, so that no group depends on one source or key. Sequences filled
    to FULL stay; the pieces of all others are dealt anew into fewer groups and packed once more. Without ``max_docs``
    and ``max_cost`` these two capacities are as wide as ``capacity`` tokens allow and never bind.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or float(capacity) ** 2

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = table["length"].to_numpy()
        bins = fit(length, capacity, max_docs, max_cost, rule, weight)
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(length[order]) - length[order]
        first = np.flatnonzero(np.append(True, np.diff(bins[order]) > 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = run - np.repeat(run[first], np.diff(np.append(first, len(bins))))
        filled = np.bincount(bins, weights=length)[bins]
        done = (filled >= FULL * capacity) | (pc.equal(table["last"], True).to_numpy(zero_copy_only=False))
        sequence = table["stride"].to_numpy() + table["g"].to_numpy() * group_span + bins
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("done", pa.array(done))

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    group_span = 1 << 32  # no group has as many sequences
    single = (F.col("length") >= capacity) | (F.col("length") ** 2 >= max_cost) if max_docs > 1 else F.lit(True)
    named = F.struct("doc_id", "piece", "start", "ids_crc32")
    alone = piece.where(single).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, loose, round_no = [settle(alone)], piece.where(~single), 0
    while True:
        loose = settle(loose)
        groups = -(-loose.count() // group_pieces)
        if groups == 0:
            break
        last = groups == 1 or round_no == 1
        dealt = loose.select(
            "*",
            F.pmod(F.xxhash64(F.lit(round_no), named, F.monotonically_increasing_id()), F.lit(groups)).alias("g"),
            F.lit(last).alias("last"), (F.lit(-(1 << 62)) + F.lit(round_no) * F.lit(1 << 56)).cast("long").alias("stride"),
        )
        packed = settle(dealt.groupBy("g").applyInArrow(group, f"{shape}, done boolean"))
        parts.append(packed.where("done").drop("done"))
        loose, round_no = packed.where("not done").select(*piece.columns), round_no + 1
        if last:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(documents: DataFrame, tokenizer: str, **capacities) -> DataFrame:
    """Pieces of all ``documents`` with their sequence and place.

    Rows with a null or repeated doc_id are documents like any other; an empty table gives no piece; other columns are ignored.
    """
    return pack(settle(pieces(documents, tokenizer)), **capacities)
