"""Topic assignment of posts that arrive in chunks, with the placements so far as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stopover.operators.topics import MERGED, ChunkState, merge_chunk

CHUNK_SCHEMA = "conv long, chunk int, kind string, post_ids array<string>, topics map<string,string>, assign map<string,string>"
_COLUMNS = [c.strip().split(" ")[0] for c in MERGED.split(",")]


def _load(state: GroupState) -> ChunkState:
    st = ChunkState()
    if state.exists:
        topics, assign, calls, reseg = state.get
        st.topics, st.assign, st.calls = json.loads(topics), json.loads(assign), calls
        st.reseg = None if reseg < 0 else reseg
    return st


def _save(state: GroupState, st: ChunkState) -> None:
    state.update((json.dumps(st.topics), json.dumps(st.assign), st.calls, -1 if st.reseg is None else st.reseg))


def _merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    st = _load(state)
    rows = [r for pdf in batches for r in pdf.to_dict("records")]
    out = []
    for row in sorted(rows, key=lambda r: (r["chunk"], r["kind"])):
        parsed = {k: list(json.loads(row[k]).items()) for k in ("topics", "assign")}
        out += [[key[0], *[r[c] for c in _COLUMNS]] for r in merge_chunk(st, {**row, **parsed})]
    _save(state, st)
    yield pd.DataFrame(out, columns=["conv", *_COLUMNS])


def merge_chunk_stream(chunks: DataFrame) -> DataFrame:
    """Streaming twin of the batch merge: accepted and refused placements as they arrive.

    Placements already made are frozen in the state of their conversation; a chunk that comes
    again changes nothing. Only one conversation's chunks of a batch are in memory at a time.
    """
    flat = chunks.select("conv", "chunk", "kind", "post_ids", F.to_json("topics").alias("topics"), F.to_json("assign").alias("assign"))
    return flat.groupBy("conv").applyInPandasWithState(
        _merge,
        outputStructType=f"conv long, {MERGED}",
        stateStructType="topics string, assign string, calls int, reseg int",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
