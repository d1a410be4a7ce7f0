"""Substring-containment joins: one automaton pass per text for counted name tables, equi-joins on leading grams beyond."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopover.session import skew_join

# A name is looked up by its first characters, at most this many.
LEAD_CHARS = 8
# Name tables up to this many names and characters go to every task as an automaton (about 100 bytes a character).
AUTOMATON_NAMES = 100_000
AUTOMATON_CHARS = 1_000_000


def _grams(text: str, n: int):
    """Distinct substrings of length ``n``, read off one pass of the text."""
    dots = "." * n
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=({dots}))"), 1))


def _scan(names: list[str], key: str, text: str, name: str):
    """Every name that a text holds, found in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, n in enumerate(names):
            automaton.add_word(n, i)
        automaton.make_automaton()
        table = pa.array(names, pa.string())
        for batch in batches:
            rows, found = [], []
            for row, held in enumerate(batch.column(text).to_pylist()):
                if held:
                    hit = {i for _, i in automaton.iter(held)}
                    rows.extend([row] * len(hit))
                    found.extend(hit)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int32())), table.take(pa.array(found, pa.int32()))], names=[key, name])

    return run


def contains_join(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, min_chars: int = 1) -> DataFrame:
    """Pairs where a text contains a name: (key, name).

    A name table that is counted and found small is laid out as one automaton per task: texts are read once and nothing is
    shuffled. Beyond AUTOMATON_NAMES or AUTOMATON_CHARS each name is keyed by its first ``LEAD_CHARS`` characters (or all,
    if shorter) and each text by its distinct substrings of the lengths in use, so the pairs that are compared share a gram
    and no full product is formed. Grams that occur in very many texts are split over tasks. Null texts hold no name.
    """
    short = names.select(name).where(F.length(name) >= min_chars).distinct()
    n, chars = short.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(name)), F.lit(0))).first()
    if 0 < n <= AUTOMATON_NAMES and chars <= AUTOMATON_CHARS:
        held = [r[0] for r in short.collect()]
        kind = texts.schema[key].dataType.simpleString()
        return texts.select(key, text).mapInArrow(_scan(held, key, text, name), f"`{key}` {kind}, `{name}` string")
    keyed = short.withColumn("_gram", F.substring(F.col(name), 1, LEAD_CHARS))
    # Only the lengths in use, at most LEAD_CHARS of them, are cut out of the texts.
    lengths = [r[0] for r in keyed.select(F.length("_gram")).distinct().collect()]
    if not lengths:
        return texts.select(key).join(short, F.lit(False))
    grams = texts.select(key, F.explode(F.flatten(F.array(*[_grams(text, n) for n in sorted(lengths)]))).alias("_gram"))
    needed = keyed.select("_gram").distinct()
    hits = grams.join(needed, "_gram", "left_semi")
    pairs = skew_join(hits, keyed.select(name, "_gram"), ["_gram"], [key])
    return pairs.join(texts.select(key, text), key).where(F.contains(F.col(text), F.col(name))).select(key, name)


def drop_overlapping_titles(rows: DataFrame, names: DataFrame, key: str, title: str, name: str) -> DataFrame:
    """Rows whose title neither contains a known name (two characters or more) nor lies inside one."""
    known = names.select(F.col(name).alias("_name")).where(F.length("_name") >= 2).distinct()
    holds = contains_join(rows, known, key, title, "_name").select(key)
    titles = rows.select(F.col(title).alias("_title")).distinct()
    inside = _inside(known, titles)
    by_title = rows.join(inside, rows[title] == inside["_title"], "left_semi").select(key)
    return rows.join(holds.unionByName(by_title).distinct(), key, "left_anti")


def _inside(known: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles that occur inside a known name."""
    texts = known.select(F.col("_name").alias("_k"), F.col("_name").alias("_t"))
    return contains_join(texts, titles, "_k", "_t", "_title").select("_title").distinct()
