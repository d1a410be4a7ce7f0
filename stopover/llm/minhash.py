"""Near-duplicate documents: circulant MinHash signatures, banding, and Jaccard on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopover.llm.common import U, buffer_of, mix, run_hashes, settle, steps, word_hashes
from stopover.session import skew_join

SHINGLE = 5
BANDS, ROWS = 32, 4  # two sets of similarity 0.75 share no band once in 200,000 times
SIMILAR = (75, 100)
# A round of pivots is followed by the join of differences once that would look at no more pairs than LOOKS for each class, or
# once another round has not halved them; these numbers only order the work.
LOOKS = 100

_SIGMA, _PI1, _PI2 = U(0x5851F42D4C957F2D), U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row of a buffer, sorted within the row, and the row bounds.

    Words are lower-cased (A-Z); a row with fewer than ``k`` words has its whole sequence as one shingle, one without words none.
    """
    rows, _, _, word = word_hashes(data, bounds, lower=True)
    run = run_hashes(word, k)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            out.append(mix(run_hashes(word[a:b], b - a) ^ U(b - a)))
        else:
            out.append(word[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else word[:0]), np.append(0, np.cumsum(sizes))


def signatures(values: np.ndarray, bounds: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one permutation scatters the values, a second one, shifted by k, gives coordinate k.

    Both are bijections of 64-bit numbers, so a shift of the second is an addition before it.
    """
    x = mix(values ^ _SIGMA)
    out = np.empty((len(bounds) - 1, coordinates), U)
    step, row = 1 << 16, 0
    while row < len(bounds) - 1:  # some rows at a time, so that they stay in the cache
        last = max(int(np.searchsorted(bounds, bounds[row] + step, "right")) - 1, row + 1)
        part, starts = x[bounds[row] : bounds[last]], bounds[row:last] - bounds[row]
        y, z = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.add(part, U(k), out=y)
            np.multiply(y, _PI1, out=y)
            np.right_shift(y, U(32), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, _PI2, out=y)
            out[row:last, k] = np.minimum.reduceat(y, starts)
        row = last
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, set size, two set hashes and the band keys of every row."""
    for batch in steps(batches):
        values, bounds = shingle_sets(*buffer_of(batch.column("text")))
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        s2 = np.zeros(len(size), U)
        keys = np.zeros((0, BANDS), U)
        if len(full):
            s2[full] = np.add.reduceat(mix(values ^ _PI2), bounds[full])
            sig = signatures(values, np.append(bounds[full], bounds[-1]))
            keys = np.repeat(mix(np.arange(1, BANDS + 1, dtype=U))[None, :], len(full), 0)
            for j in range(ROWS):
                keys = mix(keys * _PI1 + sig[:, j::ROWS])
        cuts = np.append(0, np.cumsum((size > 0) * BANDS)).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.ravel().view(np.int64)))
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(size), pa.array(_set_hash(values, bounds).view(np.int64)), pa.array(s2.view(np.int64)), bands],
            ["doc_id", "text_key", "n_shingles", "s1", "s2", "bands"],
        )


def _set_hash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, 0 for an empty one."""
    out, full = np.zeros(len(bounds) - 1, U), np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(mix(values), bounds[full])
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        values, bounds = shingle_sets(*buffer_of(batch.column("text")))
        sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
        yield pa.record_batch([batch.column("doc_id"), pa.array(_set_hash(values, bounds).view(np.int64)), sets], ["doc_id", "s1", "set"])


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over the links (a, b), by label propagation with shortcuts."""
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        around = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "id")
        near = label.join(around, "id").select("id", "comp", F.least("comp", "near").alias("near"))
        up = label.select(F.col("id").alias("near"), F.col("comp").alias("up"))
        new = settle(near.join(up, "near").select("id", "up", (F.col("up") < F.col("comp")).alias("moved")))
        label = new.select("id", F.col("up").alias("comp"))
        if new.where("moved").isEmpty():
            return label


def _full_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the given classes, each from one of its documents."""
    texts = documents.join(ids.select(F.col("id.doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, s1 long, set array<long>")
    return settle(sets.select(F.struct("doc_id", "s1").alias("id"), "set").join(ids, "id", "left_semi").dropDuplicates(["id"]))


def _open_buckets(bands: DataFrame, label: DataFrame | None) -> DataFrame:
    """Rows (key, id, comp) of the buckets in which more than one component is left."""
    if label is None:
        mixed = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        rows = bands
    else:
        rows = skew_join(bands.drop("comp"), label, ["id"], [F.col("key")], "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return settle(skew_join(rows, mixed.select("key"), ["key"], [F.col("id")], "left_semi"))


def _differences(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every member of an open bucket against the bucket's pivot, and the pivots (key, id).

    The pivot is the member that shares most buckets with most others: the least changed one of a group of copies, to which
    most are similar and from which all differ by their own changes only. All buckets use one order, so a member meets few
    different pivots. Rows: (id, p, n, m, d) with n shingles in p; d holds the m ones that only p has, and those that only
    the member has, negated.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("b"))
    met = skew_join(rows, sizes, ["key"], [F.col("id")]).groupBy("id").agg((-F.sum("b")).alias("b"))
    placed = rows.select("key", "id").join(met, "id")
    pivots = settle(placed.groupBy("key").agg(F.min(F.struct("b", F.xxhash64("id"), "id")).alias("o")).select("key", F.col("o.id").alias("p")))
    pairs = skew_join(rows.select("key", "id"), pivots, ["key"], [F.col("id")]).where("id <> p").select("id", "p").distinct()
    met = skew_join(pairs, sets.withColumnRenamed("set", "sx"), ["id"], [F.col("p")])
    met = skew_join(met, sets.select(F.col("id").alias("p"), F.col("set").alias("sp")), ["p"], [F.col("id")])
    lost, new = F.array_except("sp", "sx"), F.transform(F.array_except("sx", "sp"), lambda t: F.bitwise_not(t))
    return settle(met.select("id", "p", F.size("sp").alias("n"), F.size(lost).alias("m"), F.concat(lost, new).alias("d"))), pivots.select("key", F.col("p").alias("id"))


# Of p's n shingles a member lacks m and has e others: it is similar enough to p if its weight 4 m + 3 e is at most n. Two
# members of weights w and w2 that share c places of their differences are if 7 c >= w + w2 - n.
_WEIGHT = "4 * m + 3 * (size(d) - m)"
assert SIMILAR == (75, 100)  # the weights follow from it


def _difference_tokens(met: DataFrame, label: DataFrame | None) -> DataFrame:
    """Prefixes of the differences of members in different components of one pivot's group.

    Two members joined to the pivot are in one component already, so one of a pair weighs more than n, and the other shares
    at least (w + 1) / 7 of its difference; one that weighs more than n shares at least (w + 1) / 7 with another such, and at
    least (w + least - n) / 7 with a joined one, of which ``least`` is the lightest. Differences are ordered by how many
    members share them; what only one component holds comes first and is left out, as no pair shares it. The prefixes that
    must then meet: ``short`` for any pair, up to ``long`` with joined members.
    """
    rows = met.withColumn("w", F.expr(_WEIGHT))
    rows = rows.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")) if label is not None else rows.withColumn("comp", F.col("id"))
    group = rows.groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.expr("if(w <= n, w, null)")).alias("least"))
    rows = skew_join(rows, group.where("lo < hi").select("p", "least"), ["p"], [F.col("id")])
    rows = rows.withColumns({"short": F.expr("cast(ceil((w + 1) / 7) as int)"), "joined": F.col("w") <= F.col("n")})
    rows = rows.withColumn("long", F.expr("if(joined or least is null, short, greatest(1, least(short, cast(ceil((w + least - n) / 7) as int))))"))
    tokens = rows.select("p", "id", "comp", "n", "w", "short", "long", "joined", F.explode("d").alias("t"))
    common = tokens.groupBy("p", "t").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("p", "t", "f")
    keys = ["p", "id", "comp", "n", "w", "short", "long", "joined"]
    held = skew_join(tokens, common, ["p", "t"], [F.col("id")]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s"))
    held = held.withColumns({"size": F.size("s"), "short": F.expr("size(s) - short + 1"), "long": F.expr("size(s) - long + 1")})
    prefix = held.where("long > 0").select(*keys, "size", F.posexplode(F.expr("slice(s, 1, long)")).alias("k", "x"))
    return settle(prefix.select("p", "x.t", "id", "comp", "n", "w", "joined", (F.col("k") < F.col("short")).alias("early"), "k", (F.col("size") - F.col("k")).alias("after")))


def _meetings(prefix: DataFrame) -> int:
    """Pairs of rows of different components that the join of differences would look at."""
    each = prefix.groupBy("p", "t", "comp").agg(F.count("*").alias("c")).groupBy("p", "t").agg(F.sum("c").alias("s"), F.sum(F.col("c") ** 2).alias("q"))
    return int(each.agg(F.coalesce(F.sum((F.col("s").cast("double") ** 2 - F.col("q")) / 2), F.lit(0.0))).first()[0])


def _difference_links(prefix: DataFrame, met: DataFrame) -> DataFrame:
    """Links (a, b) between members of a pivot's group, confirmed on their whole differences."""
    other = prefix.select("p", "t", *[F.col(c).alias(c + "2") for c in ("id", "comp", "w", "joined", "early", "k", "after")])
    # Shared from this place on, and before it, in both orders.
    most = F.least("after", "after2") + F.least("k", "k2")
    enough = 7 * most >= F.col("w") + F.col("w2") - F.col("n")
    pairs = prefix.join(other, ["p", "t"]).where("id < id2 and comp <> comp2 and (early or joined2) and (early2 or joined)").where(enough)
    pairs = settle(pairs.groupBy("id", "id2").agg(F.min("p").alias("p")))
    weighed = met.select("p", "id", "n", "d", F.expr(_WEIGHT).alias("w"))
    both = skew_join(pairs, weighed, ["p", "id"], [F.col("id2")])
    both = skew_join(both, weighed.select("p", F.col("id").alias("id2"), F.col("d").alias("d2"), F.col("w").alias("w2")), ["p", "id2"], [F.col("id")])
    return both.where(7 * F.size(F.array_intersect("d", "d2")) >= F.col("w") + F.col("w2") - F.col("n")).select(F.col("id").alias("a"), F.col("id2").alias("b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component_set, text_key; one row per row of ``documents``.

    Texts with the same set are one class, known by its smallest doc_id and the set's hash. Classes that share a band key meet
    in buckets. No bucket is expanded into pairs: in a round every member is compared with one pivot of its bucket, on full
    sets of 64-bit shingle hashes, and joined to it if similar enough. Members of one pivot's group that are still in different
    components are then joined by what they differ in from the pivot, with prefix and place filters and without a loss: copies
    of one text share most shingles, but few of their changes. While that join would still look at many pairs, as members that
    resemble each other but not the pivot make, another round takes a new pivot in each open bucket first.

    Null and wordless texts and rows without an id are linked with nothing (component: their own id). Rows sharing a doc_id
    are judged by their own text; ``component_set`` tells their components apart and ``text_key``, a hash of the text, the
    rows. Repeated rows give equal rows, other columns are not read, an empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    docs = settle(rows.mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, s1 long, s2 long, bands array<long>"))
    named = docs.where("n_shingles > 0 and doc_id is not null")
    reps = settle(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    reps = reps.withColumn("id", F.struct("doc_id", "s1"))
    classes = reps.count()
    open_rows = _open_buckets(reps.select(F.explode("bands").alias("key"), "id", F.col("id").alias("comp")), None)
    sets = _full_sets(rows.select("doc_id", "text"), open_rows.select("id").distinct())
    links = label = before = None
    while not open_rows.isEmpty():
        met, pivots = _differences(open_rows, sets)
        new = settle(met.where(f"{_WEIGHT} <= n").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct())
        if not new.isEmpty():
            links = new if links is None else settle(links.union(new))
            label = components(links)
        prefix = _difference_tokens(met, label)
        looks = _meetings(prefix)
        if looks <= LOOKS * classes or before is not None and 2 * looks > before:
            more = settle(_difference_links(prefix, met))
            if not more.isEmpty():
                links = more if links is None else settle(links.union(more))
                label = components(links)
            break
        before = looks
        open_rows = _open_buckets(open_rows.join(pivots, ["key", "id"], "left_anti"), label)
    group = reps.select("s1", "s2", "id")
    group = group.join(label, "id", "left") if label is not None else group.withColumn("comp", F.lit(None).cast("struct<doc_id:bigint,s1:bigint>"))
    group = group.select("s1", "s2", F.coalesce("comp", "id").alias("comp"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()  # without an id or words: joined with nothing
    narrow = docs.select("doc_id", "text_key", "n_shingles", F.when(linked, F.col("s1")).alias("s1"), "s2")
    joined = skew_join(narrow, settle(group), ["s1", "s2"], [F.col("doc_id")], "left")
    return joined.select(
        "doc_id", "n_shingles", F.coalesce("comp.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("comp.doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("comp.s1", "text_key").alias("component_set"), "text_key",
    )
