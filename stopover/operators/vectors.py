"""Vector retrieval: embedding, exact and approximate nearest neighbours, hybrid item search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopover.functions.text import NGRAM_DIM, md5_bucket, ngram_counts, ngram_vector
from stopover.operators.containment import contains_join
from stopover.operators.graph import reply_parents
from stopover.session import cut_lineage, skew_join

# Most query vectors sent to every task at once: 4096 x 1024 doubles are 32 MiB.
QUERY_BLOCK = 4096
# Most corpus rows one blocked group holds.
CORPUS_BLOCK = 50_000
# Keys of several rows that are sent to every task.
BROADCAST_KEYS = 200_000
# Most names or scores, over all its texts, that a task of an exact search holds.
SEARCH_ROWS = 4_000_000
# Most scores a task holds at once, 32 MiB; larger products are taken in slices of items.
SCORES = 1 << 22

# Text prefixes each model expects for queries and passages.
MODEL_PREFIXES = {
    "intfloat/multilingual-e5-small": ("query: ", "passage: "),
    "intfloat/multilingual-e5-base": ("query: ", "passage: "),
    "intfloat/multilingual-e5-large": ("query: ", "passage: "),
    "cl-nagoya/ruri-v3-30m": ("検索クエリ: ", "検索文書: "),
    "cl-nagoya/ruri-v3-70m": ("検索クエリ: ", "検索文書: "),
    "cl-nagoya/ruri-v3-130m": ("検索クエリ: ", "検索文書: "),
    "cl-nagoya/ruri-v3-310m": ("検索クエリ: ", "検索文書: "),
}

Encoder = Callable[[Column], Column]


def embed(df: DataFrame, text: str, model: str, role: str = "passage", encoder: Encoder = ngram_vector) -> DataFrame:
    """Adds ``model`` and ``embedding``; ``encoder`` maps a text column to a vector column.

    A sentence model plugs in as a pandas UDF. The default is the hashed 2-gram baseline.
    """
    query, passage = MODEL_PREFIXES.get(model, ("", ""))
    prefix = query if role == "query" else passage
    return df.withColumn("model", F.lit(model)).withColumn("embedding", encoder(F.concat(F.lit(prefix), F.col(text))))


def ngram_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """Non-zero entries of each key's hashed 2-gram unit vector: (key, bucket, weight); a null text has the null bucket alone.

    A text is counted where it lies. Only keys of several rows, found by counting keys, have their counts added up in a shuffle.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, text)
    twice = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    n = twice.count()
    if not n:
        return _entries(rows, key, text, ngram_vector, "weight")
    few = F.broadcast(twice) if n <= BROADCAST_KEYS else twice
    single = _entries(rows.join(few, key, "left_anti"), key, text, ngram_vector, "weight")
    buckets = _entries(rows.join(few, key, "left_semi"), key, text, ngram_counts, "n").groupBy(key, "bucket").agg(F.sum("n").alias("n"))
    norms = buckets.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return single.unionByName(buckets.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight")))


def _entries(rows: DataFrame, key: str, text: str, encoder: Encoder, name: str) -> DataFrame:
    entries = F.posexplode_outer(F.when(F.col(text).isNotNull(), encoder(F.col(text)))).alias("bucket", name)
    return rows.select(key, entries).withColumn(name, F.coalesce(name, F.lit(1.0))).where(F.col(name) > 0)


# ------------------------------------------------------------------ nearest neighbours


def _top_rows(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every entry at least as good as its column's k-th best and ``least``, and that k-th best (too few rows: minus infinity)."""
    n = scores.shape[0]
    if n <= k:
        return ~(scores < least - 1e-12), np.full(scores.shape[1], -np.inf)
    kth = np.partition(scores, n - k, axis=0)[n - k]
    return scores >= np.fmax(kth, least) - 1e-12, kth


def _slices(rows: int, width: int) -> list[tuple[int, int]]:
    """Runs of rows whose products with ``width`` columns have at most SCORES entries."""
    step = max(SCORES // max(width, 1), 1)
    return [(lo, min(lo + step, rows)) for lo in range(0, rows, step)]


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return m / norm


def knn_exact(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    item_id: str = "item_id",
    query_id: str = "qid",
    vector: str = "embedding",
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` nearest items of every query by cosine distance, ties by item id.

    Output: (qid, rank, id, dist). Each task multiplies its Arrow batches of items with a
    block of query vectors and keeps only the rows that can still be among a query's k
    best, so what is shuffled is about ``k`` rows per query and batch. A query set within
    ``QUERY_BLOCK`` rows is sent to the tasks once; a larger one is cut into blocks that
    meet the item blocks in a co-grouped product.
    """
    q = queries.select(F.col(query_id).alias("qid"), F.col(vector).alias("qvec"))
    it = items.select(F.col(item_id).alias("id"), F.col(vector).alias("vec"))
    head = q.limit(QUERY_BLOCK + 1).toPandas()
    id_type, qid_type = it.schema["id"].dataType.simpleString(), q.schema["qid"].dataType.simpleString()
    schema = f"qid {qid_type}, id {id_type}, dist double"
    extra = 1 if exclude_self else 0

    def block_scores(qids: np.ndarray, qmat: np.ndarray, ids: np.ndarray, mat: np.ndarray) -> pd.DataFrame:
        slices, least = [], np.full(len(qids), -np.inf)
        for lo, hi in _slices(len(ids), len(qids)):
            scores = mat[lo:hi] @ qmat.T
            top, kth = _top_rows(scores, k + extra, least)
            least = np.fmax(least, kth)
            r, c = np.nonzero(top)
            slices.append((ids[lo:hi][r], c, scores[r, c]))
        r, c, s = (np.concatenate(x) for x in zip(*slices, strict=True))
        # Later slices raise the bar, so what the first ones handed on is judged again.
        keep = ~(s < least[c] - 1e-12)
        out = pd.DataFrame({"qid": qids[c[keep]], "id": r[keep], "dist": 1.0 - s[keep]})
        return out[out["qid"] != out["id"]] if exclude_self else out

    if len(head) == 0:
        return q.sparkSession.createDataFrame([], f"qid {qid_type}, rank int, id {id_type}, dist double")
    if len(head) <= QUERY_BLOCK:
        shared = q.sparkSession.sparkContext.broadcast((head["qid"].to_numpy(), _unit(head["qvec"])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, qmat = shared.value
            for pdf in batches:
                if len(pdf):
                    yield block_scores(qids, qmat, pdf["id"].to_numpy(), _unit(pdf["vec"]))

        near = it.mapInPandas(scan, schema)
    else:
        near = _blocked(it, q, block_scores, schema)
    best = Window.partitionBy("qid").orderBy(F.round("dist", 12), "id")
    return (
        near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")
    )


def _grid(items: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """Numbers of item and query blocks, each of at most CORPUS_BLOCK rows on average.

    Each side is repeated once for every block of the other, so blocks are as large as a task may hold; only a grid of fewer
    cells than cores has smaller query blocks.
    """
    n_items, n_queries = items.count(), queries.count()
    ib = -(-n_items // CORPUS_BLOCK) or 1
    busy = -(-2 * items.sparkSession.sparkContext.defaultParallelism // ib)
    return ib, max(-(-n_queries // CORPUS_BLOCK), min(-(-n_queries // QUERY_BLOCK), busy), 1)


def _blocked(items: DataFrame, queries: DataFrame, block_scores, schema: str) -> DataFrame:
    """Item blocks against query blocks; every (item block, query block) cell is one bounded task."""
    ib, qb = _grid(items, queries)
    # Aliases keep the two sides apart when items and queries come from one table.
    items = items.select(F.col("id").alias("id"), F.col("vec").alias("vec"))
    left = items.withColumn("ib", F.pmod(F.xxhash64("id"), F.lit(ib)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))
    )
    right = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int")).withColumn(
        "ib", F.explode(F.sequence(F.lit(0), F.lit(ib - 1)))
    )

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"qid": [], "id": [], "dist": []})
        ids, mat, qids = a["id"].to_numpy(), _unit(a["vec"]), b["qid"].to_numpy()
        parts = range(0, len(b), QUERY_BLOCK)
        return pd.concat([block_scores(qids[at:at + QUERY_BLOCK], _unit(b["qvec"].iloc[at:at + QUERY_BLOCK]), ids, mat) for at in parts])

    return left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInPandas(cell, schema)


def knn_filtered(items: DataFrame, queries: DataFrame, k: int, predicate: Column, **kw) -> DataFrame:
    """Exact neighbours among the items that pass a predicate; the filter runs in the scan."""
    return knn_exact(items.where(predicate), queries, k, **kw)


def kmeans_centres(items: DataFrame, cells: int, vector: str = "embedding", seed: int = 7) -> DataFrame:
    """Coarse quantiser: ``cells`` centres fitted by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = items.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine").fit(feats)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return items.sparkSession.createDataFrame(rows, "cell int, centre array<double>")


def assign_cells(df: DataFrame, key: str, vector: str, centres: DataFrame, probes: int) -> DataFrame:
    """The ``probes`` nearest centres of every row: (key, cell)."""
    flat = centres.select(F.col("cell").alias("id"), F.col("centre").alias("embedding"))
    near = knn_exact(
        flat, df.select(F.col(key).alias("qid"), F.col(vector).alias("embedding")), probes, item_id="id"
    ) if probes > 1 else None
    if near is not None:
        return near.select(F.col("qid").alias(key), F.col("id").alias("cell"))
    # One probe: score every row against the centre block it meets in the scan.
    best = knn_transposed(df.select(F.col(key).alias("id"), F.col(vector).alias("embedding")), flat)
    return best.select(F.col("id").alias(key), "cell")


def knn_transposed(items: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centre of every item, a map-only job; the centre table is bounded by the caller's cell count."""
    head = centres.toPandas()
    shared = items.sparkSession.sparkContext.broadcast((head["id"].to_numpy(), _unit(head["embedding"])))
    schema = f"id {items.schema['id'].dataType.simpleString()}, cell {centres.schema['id'].dataType.simpleString()}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat = shared.value
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "cell": ids[np.argmax(_unit(pdf["embedding"]) @ mat.T, axis=1)]})

    return items.mapInPandas(scan, schema)


def knn_approx(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    centres: DataFrame,
    probes: int = 4,
    item_id: str = "item_id",
    query_id: str = "qid",
    vector: str = "embedding",
) -> DataFrame:
    """Inverted-file search: candidates share one of the query's ``probes`` cells, then exact re-rank.

    A cell that holds far more items than others is cut into blocks by :func:`knn_within`;
    no cell is capped.
    """
    it = items.select(F.col(item_id).alias("id"), F.col(vector).alias("embedding"))
    q = queries.select(F.col(query_id).alias("qid"), F.col(vector).alias("embedding"))
    item_cells = assign_cells(it, "id", "embedding", centres, 1).join(it, "id")
    query_cells = assign_cells(q, "qid", "embedding", centres, probes).join(q, "qid")
    near = knn_within(item_cells, query_cells, "cell", k, exclude_self=False)
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "qid", "rank", "id", (F.lit(1.0) - F.col("score")).alias("dist")
    )


# ------------------------------------------------------------------ item search


def _ranked(scores: DataFrame, by: list[str], limit: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "item_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def exact_search(queries: DataFrame, item_subject: DataFrame, limit: int = 5) -> DataFrame:
    """Items ranked by how many of their subjects' normalised names occur in the query text.

    ``queries``: (qid, text) with text already normalised; ``item_subject``: (item_id, normalized_name).
    A text may hold every name and score every item, so the number of tasks follows from the counts of texts, names and items.
    """
    hits = contains_join(queries, item_subject.select("normalized_name").distinct(), "qid", "text", "normalized_name")
    widest = max(item_subject.agg(F.countDistinct("normalized_name"), F.countDistinct("item_id")).first())
    least = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-queries.count() * widest // SEARCH_ROWS))
    # One shuffle by query serves the distinct names, the items' scores and the ranking.
    scores = (
        hits.repartition(tasks, "qid").distinct().join(item_subject.select("item_id", "normalized_name").distinct(), "normalized_name")
        .groupBy("qid", "item_id")
        .agg(F.count(F.lit(1)).cast("double").alias("score"))
    )
    return _ranked(scores, ["qid"], limit)


def similarities(queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Similarity of every query to every vector of a judged set: (qid, key, score).

    Meant for judged corpora where each score is wanted; use :func:`knn_exact` for search.
    """
    n = queries.limit(QUERY_BLOCK + 1).count()
    if n > QUERY_BLOCK:
        return _similarity_blocks(queries, vectors, key)
    head = queries.select("qid", F.col("embedding").alias("qvec")).toPandas()  # at most QUERY_BLOCK rows
    shared = vectors.sparkSession.sparkContext.broadcast((head["qid"].to_numpy(), _unit(head["qvec"]) if len(head) else None))
    kt, qt = vectors.schema[key].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qmat = shared.value
        for pdf in batches:
            if len(pdf) and len(qids):
                s = _unit(pdf["embedding"]) @ qmat.T
                yield pd.DataFrame(
                    {"qid": np.tile(qids, len(pdf)), key: np.repeat(pdf[key].to_numpy(), len(qids)), "score": s.ravel()}
                )

    return vectors.select(key, "embedding").mapInPandas(scan, f"qid {qt}, {key} {kt}, score double")


def _similarity_blocks(queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Similarities of a query set of any size: blocks of queries meet blocks of vectors, each pair of blocks in its own task."""
    half = max(QUERY_BLOCK // 2, 1)
    n_q, n_v = -(-queries.count() // half), max(-(-vectors.count() // half), 1)
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select(key, "embedding", own(key, n_v).alias("_v")).select("*", blocks(n_q).alias("_q"))
    right = queries.select("qid", F.col("embedding").alias("qvec"), own("qid", n_q).alias("_q")).select("*", blocks(n_v).alias("_v"))
    kt, qt = vectors.schema[key].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def score(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"qid": q["qid"][:0], key: v[key][:0], "score": np.zeros(0)})
        s = _unit(v["embedding"]) @ _unit(q["qvec"]).T
        return pd.DataFrame({"qid": np.tile(q["qid"].to_numpy(), len(v)), key: np.repeat(v[key].to_numpy(), len(q)), "score": s.ravel()})

    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(score, f"qid {qt}, {key} {kt}, score double")


def best_by_item(queries: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """Similarity of every query to the closest vector of every item: (qid, item_id, score), once or more for a pair.

    ``vectors``: (item_id, embedding), any number for an item. Blocks of queries meet blocks of vectors and hand on one row
    for each query and item they hold, the best one, instead of one for each vector; the largest row of a pair is its score.
    With ``limit`` a meeting hands on each query's best ``limit`` items only: an item of the final list is among them where
    its closest vector lies, as any item ahead of it there is ahead in the end.
    """
    ib, qb = _grid(vectors, queries)
    deal = F.pmod(F.xxhash64("embedding"), F.lit(ib)).cast("int")
    left = vectors.select("item_id", "embedding", deal.alias("_ib")).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    right = queries.select("qid", F.col("embedding").alias("qvec"), F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int").alias("_qb"))
    right = right.withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(ib - 1))))
    kinds = [left.schema["item_id"].dataType, right.schema["qid"].dataType]
    schema = f"qid {kinds[1].simpleString()}, item_id {kinds[0].simpleString()}, score double"

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        qid, named = b["qid"].combine_chunks(), a["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        q, item, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(a) and len(b):
            code = named.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            codes, first = np.unique(code[order], return_index=True)
            mat, asked = _unit(a["embedding"].to_pandas())[order], b["qvec"].to_pandas()
            for lo, hi in _slices(len(b), len(a)):
                best = np.maximum.reduceat(_unit(asked.iloc[lo:hi]) @ mat.T, first, axis=1)
                keep = np.ones_like(best, dtype=bool)
                if limit is not None and len(codes) > limit:
                    keep = ~(best < np.partition(best, len(codes) - limit, axis=1)[:, [len(codes) - limit]] - 2e-12)
                r, c = np.nonzero(keep)
                q.append(r + lo)
                item.append(codes[c])
                score.append(best[r, c])
        return pa.table({"qid": qid.take(pa.array(np.concatenate(q))), "item_id": named.dictionary.take(pa.array(np.concatenate(item))), "score": np.concatenate(score)})

    return left.groupBy("_ib", "_qb").cogroup(right.groupBy("_ib", "_qb")).applyInArrow(meet, schema)


def subject_search(queries: DataFrame, subject_vectors: DataFrame, item_subject: DataFrame, limit: int = 5) -> DataFrame:
    """Items ranked by their most similar subject."""
    linked = subject_vectors.join(item_subject, "normalized_name").select("item_id", "embedding")
    scores = best_by_item(queries, linked, limit).groupBy("qid", "item_id").agg(F.max("score").alias("score"))
    return _ranked(scores, ["qid"], limit)


def item_search(queries: DataFrame, item_vectors: DataFrame, model: str, variant: str, limit: int = 5) -> DataFrame:
    """Items ranked by similarity within one model and variant."""
    chosen = item_vectors.where((F.col("model") == model) & (F.col("variant") == variant))
    near = knn_exact(chosen, queries, limit)
    return near.select("qid", "rank", F.col("id").alias("item_id"), (F.lit(1.0) - F.col("dist")).alias("score"))


def item_or_topic_search(
    queries: DataFrame, item_vectors: DataFrame, topic_vectors: DataFrame, topics: DataFrame, model: str, limit: int = 5
) -> DataFrame:
    """Items ranked by the better of their own full text and their closest topic."""
    own = item_vectors.where((F.col("model") == model) & (F.col("variant") == "full"))
    by_topic = topic_vectors.where((F.col("model") == model) & (F.col("variant") == "about_findings"))
    linked = by_topic.select("topic_id", "embedding").join(topics.select("topic_id", "item_id"), "topic_id")
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    both = own.select("item_id", vector).unionByName(linked.select("item_id", vector))
    best = best_by_item(queries, both, limit).groupBy("qid", "item_id").agg(F.max("score").alias("score"))
    return _ranked(best, ["qid"], limit)


def topic_search(queries: DataFrame, topic_vectors: DataFrame, model: str, limit: int = 3) -> DataFrame:
    """Top topics per query and variant."""
    chosen = topic_vectors.where(F.col("model") == model)
    out = None
    for variant in ("about", "about_findings"):
        near = knn_exact(chosen.where(F.col("variant") == variant), queries, limit, item_id="topic_id")
        rows = near.select("qid", F.lit(variant).alias("variant"), "rank", F.col("id").alias("topic_id"), (F.lit(1.0) - F.col("dist")).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def related_by_subject(item_subject: DataFrame, sources: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Items sharing subjects with a source item, by number shared.

    Without ``sources`` every item is a source. Subjects held by very many items are split over tasks.
    """
    src = item_subject if sources is None else item_subject.join(sources, "item_id", "left_semi")
    a = src.select(F.col("item_id").alias("source_id"), "normalized_name")
    pairs = skew_join(item_subject, a, ["normalized_name"], ["item_id"]).where(F.col("item_id") != F.col("source_id"))
    scores = pairs.groupBy("source_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return _ranked(scores, ["source_id"], limit)


def related_by_subject_vectors(
    item_subject: DataFrame, subject_vectors: DataFrame, sources: DataFrame, limit: int = 5
) -> DataFrame:
    """Mean over a source's subjects of the most similar subject of the other item.

    ``sources``: (item_id) items to start from.
    """
    src = item_subject.join(sources, "item_id", "left_semi").select(F.col("item_id").alias("source_id"), F.col("normalized_name").alias("qid"))
    qv = src.select("qid").distinct().join(subject_vectors.withColumnRenamed("normalized_name", "qid"), "qid")
    linked = subject_vectors.join(item_subject, "normalized_name").select("item_id", "embedding")
    best = best_by_item(qv.select("qid", "embedding"), linked).groupBy("qid", "item_id").agg(F.max("score").alias("best"))
    scores = (
        best.join(src, "qid")
        .where(F.col("item_id") != F.col("source_id"))
        .groupBy("source_id", "item_id")
        .agg(F.avg("best").alias("score"))
    )
    return _ranked(scores, ["source_id"], limit)


def related_by_vector(item_vectors: DataFrame, sources: DataFrame, model: str, variant: str, limit: int = 5) -> DataFrame:
    """Neighbours of items within the same model and variant, the item itself excluded."""
    chosen = item_vectors.where((F.col("model") == model) & (F.col("variant") == variant))
    q = chosen.join(sources, "item_id", "left_semi").select(F.col("item_id").alias("qid"), "embedding")
    near = knn_exact(chosen, q, limit, exclude_self=True)
    return near.select(F.col("qid").alias("source_id"), "rank", F.col("id").alias("item_id"), (F.lit(1.0) - F.col("dist")).alias("score"))


# ------------------------------------------------------------------ similarity inside groups


def _best_places(scores: np.ndarray, other: np.ndarray | None, earlier: np.ndarray | None, k: int) -> np.ndarray:
    """Places of the ``k`` best rounded scores among the rows allowed, equal ones in the order of the rows."""
    ok = np.ones(len(scores), dtype=bool)
    for mask in (other, earlier):
        if mask is not None:
            ok &= mask
    at = np.flatnonzero(ok)
    rounded = np.round(scores[at], 12)
    if len(at) > 4 * k:  # most rows are out before the sort
        known = np.where(np.isnan(rounded), -np.inf, rounded)
        near = np.flatnonzero(known >= np.partition(known, len(at) - k)[len(at) - k])
        at, rounded = at[near], rounded[near]
    return at[np.argsort(-rounded, kind="stable")[:k]]


def knn_within(
    items: DataFrame, queries: DataFrame, group: str, k: int, order: str | None = None, exclude_self: bool = True
) -> DataFrame:
    """The ``k`` nearest rows of the same group: (group, qid, rank, id, score).

    ``items``: group, id, embedding (and ``order``); ``queries``: group, qid, embedding (and
    ``order``). With ``order`` only items before the query count. Ties go to the lower
    order, else the lower id. Small groups share a task; a group above ``CORPUS_BLOCK`` rows
    is cut into blocks that meet block by block, and each meeting hands on its k best only.
    """
    total = items.count() or 1
    buckets = -(-total // CORPUS_BLOCK) * 4
    it = items.withColumn("_o", F.col(order).cast("long") if order else F.lit(0).cast("long"))
    q = queries.withColumn("_o", F.col(order).cast("long") if order else F.lit(0).cast("long"))
    sizes = it.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(CORPUS_BLOCK)).cast("int").alias("_nb"))
    task = F.when(F.col("_nb") > 1, F.xxhash64(group)).otherwise(F.pmod(F.xxhash64(group), F.lit(buckets)))

    def place(df: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        return (
            df.join(sizes, group)
            .withColumn("_task", task)
            .withColumn(mine, F.pmod(F.xxhash64(key), F.col("_nb").cast("long")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .select(*[F.col(c).alias(c) for c in (group, key, "embedding", "_o", "_task", "_ib", "_qb")])
        )

    left = place(it, "id", "_ib", "_qb")
    right = place(q, "qid", "_qb", "_ib")
    types = {c: it.schema[c].dataType.simpleString() for c in (group, "id")}
    schema = f"{group} {types[group]}, qid {types['id']}, id {types['id']}, score double, _o long"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, groups = [], []
        by_group = dict(list(a.groupby(group, sort=False)))
        for g, qs in b.groupby(group, sort=False):
            rows = by_group.get(g)
            if rows is None:
                continue
            rows = rows.sort_values(["_o", "id"])
            mat = _unit(rows["embedding"])
            ids, order_of = rows["id"].to_numpy(), rows["_o"].to_numpy()
            for lo, hi in _slices(len(qs), len(rows)):
                s = _unit(qs["embedding"].iloc[lo:hi]) @ mat.T
                qids = qs["qid"].to_numpy()[lo:hi]
                for j, (qid, o) in enumerate(zip(qids, qs["_o"].to_numpy()[lo:hi])):
                    best = _best_places(s[j], ids != qid if exclude_self else None, order_of < o if order else None, k)
                    out.append((np.full(len(best), len(groups)), np.repeat(qids[j:j + 1], len(best)), ids[best], s[j, best], order_of[best]))
            groups.append(g)
        if not out:
            return pd.DataFrame({group: [], "qid": [], "id": [], "score": [], "_o": []})
        at, qid, item, score, place = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({group: pd.Series(groups, dtype=object).to_numpy()[at], "qid": qid, "id": item, "score": score, "_o": place})

    keys = ["_task", "_ib", "_qb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)
    w = Window.partitionBy(group, "qid").orderBy(F.desc(F.round("score", 12)), "_o", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "qid", "rank", "id", "score")


def nearest_post(posts: DataFrame) -> DataFrame:
    """Most similar other post of the same conversation and whether it shares a topic.

    ``posts``: conv, post_id, seq, topics, embedding. A best similarity of at most 1e-6
    gives no verdict (NULL). Ties go to the earlier post.
    """
    it = posts.select("conv", F.col("post_id").alias("id"), "embedding", "seq")
    near = knn_within(it, it.withColumnRenamed("id", "qid"), "conv", 1)
    return _same_topic(near, posts)


def _same_topic(near: DataFrame, posts: DataFrame) -> DataFrame:
    mine = posts.select("conv", F.col("post_id").alias("qid"), "topics")
    theirs = posts.select("conv", F.col("post_id").alias("id"), F.col("topics").alias("other_topics"))
    return (
        near.join(mine, ["conv", "qid"])
        .join(theirs, ["conv", "id"])
        .select(
            "conv", F.col("qid").alias("post_id"), "rank", F.col("id").alias("nearest_id"), "score",
            F.when(F.col("score") > 1e-6, F.arrays_overlap("topics", "other_topics")).alias("same_topic"),
        )
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; inside a lambda a plain column's expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _one_more(counts: Column, place: Column) -> Column:
    """Counts with one more at a place; -1 is none."""
    return _once(place, lambda p: F.transform(counts, lambda x, i: x + (i == p).cast("double")))


def chain_vectors(posts: DataFrame) -> DataFrame:
    """Hashed 2-gram unit vector of each post's reply chain read from the root to the post: (conv, post_id, embedding).

    No chain's text is put together. A stretch of a chain is known by its number of characters without spaces, the first and
    the last of them, and the counts of the 2-grams inside; joining two stretches adds the gram at the seam. Each round
    doubles the stretch that ends in a post, so the work is rows times the logarithm of the longest chain. Null texts count
    as empty. ``posts``: conv, post_id, seq, reply target as in :func:`graph.reply_parents`, text.
    """
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(""))
    nothing = F.array_repeat(F.lit(0.0), NGRAM_DIM)
    own = posts.select("conv", "post_id", plain.alias("_t")).withColumn("n", F.length("_t").cast("long"))
    state = cut_lineage(
        own.join(reply_parents(posts), ["conv", "post_id"], "left").select(
            "conv", "post_id", F.col("parent_id").alias("top"), "n", F.substring("_t", 1, 1).alias("first"), F.substring("_t", -1, 1).alias("last"),
            F.when(F.col("n") > 1, ngram_counts("_t")).otherwise(nothing).alias("counts"),
        )
    )
    both = (F.col("n") > 0) & (F.col("_n") > 0)
    seam = F.when(both, md5_bucket(F.concat("_last", "first"))).otherwise(F.lit(-1))
    while not state.where(F.col("top").isNotNull()).isEmpty():
        up = state.select("conv", F.col("post_id").alias("top"), *[F.col(c).alias(f"_{c}") for c in ("top", "n", "first", "last", "counts")])
        state = cut_lineage(
            state.join(up, ["conv", "top"], "left").select(
                "conv", "post_id", F.col("_top").alias("top"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
                F.when(F.col("_n") > 0, F.col("_first")).otherwise(F.col("first")).alias("first"),
                F.when(F.col("n") > 0, F.col("last")).otherwise(F.coalesce("_last", "last")).alias("last"),
                F.when(F.col("_n").isNull(), F.col("counts")).otherwise(
                    _one_more(F.zip_with("counts", "_counts", lambda x, y: x + y), seam)
                ).alias("counts"),
            )
        )
    # A chain of one character has that gram alone, one without any the empty gram.
    alone = F.when(F.col("n") < 2, md5_bucket(F.when(F.col("n") == 1, F.col("first")).otherwise(F.lit("")))).otherwise(F.lit(-1))
    unit = _once(_one_more(F.col("counts"), alone), lambda c: _once(
        F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)), lambda length: F.transform(c, lambda x: x / length)
    ))
    return state.select("conv", "post_id", unit.alias("embedding"))


def nearest_context(posts: DataFrame, contexts: DataFrame, k: int = 3) -> DataFrame:
    """Each post against the reply-chain texts of every earlier post; a hit shares topics with the chain's last post.

    ``contexts``: conv, post_id, seq, embedding of the chain that ends in the post.
    """
    it = contexts.select("conv", F.col("post_id").alias("id"), "embedding", "seq")
    q = posts.select("conv", F.col("post_id").alias("qid"), "embedding", "seq")
    return _same_topic(knn_within(it, q, "conv", k, order="seq"), posts)


def cosine_matrix(vectors: DataFrame, key: str) -> DataFrame:
    """Similarity of every pair of a short list of vectors, the product a matrix display needs."""
    q = vectors.select(F.col(key).alias("qid"), "embedding")
    return similarities(q, vectors, key).withColumnRenamed("score", "similarity")
