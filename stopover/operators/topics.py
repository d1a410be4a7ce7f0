"""Conversation topics: nouns, routing as posts arrive, and quality of the resulting groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopover.functions.rules import drop_replies
from stopover.functions.stats import auc, best_threshold, prefix_sum, share
from stopover.functions.text import bigram_matrix, is_ack, is_question
from stopover.operators.ordered import fold_in_order
from stopover.operators.routing import OFF, V1, V2, Contexts, Talk, decide, unit, v1_end, v2_end

DELTAS = (0.01, 0.02, 0.03)

# Words that do not point to a topic.
STOP_NOUNS = (
    "こと", "もの", "ところ", "方", "順", "横", "ほう", "の", "今度", "ちなみ", "気", "はず", "とき", "ころ", "頃", "時",
    "今日", "昨日", "明日", "前", "後", "名前", "経由", "うろ覚え", "感じ", "ため", "よう", "そう",
)
_NOUN_RUN = r"[\p{IsHan}\p{IsKatakana}々ー]+|[\p{IsLatin}][\p{IsLatin}0-9]+"


def extract_nouns(text: Column) -> Column:
    """Distinct noun candidates of at least two characters, without the stop words.

    Runs of kanji and katakana stand for consecutive nouns, Latin words for themselves. A
    morphological tagger plugs in as a pandas UDF that returns the same array.
    """
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(_NOUN_RUN), 0))
    return F.filter(runs, lambda n: (F.length(n) >= 2) & ~n.isin(*STOP_NOUNS))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def bigram_counts(s: pd.Series) -> pd.Series:
    """Hashed 2-gram counts of a text, not normalised, so that they add up over a topic."""
    return pd.Series(list(bigram_matrix(s.fillna("").tolist())), index=s.index, dtype=object)


def prepare_posts(posts: DataFrame, nouns=extract_nouns) -> DataFrame:
    """Posts with what the routers look at: nouns, question and acknowledgement marks, 2-gram counts."""
    squeezed = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    return posts.withColumn("nouns", nouns(F.col("text"))).select(
        "*",
        is_question(F.col("text")).alias("is_question"),
        is_ack(F.col("text"), F.col("nouns")).alias("is_ack"),
        bigram_counts(F.col("text")).alias("counts"),
        F.substring(squeezed, 1, 1).alias("head"), F.substring(squeezed, -1, 1).alias("tail"),
        F.length(squeezed).alias("chars"),
    )


_ROUTED = "post_id string, assign string, reason string, deferred boolean"


def with_config(posts: DataFrame, **columns) -> DataFrame:
    """Posts with one column per router setting; ``drop`` and ``seed`` empty reply links."""
    drop, seed = columns.pop("drop", 0.0), columns.pop("seed", 0)
    out = posts.withColumn("replies", drop_replies(F.col("reply_to"), F.concat_ws("/", F.col("conv").cast("string"), "post_id"), seed, drop))
    for k, v in columns.items():
        out = out.withColumn(k, F.lit(v))
    return out.withColumn("drop", F.lit(float(drop))).withColumn("seed", F.lit(seed))


def _routed(rows: DataFrame, rules: list, end, settings: list[str]) -> DataFrame:
    """Each conversation through a table of rules; ``settings`` are columns, the same in all posts of a conversation."""
    def step(talks: list[Talk], post: dict) -> list[dict]:
        if not talks:
            talks.append(Talk({k: post[k] for k in settings}))
        post["vector"] = unit(np.asarray(post["counts"]))
        return decide(rules, talks[0], post, post["replies"])

    return fold_in_order(rows, ["conv"], ["seq"], list, step, lambda talks: end(talks[0]), _ROUTED)


def route_posts_v1(
    posts: DataFrame, delta: float = 0.02, ctx: str = "concat", drop: float = 0.0, seed: int = 0, branch_k: int = 2, oracle: bool = False
) -> DataFrame:
    """Rule router with pending questions: (conv, post_id, assign, reason, deferred).

    ``posts`` come from :func:`prepare_posts`.
    """
    rows = with_config(posts, delta=delta, ctx=ctx, drop=drop, seed=seed, branch_k=branch_k, oracle=oracle)
    return _routed(rows, V1, v1_end, ["delta", "ctx", "branch_k", "oracle"])


def route_posts_v2(
    posts: DataFrame, th_new: float, th_branch: float, delta: float = 0.02, drop: float = 0.0, seed: int = 0, oracle: bool = False, ctx: str = "concat"
) -> DataFrame:
    """Threshold router with tentative topics. Thresholds may also be columns of ``posts``."""
    rows = with_config(posts, delta=delta, ctx=ctx, drop=drop, seed=seed, oracle=oracle)
    for k, v in (("th_new", th_new), ("th_branch", th_branch)):
        if k not in posts.columns:
            rows = rows.withColumn(k, F.lit(v))
    return _routed(rows, V2, v2_end, ["delta", "ctx", "oracle", "th_new", "th_branch"])


SETTINGS = ["ctx", "delta", "branch_k", "drop", "seed", "oracle"]


def sweep_v1(posts: DataFrame, ctxs=("concat", "mean"), deltas=DELTAS, branches=(0, 1, 2), drops=(0.0, 0.5, 1.0), seeds: int = 20) -> DataFrame:
    """Every setting on every conversation in one job, scored per setting and conversation.

    Posts are read once: a conversation carries one state for each setting, and its rows name the setting by number. Partial
    reply removal is repeated over the seeds.
    """
    grid = [
        (c, float(d), b, float(p), s, o)
        for c in ctxs for d in deltas for b in branches for p in drops
        for s in (range(seeds) if 0 < p < 1 else [0]) for o in (False, True)
    ]
    settings = [dict(zip(SETTINGS, g, strict=True)) for g in grid]
    draw = lambda s: F.pmod(F.xxhash64(F.lit(s), F.concat_ws("/", F.col("conv").cast("string"), "post_id")), F.lit(1_000_000)) / 1_000_000.0
    rows = posts.withColumn("draws", F.array(*[draw(s) for s in range(max(seeds, 1))]))

    def step(talks: list[Talk], post: dict) -> list[dict]:
        if not talks:
            talks.extend(Talk(x) for x in settings)
        post["vector"] = unit(np.asarray(post["counts"]))
        out = []
        for i, talk in enumerate(talks):
            replies = [] if post["draws"][talk.setting["seed"]] < talk.setting["drop"] else post["reply_to"]
            out.extend({**row, "setting": i} for row in decide(V1, talk, post, replies))
        return out

    def end(talks: list[Talk]) -> list[dict]:
        return [{**row, "setting": i} for i, talk in enumerate(talks) for row in v1_end(talk)]

    found = fold_in_order(rows, ["conv"], ["seq"], list, step, end, _ROUTED + ", setting int")
    named = posts.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(grid)], "setting int, ctx string, delta double, branch_k int, drop double, seed int, oracle boolean")
    routed = found.join(F.broadcast(named), "setting").drop("setting")  # one row for each setting asked for
    scored = routed.join(posts.select("conv", "post_id", "seq", "topics"), ["conv", "post_id"])
    by = [*SETTINGS, "conv"]
    return topic_accuracy(scored, by).join(bcubed(scored, by), by)


def sweep_summary(scores: DataFrame) -> DataFrame:
    """Sweep averaged over seeds, then over conversations by their size; automatic accuracy by automatic posts."""
    per = scores.groupBy(*[s for s in SETTINGS if s != "seed"], "conv").agg(
        *[F.avg(c).alias(c) for c in ("acc", "acc_auto", "ai_rate", "bcubed", "n_topics", "n")]
    )
    auto = F.when(F.col("acc_auto").isNotNull(), F.col("n") * (1 - F.col("ai_rate")))
    return per.groupBy(*[s for s in SETTINGS if s != "seed"]).agg(
        (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("acc"),
        share(F.sum(F.col("acc_auto") * auto), F.sum(auto)).alias("acc_auto"),
        (F.sum(F.col("ai_rate") * F.col("n")) / F.sum("n")).alias("ai_rate"),
        (F.sum(F.col("bcubed") * F.col("n")) / F.sum("n")).alias("bcubed"),
        F.sum("n_topics").alias("n_topics"),
    )


# ------------------------------------------------------------------ diagnostics


def _measure(state: tuple[Contexts, dict], post: dict) -> list[dict]:
    """Rows of one post against the contexts of its conversation, which then take it in by its gold topics."""
    contexts, gold = state
    like = contexts.likeness(unit(np.asarray(post["counts"])), "concat")
    own = list(post["topics"])
    rows = []
    if own and own[0] in like:
        rest = [x for t, x in like.items() if t not in own]
        rows.append(("cont", like[own[0]], max(rest, default=None), None))
    elif own and like:
        rows.append(("start", max(like.values()), None, None))
    for theirs in filter(None, map(gold.get, post["reply_to"])):
        if theirs[0] in like:
            rows.append(("reply", like[theirs[0]], None, not set(own).intersection(theirs)))
    for t in own:
        contexts.add(t, post)
    gold[post["post_id"]] = own
    return [dict(zip(("post_id", "kind", "score", "other", "is_branch"), (post["post_id"], *r), strict=True)) for r in rows]


def similarity_diagnostics(posts: DataFrame) -> DataFrame:
    """Similarities measured against contexts built from gold before each post.

    Rows of kind start (best existing topic), cont (own topic, best other) and reply (target's
    topic, whether the reply branches off).
    """
    schema = "post_id string, kind string, score double, other double, is_branch boolean"
    return fold_in_order(posts, ["conv"], ["seq"], lambda: (Contexts(), {}), _measure, lambda state: [], schema)


def diagnostics_summary(diag: DataFrame) -> DataFrame:
    """One row: medians, AUC of continuing against starting, share closest to the own topic, AUC of branches."""
    start, cont, reply = (F.col("kind") == k for k in ("start", "cont", "reply"))
    base = diag.agg(
        F.percentile(F.when(start, F.col("score")), 0.5).alias("start_median"),
        F.percentile(F.when(cont, F.col("score")), 0.5).alias("cont_median"),
        F.avg(F.when(cont & F.col("other").isNotNull(), (F.col("score") > F.col("other")).cast("double"))).alias("own_share"),
        F.percentile(F.when(reply & ~F.col("is_branch"), F.col("score")), 0.5).alias("reply_median"),
        F.percentile(F.when(reply & F.col("is_branch"), F.col("score")), 0.5).alias("branch_median"),
    ).withColumn("_k", F.lit(1))
    new = auc(diag.where("kind <> 'reply'").withColumn("p", F.col("kind") == "cont"), [], "score", "p").select(F.lit(1).alias("_k"), F.col("auc").alias("auc_new"))
    branch = auc(diag.where("kind = 'reply'").withColumn("p", ~F.col("is_branch")), [], "score", "p").select(F.lit(1).alias("_k"), F.col("auc").alias("auc_branch"))
    return base.join(new, "_k").join(branch, "_k").drop("_k")


def thresholds(diag: DataFrame, by: list[str]) -> DataFrame:
    """th_new separates continuing from starting posts, th_branch straight replies from branches."""
    new = best_threshold(diag.where("kind <> 'reply'").withColumn("p", F.col("kind") == "cont"), by, "score", "p")
    branch = best_threshold(diag.where("kind = 'reply'").withColumn("p", ~F.col("is_branch")), by, "score", "p")
    a = new.select(*by, F.col("threshold").alias("th_new"))
    b = branch.select(*by, F.col("threshold").alias("th_branch"))
    if by:
        return a.join(b, by, "full")
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k", "full").drop("_k")


def leave_one_out_thresholds(diag: DataFrame, convs: DataFrame | None = None, folds: int | None = None) -> DataFrame:
    """Thresholds for each conversation from all others: (conv, th_new, th_branch).

    ``convs`` lists the conversations when some of them may have no diagnostic row.
    Every row serves every fold but its own, so the work is rows times folds. By default each
    conversation is a fold; with very many conversations give a number of folds, and a
    conversation is kept out together with those that share its fold.
    """
    convs = (diag if convs is None else convs).select("conv").distinct().withColumn("_one", F.lit(1))
    if folds is None:
        numbered = prefix_sum(convs, ["conv"], "_one", "_n").select("conv", (F.col("_n") - 1).cast("int").alias("fold"))
        n = F.max("fold") + 1
    else:
        numbered = convs.select("conv", F.pmod(F.xxhash64("conv"), F.lit(folds)).cast("int").alias("fold"))
        n = F.lit(folds)
    total = numbered.agg(n.cast("int").alias("_total"))
    rows = diag.join(numbered.withColumnRenamed("fold", "_own"), "conv").join(F.broadcast(total))  # one row
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_total") - 1))).where("fold <> _own")
    return numbered.join(thresholds(rows, ["fold"]), "fold", "left").select("conv", "th_new", "th_branch")


# ------------------------------------------------------------------ quality


def gold_sets(posts: DataFrame) -> DataFrame:
    """Adds ``gold``: topics and their aliases, {OFF} for a post without topics."""
    topics = F.col("topics")
    if "alias" in posts.columns:
        also = F.filter(F.transform(topics, lambda t: F.col("alias")[t]), lambda t: t.isNotNull())
        topics = F.array_union(topics, F.coalesce(also, F.array().cast("array<string>")))
    return posts.withColumn("gold", F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit(OFF))))


def majority_labels(posts: DataFrame, by: list[str], cluster: str = "assign") -> DataFrame:
    """Most frequent gold topic of each cluster, ties to the one seen first; OFF keeps its name."""
    votes = F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit(OFF)))
    rows = posts.select(*by, cluster, "seq", F.posexplode(votes).alias("pos", "g"))
    counts = rows.groupBy(*by, cluster, "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    best = counts.groupBy(*by, cluster).agg(F.min_by("g", F.struct((-F.col("n")).alias("n"), "first")).alias("label"))
    return best.withColumn("label", F.when(F.col(cluster) == OFF, OFF).otherwise(F.col("label")))


def topic_accuracy(posts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy after majority mapping, of automatic posts, if deferred posts were right, share deferred, topics."""
    rows = gold_sets(posts).join(majority_labels(posts, by), [*by, "assign"])
    ok = F.array_contains("gold", F.col("label")) & ((F.size("topics") > 0) | (F.col("label") == OFF))
    auto = ~F.col("deferred")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ok.cast("double")).alias("acc"),
        F.avg(F.when(auto, ok.cast("double"))).alias("acc_auto"),
        F.avg((ok | F.col("deferred")).cast("double")).alias("acc_upper"),
        F.avg(F.col("deferred").cast("double")).alias("ai_rate"),
        F.countDistinct(F.when(F.col("assign") != OFF, F.col("assign"))).alias("n_topics"),
    )


def bcubed(posts: DataFrame, by: list[str], cluster: str = "assign", gold: str | None = None) -> DataFrame:
    """B-cubed precision, recall and F with overlapping gold sets.

    Posts are counted by cluster and distinct gold set; only distinct sets that share a topic
    are matched, never posts with posts.
    """
    rows = posts if gold else gold_sets(posts)
    sig = F.array_sort(F.array_distinct(F.col(gold or "gold")))
    n = rows.groupBy(*by, F.col(cluster).alias("k"), sig.alias("sig")).agg(F.count(F.lit(1)).alias("n"))
    per_sig = n.groupBy(*by, "sig").agg(F.sum("n").alias("n_sig"))
    topics = per_sig.select(*by, "sig", "n_sig", F.explode("sig").alias("t"))
    other = topics.select(*by, F.col("sig").alias("sig2"), F.col("n_sig").alias("n2"), "t")
    pairs = topics.join(other, [*by, "t"]).select(*by, "sig", "sig2", "n2").distinct()
    gold_n = pairs.groupBy(*by, "sig").agg(F.sum("n2").alias("gold_n"))
    mates = n.select(*by, "k", F.col("sig").alias("sig2"), F.col("n").alias("m"))
    both = n.join(pairs.drop("n2"), [*by, "sig"]).join(mates, [*by, "k", "sig2"]).groupBy(*by, "k", "sig").agg(F.sum("m").alias("both"))
    cluster_n = n.groupBy(*by, "k").agg(F.sum("n").alias("cluster_n"))
    all_rows = n.join(both, [*by, "k", "sig"]).join(cluster_n, [*by, "k"]).join(gold_n, [*by, "sig"])
    out = all_rows.groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("both") / F.col("cluster_n")) / F.sum("n")).alias("bp"),
        (F.sum(F.col("n") * F.col("both") / F.col("gold_n")) / F.sum("n")).alias("br"),
    )
    f = F.when(F.col("bp") + F.col("br") > 0, 2 * F.col("bp") * F.col("br") / (F.col("bp") + F.col("br"))).otherwise(F.lit(0.0))
    return out.withColumn("bcubed", f)


def bcubed_merged(posts: DataFrame, by: list[str]) -> DataFrame:
    """B-cubed after clusters with the same majority topic are merged; aliases do not count."""
    labelled = posts.join(majority_labels(posts, by), [*by, "assign"])
    return bcubed(_plain_gold(labelled), by, "label", "gold")


def _plain_gold(posts: DataFrame) -> DataFrame:
    return posts.withColumn("gold", F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit(OFF))))


def bcubed_strict(posts: DataFrame, by: list[str]) -> DataFrame:
    """B-cubed with the first gold topic only."""
    first = F.array(F.coalesce(F.get("topics", F.lit(0)), F.lit(OFF)))
    return bcubed(posts.withColumn("gold", first), by, "assign", "gold")


def split_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Size-weighted means of conversation scores by condition and author type."""
    w = F.sum("n")
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("conversations"), w.alias("posts"),
        *[(F.sum(F.col(c) * F.col("n")) / w).alias(c) for c in ("acc", "bcubed", "bp", "br")],
    )


PROMPT_NAMES = ("object", "flow")
REPLY_NAMES = ("reply", "noreply")


def parse_conditions(names: DataFrame, column: str = "condition") -> DataFrame:
    """Condition names split into provider, runner, prompt, reply and run; malformed names are dropped."""
    p = F.split(column, "_")
    ok = F.size(p).isin(4, 5) & p[2].isin(*PROMPT_NAMES) & p[3].isin(*REPLY_NAMES)
    mode = F.when(p[1].endswith("n") & p[1].contains("seq"), "narrow").otherwise("full")
    return names.where(ok).select(
        "*", p[0].alias("provider"), p[1].alias("runner"), p[2].alias("prompt"), p[3].alias("reply"),
        F.get(p, F.lit(4)).alias("run"), mode.alias("mode"),
    )


# ------------------------------------------------------------------ chunked arrival

CHUNK, NARROW, RESEG_POSTS = 10, 3, 20


class ChunkState:
    """Topics and frozen placements of one conversation."""

    def __init__(self):
        self.topics: dict[str, str] = {}
        self.assign: dict[str, str] = {}
        self.calls, self.reseg = 0, None


def merge_chunk(st: ChunkState, row: dict) -> list[dict]:
    """Accept a chunk's answer, or say why not; a chunk merged before changes nothing.

    ``row``: kind (chunk or reseg), chunk, post_ids, topics (name pairs), assign (id pairs).
    """
    ids = list(row["post_ids"])
    topics, assign = dict(row["topics"] or []), dict(row["assign"] or [])
    reseg = row["kind"] == "reseg"
    done = st.reseg == row["chunk"] if reseg else all(i in st.assign for i in ids)
    problem = None
    if done:
        problem = "already merged"
    elif set(assign) != set(ids):
        problem = "assign differs from the posts"
    elif reseg and set(st.assign) != set(ids):
        problem = "state is not at this chunk"
    elif not reseg and not set(st.topics) <= set(topics):
        problem = "an earlier topic is missing"
    elif any(t != OFF and t not in topics for t in assign.values()):
        problem = "unknown topic"
    if problem is None:
        st.topics, st.calls = topics, st.calls + 1
        if reseg:
            st.assign, st.reseg = assign, row["chunk"]
        else:
            st.assign.update(assign)
    accepted = problem is None
    return [
        {"chunk": row["chunk"], "kind": row["kind"], "accepted": accepted, "problem": problem, "calls": st.calls,
         "post_id": i, "assign": assign.get(i) if accepted else None} for i in ids
    ]


MERGED = "chunk int, kind string, accepted boolean, problem string, calls int, post_id string, assign string"


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk answers merged in order, per conversation; one row per post and chunk.

    ``chunks``: conv, chunk, kind, post_ids, topics, assign, the last two as maps.
    """
    rows = chunks.select(
        "conv", "chunk", "kind", "post_ids", F.map_entries("topics").alias("topics"), F.map_entries("assign").alias("assign")
    )

    def step(st: ChunkState, row: dict) -> list[dict]:
        pairs = {k: [(e["key"], e["value"]) for e in (row[k] if row[k] is not None else [])] for k in ("topics", "assign")}
        return merge_chunk(st, {**row, **pairs})

    return fold_in_order(rows, ["conv"], ["chunk", "kind"], ChunkState, step, lambda s: [], MERGED)


def final_assignment(merged: DataFrame) -> DataFrame:
    """Last accepted placement of every post."""
    order = F.struct("chunk", F.col("kind") == "reseg")
    return merged.where("accepted").groupBy("conv", "post_id").agg(F.max_by("assign", order).alias("assign"))


def request_rows(posts: DataFrame, assigned: DataFrame, chunk: int | None = None, mode: str = "full") -> DataFrame:
    """Requests of one chunk, or of every chunk (None), per conversation: new posts, earlier posts shown, topic sizes, as JSON.

    Full mode shows all earlier posts with their topic, narrow mode the last three per topic, which keeps a request small
    however long the conversation is. Only earlier posts that are assigned are shown.
    """
    number = (F.floor(F.col("seq") / CHUNK) + 1).cast("int")
    posts = posts.select("conv", "seq", "post_id", "author", "reply_to", "text", number.alias("own"))
    asked = posts.select("conv", F.col("own").alias("chunk")).distinct() if chunk is None else posts.select("conv", F.lit(chunk).alias("chunk")).distinct()
    new = posts.withColumn("chunk", F.col("own")).join(asked, ["conv", "chunk"], "left_semi")
    by = ["conv", "chunk"]
    placed = posts.join(assigned, ["conv", "post_id"])
    if mode == "narrow":
        # Of one chunk only its last three posts of a topic can ever be shown.
        w = Window.partitionBy("conv", "own", "assign").orderBy(F.desc("seq"))
        last = placed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= NARROW).drop("_r")
        w = Window.partitionBy(*by, "assign").orderBy(F.desc("seq"))
        shown = last.join(asked, "conv").where("own < chunk").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= NARROW)
    else:
        shown = placed.join(asked, "conv").where("own < chunk")
    counted = placed.where(F.col("assign") != OFF).groupBy("conv", "own", "assign").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.join(asked, "conv").where("own < chunk").groupBy(*by, "assign").agg(F.sum("n").alias("n"))

    def packed(df: DataFrame, cols: list[str], order: str, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("p"))))
        return df.groupBy(*by).agg(F.to_json(F.transform(items, lambda x: x["p"])).alias(name))

    out = packed(new, ["post_id", "author", "reply_to", "text"], "seq", "new_posts")
    out = out.join(packed(shown, ["post_id", "author", "reply_to", "text", "assign"], "seq", "shown"), by, "left")
    return out.join(packed(sizes, ["assign", "n"], "assign", "topic_sizes"), by, "left")
