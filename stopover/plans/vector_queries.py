"""Retrieval, evaluation, agreement and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopover.functions import stats
from stopover.functions.text import normalize_name
from stopover.operators import containment, raters, relevance, vectors
from stopover.plans import derived as D

K = 10
QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def items(spark, sf):
    return D.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "item_id")


def centres(spark, sf):
    """Mean vector of each label: (label, embedding)."""
    e = D.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    return packed.select("label", F.transform("v", lambda p: p["m"]).alias("embedding"))


def label_queries(spark, sf):
    return D.cut_lineage(centres(spark, sf).select(F.col("label").alias("qid"), "embedding"))


def judgments(spark, sf):
    """Grade 3 for the query's label, 1 for a neighbouring label, 0 (not listed) otherwise."""
    e = items(spark, sf).select("item_id", "label")
    labels = e.select(F.col("label").alias("qid")).distinct()
    near = e.withColumn("qid", F.explode(F.array(F.col("label") - 1, F.col("label"), F.col("label") + 1)))
    return near.join(labels, "qid", "left_semi").select(
        "qid", "item_id", F.when(F.col("qid") == F.col("label"), 3).otherwise(1).alias("grade")
    )


def ranked(spark, sf):
    sims = vectors.similarities(label_queries(spark, sf), items(spark, sf), "item_id")
    return D.cut_lineage(relevance.rank_scores(sims.withColumn("score", F.round("score", 9)), ["qid"]))


_BASE = """
with c as materialized (select label as qid, list(m order by i) as v from (
  select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2) group by 1),
sim as materialized (select c.qid, e.vec_id as item_id, e.label, list_cosine_similarity(e.embedding::double[], c.v) as s from embeddings e, c),
knn as materialized (select * from (select *, row_number() over (partition by qid order by round(1 - s, 12), item_id) as rank from sim) where rank <= 10),
scored as materialized (select qid, item_id, label, round(s, 9) as score from sim where round(s, 9) > 1e-6),
ranked as materialized (select *, row_number() over (partition by qid order by score desc, item_id) as rank,
  case when label = qid then 3 when abs(label - qid) = 1 then 1 else 0 end as g from scored),
jud as (select c.qid, vec_id as item_id, case when label = c.qid then 3 else 1 end as grade from embeddings, c where abs(label - c.qid) <= 1)
"""
_NDCG = """
dcg as (select qid, sum(g/log2(rank + 1)) as d from ranked where rank <= 5 group by 1),
ideal as (select qid, sum(grade/log2(i + 1)) as d from (select qid, grade, row_number() over (partition by qid order by grade desc, item_id) as i from jud) where i <= 5 group by 1),
nd as (select qid, round(coalesce(dcg.d, 0)/ideal.d, 9) as ndcg from ideal left join dcg using (qid))
"""


@query("knn_exact", _BASE + "select qid, rank::int as rank, item_id as id, round(1 - s, 9) as dist from knn")
def _(spark, sf):
    out = vectors.knn_exact(items(spark, sf), label_queries(spark, sf), K)
    return out.withColumn("dist", F.round("dist", 9))


@query("knn_ndcg", _BASE + "," + _NDCG + "select qid, ndcg from nd")
def _(spark, sf):
    near = vectors.knn_exact(items(spark, sf), label_queries(spark, sf), K)
    rows = relevance.rank_scores(
        near.select("qid", F.col("id").alias("item_id"), F.round(1 - F.col("dist"), 9).alias("score")), ["qid"]
    )
    return relevance.ndcg(rows, judgments(spark, sf)).withColumn("ndcg", F.round("ndcg", 9))


@query("knn_all", """
with s as (select a.vec_id as qid, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s
  from embeddings a, embeddings b where a.vec_id <> b.vec_id)
select qid, rank::int as rank, id, round(1 - s, 9) as dist from (select *, row_number() over (partition by qid order by round(1 - s, 12), id) as rank from s) where rank <= 5""")
def _(spark, sf):
    it = items(spark, sf)
    out = vectors.knn_exact(it, it.withColumnRenamed("item_id", "qid"), 5, exclude_self=True)
    return out.withColumn("dist", F.round("dist", 9))


@query("knn_filtered", _BASE + "select qid, rank::int as rank, item_id as id, round(1 - s, 9) as dist from (select *, row_number() over (partition by qid order by round(1 - s, 12), item_id) as rank from sim where label < 5) where rank <= 10")
def _(spark, sf):
    out = vectors.knn_filtered(items(spark, sf), label_queries(spark, sf), K, F.col("label") < 5)
    return out.withColumn("dist", F.round("dist", 9))


_IVF = """
with c as materialized (select label as cell, list(m order by i) as v from (
  select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2) group by 1),
near as materialized (select e.vec_id as id, c.cell, row_number() over (partition by e.vec_id order by round(1 - list_cosine_similarity(e.embedding::double[], c.v), 12), c.cell) as r from embeddings e, c),
cand as (select distinct q.id as qid, i.id from near q join near i on q.cell = i.cell and i.r = 1 and q.r <= 4),
s as (select qid, cand.id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from cand join embeddings a on a.vec_id = qid join embeddings b on b.vec_id = cand.id),
approx as materialized (select * from (select *, row_number() over (partition by qid order by round(1 - s, 12), id) as rank from s) where rank <= 10)
"""


def _approx(spark, sf):
    it = items(spark, sf)
    quantiser = centres(spark, sf).select(F.col("label").alias("cell"), F.col("embedding").alias("centre"))
    return vectors.knn_approx(it, it.withColumnRenamed("item_id", "qid"), K, D.cut_lineage(quantiser), probes=4)


@query("knn_approx", _IVF + "select qid, rank::int as rank, id, round(1 - s, 9) as dist from approx")
def _(spark, sf):
    return _approx(spark, sf).withColumn("dist", F.round("dist", 9))


@query("ann_quality", _IVF + """,
full_s as (select a.vec_id as qid, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b),
exact as (select * from (select *, row_number() over (partition by qid order by round(1 - s, 12), id) as rank from full_s) where rank <= 10),
per as (select e.qid, count(a.id) as hit, max(case when e.rank = 1 and f.rank = 1 then 1 else 0 end) as top1
        from exact e left join approx a on a.qid = e.qid and a.id = e.id left join approx f on f.qid = e.qid and f.id = e.id and f.rank = 1 and e.rank = 1 group by 1),
n as (select qid, count(*) as n from approx group by 1)
select round(avg(hit/10.0::double), 9) as recall, round(avg(top1), 9) as top1, 1.0::double as ordered, round(avg(case when n.n < 10 then 1.0 else 0.0 end), 9) as short from per join n using (qid)""")
def _(spark, sf):
    it = items(spark, sf)
    exact = vectors.knn_exact(it, it.withColumnRenamed("item_id", "qid"), K)
    out = relevance.ann_quality(exact, _approx(spark, sf), K)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("ann_quality_kmeans")
def _(spark, sf):
    it = items(spark, sf)
    q = it.withColumnRenamed("item_id", "qid")
    approx = vectors.knn_approx(it, q, K, vectors.kmeans_centres(it, 8), probes=3)
    return relevance.ann_quality(vectors.knn_exact(it, q, K), approx, K)


@query("separation", _BASE + "select qid, round(min(score) filter (g >= 2) - max(score) filter (g = 0), 9) as separation from ranked group by 1")
def _(spark, sf):
    graded = relevance.with_grades(ranked(spark, sf), judgments(spark, sf))
    return relevance.separation(graded, ["qid"]).withColumn("separation", F.round("separation", 9))


@query("common_threshold", _BASE + """,
q as (select qid, min(score) filter (g >= 2) as lo, max(score) filter (g = 0) as hi from ranked group by 1),
u as (select r.* from ranked r join q using (qid) where lo is not null and hi is not null),
t as (select distinct score as t from u where g >= 2)
select * from (select t, (select count(*) from q where lo >= t and hi < t) as clean, (select count(*) from q where lo is not null and hi is not null) as n,
  (select count(*) from u where g >= 2 and score < t) as missed, (select count(*) from u where g = 0 and score >= t) as leaked,
  (select count(*) from u where g >= 2) as pos, (select count(*) from u where g = 0) as neg
from t) order by clean desc, missed + leaked, t limit 1""")
def _(spark, sf):
    return relevance.common_threshold(relevance.with_grades(ranked(spark, sf), judgments(spark, sf)))


@query("category_ndcg", _BASE + "," + _NDCG + "select case when qid % 3 = 0 then 'その他' else 'k' || qid % 3 end as category, round(avg(ndcg), 9) as ndcg, count(*) as queries from nd group by 1")
def _(spark, sf):
    nd = relevance.ndcg(ranked(spark, sf), judgments(spark, sf))
    q = label_queries(spark, sf).select(
        "qid", F.when(F.col("qid") % 3 != 0, F.concat(F.lit("k"), (F.col("qid") % 3).cast("string"))).alias("category")
    )
    return relevance.category_means(nd, q).withColumn("ndcg", F.round("ndcg", 9))


_RULES = """,
grid as (select unnest(generate_series(floor(min(score)*100)::bigint, ceil(max(score)*100)::bigint))/100.0::double as t from ranked where rank <= 10),
rules as (select 'top' as rule, unnest([1.0::double, 3.0, 5.0, 10.0]) as value union all select 'threshold', t from grid
          union all select 'gap', unnest([0.005::double, 0.01, 0.02, 0.03, 0.05])),
fs as (select qid, score as f from ranked where rank = 1),
sel as (select rule, value, r.qid, g, r.label from ranked r join fs using (qid) join rules on
   case rule when 'top' then rank <= value when 'threshold' then score >= value else rank <= 10 and score >= f - value end),
per as (select rule, value, qid, count(*) filter (g >= 2) as pos, count(*) filter (g = 0) as neg, count(*) as n, count(*) filter (g = 0 and label >= 5) as dis from sel group by 1, 2, 3),
tot as (select qid, count(*) filter (grade >= 2) as total from jud group by 1),
allq as (select rule, value, qid from rules, fs),
st as materialized (select rule, value, round(avg(case when pos + neg > 0 then pos/(pos + neg) end), 3) as "precision", round(avg(case when total > 0 then coalesce(pos, 0)/total end), 3) as recall,
  round(avg(coalesce(n, 0)), 3) as selected, round(avg(coalesce(dis, 0)), 3) as distractors
  from allq left join per using (rule, value, qid) left join tot using (qid) group by 1, 2)
"""


def _rule_stats(spark, sf):
    rows = ranked(spark, sf).join(items(spark, sf).select("item_id", (F.col("label") < 5).alias("judged")), "item_id")
    rows = D.cut_lineage(rows)
    rules = relevance.rule_table(spark, relevance.threshold_grid(rows))
    return relevance.rule_stats(rows, judgments(spark, sf), rules)


@query("rule_stats", _BASE + _RULES + "select * from st")
def _(spark, sf):
    return _rule_stats(spark, sf)


@query("best_f1_threshold", _BASE + _RULES + """select value as threshold, round(f1, 9) as f1 from (select value, coalesce(case when coalesce("precision", 0) + coalesce(recall, 0) > 0 then 2*coalesce("precision", 0)*coalesce(recall, 0)/(coalesce("precision", 0) + coalesce(recall, 0)) end, 0) as f1 from st where rule = 'threshold') order by round(f1, 12) desc, value limit 1""")
def _(spark, sf):
    return relevance.best_f1(_rule_stats(spark, sf)).withColumn("f1", F.round("f1", 9))


@query("size_report", _BASE + "select qid, max(score) filter (g >= 2) as best_relevant, max(score) filter (g = 0 and label >= 5) as best_distractor, count(*) filter (g = 0 and label >= 5 and rank <= 5) as distractors_top5, bool_or(g = 0 and label >= 5) filter (rank = 1) as first_is_distractor from ranked group by 1")
def _(spark, sf):
    rows = ranked(spark, sf).join(items(spark, sf).select("item_id", (F.col("label") < 5).alias("judged")), "item_id")
    return relevance.size_report(rows, judgments(spark, sf), [])


@query("review_sheet", _BASE + "select qid, rank::int as rank, item_id, round(score, 4) as score, null::int as grade from ranked where label >= 5 and rank <= 5")
def _(spark, sf):
    rows = ranked(spark, sf).join(items(spark, sf).select("item_id", (F.col("label") < 5).alias("judged")), "item_id")
    return relevance.review_sheet(rows)


@query("distractor_mix", "select s::int as size, count(*) filter (label < 5) as judged, least(s, count(*) filter (label >= 5)) as distractors from embeddings, unnest([0, 50, 100]) u(s) group by s")
def _(spark, sf):
    it = items(spark, sf)
    mix = relevance.distractor_mix(it.where("label < 5"), it.where("label >= 5"), [0, 50, 100])
    return mix.groupBy("size").agg(
        F.count(F.when(F.col("judged"), 1)).alias("judged"), F.count(F.when(~F.col("judged"), 1)).alias("distractors")
    )


@query("apply_review", _BASE + """,
rev as (select qid, item_id, case when g = 0 then 2 end as grade from ranked where rank <= 5),
ok as (select qid, item_id, grade from rev where grade is not null)
select qid, count(*) as judged, sum(grade)::bigint as grades from (select qid, item_id, grade from jud union all select * from ok) group by 1""")
def _(spark, sf):
    jud = judgments(spark, sf)
    graded = relevance.with_grades(ranked(spark, sf).where("rank <= 5"), jud)
    review = graded.select("qid", "item_id", F.when(F.col("grade").isNull(), 2).alias("grade"))
    out = relevance.apply_review(jud, review, items(spark, sf))
    return out.groupBy("qid").agg(F.count(F.lit(1)).alias("judged"), F.sum("grade").alias("grades"))


@query("build_pairs", _BASE + "select 'P' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as pair_id, qid, item_id from (select qid, item_id, row_number() over (order by qid, item_id) as n from knn)")
def _(spark, sf):
    near = vectors.knn_exact(items(spark, sf), label_queries(spark, sf), K)
    rows = near.select(F.lit(0).alias("seq"), "qid", F.col("id").alias("item_id"))
    return relevance.build_pairs(rows)


# ------------------------------------------------------------------ item search

_ALL = """
with c as materialized (select label, list(m order by i) as v from (
  select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2) group by 1),
vv as materialized (select a.vec_id as qid, b.vec_id as vid, a.label as ql, b.label as item_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b),
vc as materialized (select a.vec_id as qid, c.label as item_id, list_cosine_similarity(a.embedding::double[], c.v) as s from embeddings a, c)
"""


def _vector_tables(spark, sf):
    it = items(spark, sf)
    subject = it.select(F.col("item_id").alias("normalized_name"), "embedding")
    link = it.select(F.col("item_id").alias("normalized_name"), F.col("label").alias("item_id"))
    return it, subject, link


def _rank_sql(src: str, k: int = 5) -> str:
    return f"select qid, item_id, rank::int as rank, round(score, 9) as score from (select *, row_number() over (partition by qid order by round(score, 12) desc, item_id) as rank from ({src})) where rank <= {k}"


@query("subject_search", _ALL + _rank_sql("select qid, item_id, max(s) as score from vv group by 1, 2"))
def _(spark, sf):
    it, subject, link = _vector_tables(spark, sf)
    out = vectors.subject_search(it.select(F.col("item_id").alias("qid"), "embedding"), subject, link)
    return out.select("qid", "item_id", "rank", F.round("score", 9).alias("score"))


@query("item_search", _ALL + _rank_sql("select qid, item_id, s as score from vc"))
def _(spark, sf):
    iv = centres(spark, sf).select(F.col("label").alias("item_id"), F.lit("m").alias("model"), F.lit("full").alias("variant"), "embedding")
    q = items(spark, sf).select(F.col("item_id").alias("qid"), "embedding")
    out = vectors.item_search(q, iv, "m", "full")
    return out.select("qid", "item_id", "rank", F.round("score", 9).alias("score"))


@query("item_or_topic_search", _ALL + _rank_sql("select qid, item_id, max(s) as score from (select qid, item_id, s from vv union all select qid, item_id, s from vc) group by 1, 2"))
def _(spark, sf):
    it = items(spark, sf)
    iv = centres(spark, sf).select(F.col("label").alias("item_id"), F.lit("m").alias("model"), F.lit("full").alias("variant"), "embedding")
    tv = it.select(F.col("item_id").alias("topic_id"), F.lit("m").alias("model"), F.lit("about_findings").alias("variant"), "embedding")
    topics = it.select(F.col("item_id").alias("topic_id"), F.col("label").alias("item_id"))
    out = vectors.item_or_topic_search(it.select(F.col("item_id").alias("qid"), "embedding"), iv, tv, topics, "m")
    return out.select("qid", "item_id", "rank", F.round("score", 9).alias("score"))


def _topic_ranks(spark, sf):
    it = items(spark, sf).select(F.col("item_id").alias("topic_id"), F.lit("m").alias("model"), "embedding")
    tv = it.withColumn("variant", F.lit("about")).unionByName(
        it.withColumn("variant", F.lit("about_findings")).withColumn("embedding", F.reverse("embedding"))
    )
    return vectors.topic_search(label_queries(spark, sf), tv, "m")


_TOPICS = _BASE + """,
tv as (select vec_id, 'about' as variant, embedding::double[] as e from embeddings union all select vec_id, 'about_findings', list_reverse(embedding)::double[] from embeddings),
tr as materialized (select * from (select c.qid, variant, vec_id as topic_id, list_cosine_similarity(e, c.v) as s, row_number() over (partition by c.qid, variant order by round(1 - list_cosine_similarity(e, c.v), 12), vec_id) as rank from tv, c) where rank <= 3)
"""


@query("topic_search", _TOPICS + "select qid, variant, topic_id, rank::int as rank, round(s, 9) as score from tr")
def _(spark, sf):
    return _topic_ranks(spark, sf).withColumn("score", F.round("score", 9))


@query("topic_hit_rank", _TOPICS + "select qid, variant, max(topic_id) filter (rank = 1) as first_topic, (min(rank) filter (label = qid))::int as hit_rank, coalesce((min(rank) filter (label = qid)) = 1, false) as hit_at_1 from tr join embeddings e on e.vec_id = topic_id group by 1, 2")
def _(spark, sf):
    expected = items(spark, sf).select(F.col("label").alias("qid"), F.col("item_id").alias("topic_id"))
    return relevance.topic_hit_rank(_topic_ranks(spark, sf), expected)


@query("related_by_subject", """
with l as (select distinct o_custkey as item_id, strftime(o_orderdate, '%Y-%m-%d') || o_orderpriority as name from orders),
p as (select a.item_id as source_id, b.item_id, count(*)::double as score from l a join l b on a.name = b.name and a.item_id <> b.item_id group by 1, 2)
select source_id, item_id, score, rank::int as rank from (select *, row_number() over (partition by source_id order by score desc, item_id) as rank from p) where rank <= 5""")
def _(spark, sf):
    link = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("item_id"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority").alias("normalized_name"),
    ).distinct()
    return vectors.related_by_subject(link)


@query("related_by_subject_vectors", _ALL + """select source_id, item_id, rank::int as rank, round(score, 9) as score from (select *, row_number() over (partition by source_id order by round(score, 12) desc, item_id) as rank from (
  select ql as source_id, item_id, avg(b) as score from (select ql, qid, item_id, max(s) as b from vv where ql <> item_id group by 1, 2, 3) group by 1, 2)) where rank <= 5""")
def _(spark, sf):
    _, subject, link = _vector_tables(spark, sf)
    out = vectors.related_by_subject_vectors(link, subject, link.select("item_id").distinct())
    return out.select("source_id", "item_id", "rank", F.round("score", 9).alias("score"))


@query("related_by_vector", "select qid as source_id, rank::int as rank, id as item_id, round(s, 9) as score from (select *, row_number() over (partition by qid order by round(1 - s, 12), id) as rank from (select a.vec_id as qid, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b where a.vec_id <> b.vec_id)) where rank <= 5")
def _(spark, sf):
    iv = items(spark, sf).select("item_id", F.lit("m").alias("model"), F.lit("full").alias("variant"), "embedding")
    out = vectors.related_by_vector(iv, iv.select("item_id"), "m", "full")
    return out.withColumn("score", F.round("score", 9))


_WORDS = "with w as materialized (select distinct item_id, word from (select item_id, unnest(string_split_regex(lower(text), '[^a-zA-Z]+')) as word from benchmark) where length(word) >= 2)"


def _words(spark, sf):
    b = D.table(spark, sf, "benchmark")
    return b.select("item_id", F.explode(F.split(F.lower("text"), "[^a-zA-Z]+")).alias("normalized_name")).where(
        F.length("normalized_name") >= 2
    ).distinct()


@query("exact_search", _WORDS + ", s as (select doc_id as qid, item_id, count(*)::double as score from documents join w on contains(lower(text), word) group by 1, 2) select qid, item_id, score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, item_id) as rank from s) where rank <= 5")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.lower("text").alias("text"))
    return vectors.exact_search(docs, _words(spark, sf))


_PHRASES = """with l as (select list_filter(string_split_regex(lower(text), '[^a-zA-Z]+'), lambda x: x <> '') as l from benchmark),
w as (select distinct l[i] || ' ' || l[i + 1] as word from (select l, unnest(range(1, len(l))) as i from l)),
t as (select page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages)"""


@query("drop_overlapping_titles", _PHRASES + " select page_id, title from t where not exists (select 1 from w where contains(t.title, w.word) or contains(w.word, t.title))")
def _(spark, sf):
    titles = D.table(spark, sf, "pages").select(
        "page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title")
    )
    words = D.table(spark, sf, "benchmark").select(F.array_remove(F.split(F.lower("text"), "[^a-zA-Z]+"), "").alias("l")).where("size(l) > 1")
    pairs = F.transform(F.sequence(F.lit(0), F.size("l") - 2), lambda i: F.concat(F.get("l", i), F.lit(" "), F.get("l", i + 1)))
    names = words.select(F.explode(pairs).alias("normalized_name")).distinct()
    return containment.drop_overlapping_titles(titles, names, "page_id", "title", "normalized_name")


NGRAM_SQL = """
gram as (select key, c[i] || c[i + 1] as g from (select key, c, unnest(range(1, len(c))) as i from (select key, string_split(replace(text, ' ', ''), '') as c from {src}) where len(c) > 1)
         union all select key, replace(text, ' ', '') from {src} where length(replace(text, ' ', '')) <= 1),
gn as (select key, g, count(*) as n, md5(g) as h from gram group by 1, 2),
bk as (select key, (256*((('0x' || substr(h, 1, 8))::bigint + ('0x' || substr(h, 9, 8))::bigint + ('0x' || substr(h, 17, 8))::bigint) % 384) + ('0x' || substr(h, 25, 8))::bigint) % 384 as bucket, sum(n)::double as n from gn group by 1, 2),
nw as materialized (select key, bucket, n/sqrt(sum(n*n) over (partition by key)) as w from bk)
"""


@query("embed_ngram", "with src as (select doc_id as key, text from documents), " + NGRAM_SQL.format(src="src") + "select key as doc_id, bucket::int as bucket, round(w, 9) as weight from nw")
def _(spark, sf):
    out = vectors.ngram_weights(D.table(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 9))


@query("embed_model")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    out = vectors.embed(docs, "text", "ngram-baseline")
    return out.select("doc_id", "model", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("normalize_name", "select p_partkey, replace(lower(p_name), ' ', '') as key from part")
def _(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", normalize_name(F.col("p_name")).alias("key"))


# ------------------------------------------------------------------ raters

_PAIRS = "with p as materialized (select lang, quality*2 + toxic as a, (n_chars % 4)::int as b, case n_chars % 5 when 0 then 'same_target' when 1 then 'same_place' when 2 then 'same_viewpoint' when 3 then 'similar_topic' else 'none' end as reason_type from labels join documents using (doc_id))"


def _pairs(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    reasons = F.array(*[F.lit(r) for r in raters.REASONS])
    return D.table(spark, sf, "labels").join(d, "doc_id").select(
        "lang", (F.col("quality") * 2 + F.col("toxic")).alias("a"), (F.col("n_chars") % 4).cast("int").alias("b"),
        F.element_at(reasons, (F.col("n_chars") % 5 + 1).cast("int")).alias("reason_type"),
    )


def _kappa_sql(a: str, b: str) -> str:
    return f"""{_PAIRS}, q as (select lang, {a} as a, {b} as b from p), t as (select lang, count(*) as n, count(*) filter (a = b) as same from q group by 1),
na as (select lang, a, count(*) as c from q group by 1, 2), nb as (select lang, b, count(*) as c from q group by 1, 2),
pe as (select lang, sum(na.c*nb.c) as s from na join nb using (lang) where a = b group by 1)
select lang, round(same/n, 9) as agreement, round(case when coalesce(s, 0)/(n*n) < 1 then (same/n - coalesce(s, 0)/(n*n))/(1 - coalesce(s, 0)/(n*n)) else 0 end, 9) as kappa from t left join pe using (lang)"""


_THREE = "case when {0} = 0 then 0 when {0} >= 2 then 2 else 1 end"


def _round_all(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


@query("kappa", _kappa_sql("a", "b"))
def _(spark, sf):
    return _round_all(raters.kappa(_pairs(spark, sf), ["lang"]), ["agreement", "kappa"])


@query("kappa_three_levels", _kappa_sql(_THREE.format("a"), _THREE.format("b")))
def _(spark, sf):
    return _round_all(raters.kappa(_pairs(spark, sf), ["lang"], collapse=True), ["agreement", "kappa"])


@query("weighted_kappa", f"""{_PAIRS}, o as (select lang, avg((a - b)*(a - b)/9.0::double) as o, count(*) as n from p group by 1),
na as (select lang, a, count(*) as c from p group by 1, 2), nb as (select lang, b, count(*) as c from p group by 1, 2),
x as (select lang, sum((a - b)*(a - b)/9.0::double*na.c*nb.c) as s from na join nb using (lang) group by 1)
select lang, round(1 - o/(s/(n*n)), 9) as weighted_kappa from o join x using (lang)""")
def _(spark, sf):
    return _round_all(raters.weighted_kappa(_pairs(spark, sf), ["lang"]), ["weighted_kappa"])


@query("agreement_bands", f"""{_PAIRS}, q as (select *, {_THREE.format('a')} as a3, {_THREE.format('b')} as b3 from p)
select lang, count(*) as n, count(*) filter (abs(a3 - b3) = 2) as opposite, count(*) filter (a3 > b3) as higher, count(*) filter (a3 < b3) as lower,
count(*) filter (a >= 2) as a_high, count(*) filter (a >= 2 and b >= 2) as a_high_b_high, count(*) filter (a >= 2 and b = 0) as a_high_b_zero,
count(*) filter (a = 0) as a_zero, count(*) filter (a = 0 and b = 0) as a_zero_b_zero, count(*) filter (a = 0 and b >= 2) as a_zero_b_high,
count(*) filter (a = 1) as a_middle, count(*) filter (b = 0 and a >= 1) as too_loose, count(*) filter (b >= 2 and a <= 1) as too_strict from q group by 1""")
def _(spark, sf):
    return raters.agreement_bands(_pairs(spark, sf), ["lang"])


@query("reason_histogram", f"{_PAIRS} select lang, " + ", ".join(f"count(*) filter (reason_type = '{r}') as {r}" for r in raters.REASONS) + " from p where a >= 1 group by 1")
def _(spark, sf):
    return raters.reason_histogram(_pairs(spark, sf), ["lang"])


# ------------------------------------------------------------------ statistics


def _position_sql(pos: str, shares: str) -> str:
    return f"with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) select event_type, p as share, value from s, unnest({shares}) u(p) where i = least(n - 1, ({pos})::bigint)"


for _rule, _pos in (
    ("nearest", "greatest(1, ceil(round(p*n, 9))) - 1"),
    ("rounded", "round_even(p*(n - 1), 0)"),
    ("floor", "floor(p*n)"),
):
    def _make(rule):
        def run(spark, sf):
            return stats.percentiles(D.table(spark, sf, "events"), ["event_type"], "value", [0.5, 0.9], rule)
        return run

    query(f"percentile_{_rule}", _position_sql(_pos, "[0.5::double, 0.9::double]"))(_make(_rule))


@query("percentile_median", "select event_type, 0.5::double as share, median(value) as value from events group by 1")
def _(spark, sf):
    return stats.percentiles(D.table(spark, sf, "events"), ["event_type"], "value", [0.5], "median")


_PN = "with x as materialized (select lang, n_chars::double as s, quality = 1 as p from labels join documents using (doc_id))"


def _scored(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("s"))
    return D.table(spark, sf, "labels").join(d, "doc_id").select("lang", "s", (F.col("quality") == 1).alias("p"))


@query("auc", f"{_PN} select a.lang, round(avg(case when a.s > b.s then 1.0::double when a.s = b.s then 0.5 else 0 end), 9) as auc from x a join x b on a.lang = b.lang and a.p and not b.p group by 1")
def _(spark, sf):
    return stats.auc(_scored(spark, sf), ["lang"], "s", "p").withColumn("auc", F.round("auc", 9)).where("auc is not null")


@query("best_threshold", f"""{_PN}, v as (select lang, s, lag(s) over (partition by lang order by s) as pv from (select distinct lang, s from x)),
c as (select lang, case when pv is null then s else (pv + s)/2 end as t from v),
b as (select c.lang, t, round((avg(case when p then (x.s >= t)::int end) + avg(case when not p then (x.s < t)::int end))/2, 12) as ba from c join x on x.lang = c.lang group by 1, 2)
select lang, t as threshold, round(ba, 9) as balanced_accuracy from (select *, row_number() over (partition by lang order by ba desc, t) as rn from b where ba is not null) where rn = 1""")
def _(spark, sf):
    out = stats.best_threshold(_scored(spark, sf), ["lang"], "s", "p")
    return out.withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query("latency_summary", """with s as (select event_type, value, epoch_us(ts) as began, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, count(*) as calls, round(avg(value), 6) as mean_sec, max(value) as max_sec, round(count(*) / (max(began / 1e6 + value) - min(began / 1e6)), 6) as per_sec,
  median(value) as p50_sec, max(value) filter (i = greatest(1, ceil(round(0.95*n, 9)))) as p95_sec from s group by 1""")
def _(spark, sf):
    calls = D.table(spark, sf, "events").where("value is not null").withColumn("began", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = stats.latency_summary(calls, ["event_type"], "value", "began")
    return out.withColumn("mean_sec", F.round("mean_sec", 6)).withColumn("per_sec", F.round("per_sec", 6))


@query("line_fit", "select l_returnflag, round(slope, 4) as slope, round(intercept, 2) as intercept, x, round(intercept + slope*x, 2) as estimate from (select l_returnflag, regr_slope(l_extendedprice, l_quantity) as slope, regr_intercept(l_extendedprice, l_quantity) as intercept from lineitem group by 1), unnest([10.0::double, 100.0::double]) u(x)")
def _(spark, sf):
    out = stats.line_fit(D.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", [10, 100])
    return out.withColumn("slope", F.round("slope", 4)).withColumn("intercept", F.round("intercept", 2)).withColumn("estimate", F.round("estimate", 2))


@query("category_shares", "select coalesce(o_orderpriority, 'total') as o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus = 'F') as filled, round(count(*) filter (o_orderstatus = 'O')/count(*), 9) as open_share, round(count(*) filter (o_orderstatus = 'F')/count(*), 9) as filled_share from orders group by rollup (o_orderpriority)")
def _(spark, sf):
    o = D.table(spark, sf, "orders")
    out = stats.category_shares(o, "o_orderpriority", {"open": F.col("o_orderstatus") == "O", "filled": F.col("o_orderstatus") == "F"})
    return _round_all(out, ["open_share", "filled_share"])
