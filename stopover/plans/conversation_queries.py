"""Topic routing, clustering quality and evidence queries over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopover.functions.text import ngram_vector
from stopover.operators import claims as C
from stopover.operators import graph, topics, vectors
from stopover.plans import derived as D
from stopover.plans import sql as S
from stopover.plans.vector_queries import NGRAM_SQL

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


_P = f"with {S.CONVERSATIONS}"
_GOLD = f"{_P}, g as materialized (select *, case when len(topics) > 0 then topics else ['OFF'] end as gold from post)"
_LABEL = """, vote as (select conv, assign, t, count(*) as n, min(seq*100 + pos) as first from (select conv, assign, seq, unnest(gold) as t, generate_subscripts(gold, 1) as pos from g) group by 1, 2, 3),
lab as materialized (select conv, assign, case when assign = 'OFF' then 'OFF' else t end as label from (select *, row_number() over (partition by conv, assign order by n desc, first) as rn from vote) where rn = 1)
"""


@query("majority_labels", _GOLD + _LABEL + "select conv, assign, label from lab")
def _(spark, sf):
    return topics.majority_labels(D.conversations(spark, sf), ["conv"])


@query("topic_accuracy", _GOLD + _LABEL + """, r as (select g.*, label, (list_contains(gold, label) and (len(topics) > 0 or label = 'OFF')) as ok from g join lab using (conv, assign))
select conv, count(*) as n, round(avg(ok::int), 9) as acc, round(avg(ok::int) filter (not deferred), 9) as acc_auto, round(avg((ok or deferred)::int), 9) as acc_upper,
round(avg(deferred::int), 9) as ai_rate, count(distinct assign) filter (assign <> 'OFF') as n_topics from r group by 1""")
def _(spark, sf):
    out = topics.topic_accuracy(D.conversations(spark, sf), ["conv"])
    return _round(out, "acc", "acc_auto", "acc_upper", "ai_rate")


def _bcubed_sql(cluster: str, gold: str, head: str = _GOLD) -> str:
    return head + f""", x as materialized (select conv, post_id, {cluster} as k, {gold} as gg from g2),
pairs as (select a.conv, a.post_id, count(*) filter (a.k = b.k) as sp, count(*) filter (list_has_any(a.gg, b.gg)) as sg, count(*) filter (a.k = b.k and list_has_any(a.gg, b.gg)) as bo
  from x a join x b on a.conv = b.conv group by 1, 2),
m as (select conv, avg(bo/sp) as bp, avg(bo/sg) as br from pairs group by 1)
select conv, round(bp, 9) as bp, round(br, 9) as br, round(case when bp + br > 0 then 2*bp*br/(bp + br) else 0 end, 9) as bcubed from m"""


@query("bcubed", _bcubed_sql("assign", "gold", _GOLD + ", g2 as (select * from g)"))
def _(spark, sf):
    return _round(topics.bcubed(D.conversations(spark, sf), ["conv"]), "bp", "br", "bcubed")


@query("bcubed_merged", _bcubed_sql("label", "gold", _GOLD + _LABEL + ", g2 as (select g.*, label from g join lab using (conv, assign))"))
def _(spark, sf):
    return _round(topics.bcubed_merged(D.conversations(spark, sf), ["conv"]), "bp", "br", "bcubed")


@query("bcubed_strict", _bcubed_sql("assign", "[gold[1]]", _GOLD + ", g2 as (select * from g)"))
def _(spark, sf):
    return _round(topics.bcubed_strict(D.conversations(spark, sf), ["conv"]), "bp", "br", "bcubed")


@query("split_summary", _bcubed_sql("assign", "gold", _GOLD + ", g2 as (select * from g)").replace("select conv, round(bp", "select 'c' as condition, count(*) as conversations, sum(n)::bigint as posts, round(sum(n*b)/sum(n), 9) as bcubed from (select conv, n, case when bp + br > 0 then 2*bp*br/(bp + br) else 0 end as b from m join (select conv, count(*) as n from post group by 1) using (conv)) -- round(bp", 1))
def _(spark, sf):
    posts = D.conversations(spark, sf)
    scores = topics.topic_accuracy(posts, ["conv"]).join(topics.bcubed(posts, ["conv"]), "conv").withColumn("condition", F.lit("c"))
    out = topics.split_summary(scores, ["condition"])
    return _round(out.select("condition", "conversations", "posts", "bcubed"), "bcubed")


def _prepared(spark, sf):
    return D.cut_lineage(topics.prepare_posts(D.conversations(spark, sf)))


@query("route_posts_v1")
def _(spark, sf):
    return topics.route_posts_v1(_prepared(spark, sf))


@query("route_posts_v1_oracle")
def _(spark, sf):
    posts = _prepared(spark, sf)
    routed = topics.route_posts_v1(posts, oracle=True, ctx="mean", drop=0.5, seed=3)
    return topics.topic_accuracy(routed.join(posts.select("conv", "post_id", "seq", "topics"), ["conv", "post_id"]), ["conv"])


@query("similarity_diagnostics", """
with """ + S.CONVERSATIONS + """, t as (select conv, seq, post_id, parent, topics, unnest(topics) as t from post),
started as (select conv, t, min(seq) as s from t group by 1, 2),
one as (select p.conv, p.seq, p.topics[1] as g, p.parent, p.topics from post p)
select kind, count(*) as n, count(*) filter (b) as branches from (
  select case when s.s = o.seq then 'start' else 'cont' end as kind, null::boolean as b from one o join started s on s.conv = o.conv and s.t = o.g
    where s.s < o.seq or exists (select 1 from started z where z.conv = o.conv and z.s < o.seq)
  union all
  select 'reply', not list_has_any(o.topics, q.topics) from one o join post q on q.conv = o.conv and q.post_id = o.parent where len(q.topics) > 0) group by 1""")
def _(spark, sf):
    diag = topics.similarity_diagnostics(_prepared(spark, sf))
    return diag.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_branch"), 1)).alias("branches"))


@query("diagnostics_summary")
def _(spark, sf):
    return topics.diagnostics_summary(D.cut_lineage(topics.similarity_diagnostics(_prepared(spark, sf))))


@query("leave_one_out_thresholds")
def _(spark, sf):
    posts = _prepared(spark, sf)
    return topics.leave_one_out_thresholds(D.cut_lineage(topics.similarity_diagnostics(posts)), posts)


@query("route_posts_v2")
def _(spark, sf):
    posts = _prepared(spark, sf)
    diag = D.cut_lineage(topics.similarity_diagnostics(posts))
    with_th = posts.join(topics.leave_one_out_thresholds(diag, posts), "conv").fillna(0.0, ["th_new", "th_branch"])
    return topics.route_posts_v2(with_th, 0.0, 0.0)


@query("sweep_v1")
def _(spark, sf):
    return topics.sweep_summary(topics.sweep_v1(_prepared(spark, sf)))


@query("reply_chains", f"""with recursive {S.CONVERSATIONS},
ch(conv, post_id, cur, depth, chain) as (
  select conv, post_id, parent, 0, []::varchar[] from post
  union all
  select ch.conv, ch.post_id, p.parent, depth + 1, list_append(chain, cur) from ch join post p on p.conv = ch.conv and p.post_id = ch.cur where depth < 8)
select conv, post_id, array_to_string(chain, ',') as chain from (select *, row_number() over (partition by conv, post_id order by depth desc) as rn from ch) where rn = 1""")
def _(spark, sf):
    return graph.reply_chains(D.conversations(spark, sf)).withColumn("chain", F.array_join("chain", ","))


@query("post_context", f"""with recursive {S.CONVERSATIONS},
ch(conv, post_id, cur, depth) as (
  select conv, post_id, parent, 1 from post where parent is not null
  union all
  select ch.conv, ch.post_id, p.parent, depth + 1 from ch join post p on p.conv = ch.conv and p.post_id = ch.cur where depth < 8 and p.parent is not null),
c as (select conv, post_id, cur as ctx from ch union select a.conv, a.post_id, b.post_id from post a join post b on a.conv = b.conv and b.seq between a.seq - 5 and a.seq - 1)
select p.conv, p.post_id, coalesce(string_agg(c.ctx, ',' order by q.seq), '') as context from post p left join c using (conv, post_id) left join post q on q.conv = c.conv and q.post_id = c.ctx group by 1, 2""")
def _(spark, sf):
    return C.post_context(D.conversations(spark, sf)).withColumn("context", F.array_join("context", ","))


_NEAREST = f"""with {S.CONVERSATIONS}, src as (select conv || '/' || post_id as key, text from post), {NGRAM_SQL.format(src='src')},
k as (select *, conv || '/' || post_id as key from post),
s as (select a.conv, a.post_id, b.post_id as other, b.seq, a.topics as ta, b.topics as tb, round(coalesce(sum(x.w*y.w), 0), 12) as s from k a join k b on a.conv = b.conv and a.post_id <> b.post_id
  left join nw x on x.key = a.key left join nw y on y.key = b.key and y.bucket = x.bucket group by all)
select conv, post_id, 1::int as rank, other as nearest_id, round(s, 9) as score, case when s > 1e-6 then list_has_any(ta, tb) end as same_topic
from (select *, row_number() over (partition by conv, post_id order by s desc, seq) as rn from s) where rn = 1"""


@query("nearest_post", _NEAREST)
def _(spark, sf):
    posts = D.cut_lineage(D.conversations(spark, sf).withColumn("embedding", ngram_vector(F.col("text"))))
    return _round(vectors.nearest_post(posts), "score")


@query("nearest_context")
def _(spark, sf):
    posts = D.conversations(spark, sf)
    ctx = vectors.chain_vectors(posts).join(posts.select("conv", "post_id", "seq"), ["conv", "post_id"])
    return vectors.nearest_context(D.cut_lineage(posts.withColumn("embedding", ngram_vector(F.col("text")))), D.cut_lineage(ctx))


@query("request_rows", f"""{_P}, c as (select distinct conv, seq//10 + 1 as chunk from post),
done as (select c.conv, c.chunk, p.post_id, p.seq, p.assign from c join post p on p.conv = c.conv and p.seq//10 + 1 < c.chunk),
shown as (select conv, chunk, string_agg(post_id || ':' || assign, ',' order by seq) as shown from (select *, row_number() over (partition by conv, chunk, assign order by seq desc) as r from done) where r <= 3 group by 1, 2),
sizes as (select conv, chunk, string_agg(assign || ':' || n, ',' order by assign) as sizes from (select conv, chunk, assign, count(*) as n from done where assign <> 'OFF' group by 1, 2, 3) group by 1, 2),
fresh as (select conv, seq//10 + 1 as chunk, string_agg(post_id, ',' order by seq) as new_posts from post group by 1, 2)
select conv, chunk::int as chunk, new_posts, shown, sizes from fresh left join shown using (conv, chunk) left join sizes using (conv, chunk)""")
def _(spark, sf):
    posts = D.conversations(spark, sf)
    out = topics.request_rows(posts, posts.select("conv", "post_id", "assign"), None, "narrow")

    def listed(column: str, fields: str, parts: list[str]):
        rows = F.from_json(column, f"array<struct<{fields}>>")
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])), ",")

    return out.select(
        "conv", "chunk", listed("new_posts", "post_id:string", ["post_id"]).alias("new_posts"),
        listed("shown", "post_id:string,assign:string", ["post_id", "assign"]).alias("shown"), listed("topic_sizes", "assign:string,n:long", ["assign", "n"]).alias("sizes"),
    )


def _chunks(spark, sf):
    """One answer per run of three posts; an answer for a run that ends in a long text names an unknown topic."""
    p = D.conversations(spark, sf).withColumn("chunk", (F.floor(F.col("seq") / 3) + 1).cast("int"))
    entry = F.struct("post_id", F.when(F.length("text") % 11 == 0, "T99").otherwise(F.coalesce(F.get("topics", F.lit(0)), F.lit("OFF"))).alias("t"))
    per = p.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    named = F.transform(F.sequence(F.lit(0), F.col("chunk") - 1), lambda i: F.struct(F.concat(F.lit("T"), i.cast("string")).alias("k"), F.lit("name").alias("v")))
    return per.select(
        "conv", "chunk", F.lit("chunk").alias("kind"), F.transform("e", lambda x: x["post_id"]).alias("post_ids"),
        F.map_from_entries(named).alias("topics"), F.map_from_entries("e").alias("assign"),
    )


@query("merge_chunks", f"""{_P}, c as (select *, seq//3 + 1 as chunk, length(text) % 11 = 0 as bad from post),
ok as (select conv, chunk, not bool_or(bad) as ok from c group by 1, 2)
select conv, chunk::int as chunk, 'chunk' as kind, ok as accepted, case when not ok then 'unknown topic' end as problem, post_id, case when ok then coalesce(topics[1], 'OFF') end as assign from c join ok using (conv, chunk)""")
def _(spark, sf):
    return topics.merge_chunks(_chunks(spark, sf)).drop("calls")


@query("parse_conditions", "select condition, split_part(condition, '_', 1) as provider, split_part(condition, '_', 3) as prompt, split_part(condition, '_', 4) as reply, case when split_part(condition, '_', 2) like '%seq%n' then 'narrow' else 'full' end as mode from (select distinct concat_ws('_', lower(c_mktsegment), case when c_nationkey % 2 = 0 then 'seq10n' else 'api' end, case when c_nationkey % 3 = 0 then 'flow' when c_nationkey % 3 = 1 then 'object' else 'other' end, 'reply') as condition from customer) where split_part(condition, '_', 3) in ('flow', 'object')")
def _(spark, sf):
    c = D.table(spark, sf, "customer")
    k = F.col("c_nationkey")
    names = c.select(
        F.concat_ws("_", F.lower("c_mktsegment"), F.when(k % 2 == 0, "seq10n").otherwise("api"),
                    F.when(k % 3 == 0, "flow").when(k % 3 == 1, "object").otherwise("other"), F.lit("reply")).alias("condition")
    ).distinct()
    return topics.parse_conditions(names).drop("runner", "run")


# ------------------------------------------------------------------ claims


def _claims(spark, sf):
    """One claim per turn: the turn and its reply target are the evidence."""
    p = D.conversations(spark, sf)
    n = F.length("text")
    kinds = F.array(*[F.lit(k) for k in (*C.CLAIM_KINDS, "その他")])
    return p.select(
        "conv", "seq", F.coalesce(F.get("topics", F.lit(0)), F.lit("OFF")).alias("topic"), F.col("seq").alias("pos"), "post_id", "topics",
        F.concat(F.lit("C"), F.col("seq").cast("string")).alias("claim_id"), F.col("text").alias("content"),
        F.element_at(kinds, (n % 5 + 1).cast("int")).alias("kind"), F.concat(F.array("post_id"), "reply_to").alias("src"), n.alias("chars"),
    )


_CL = f"""{_P}, cl as materialized (select conv, seq, 'C' || seq as claim_id, coalesce(topics[1], 'OFF') as topic, length(text) as n, post_id, parent,
  case when parent is null then [post_id] else [post_id, parent] end as src, topics from post)"""


@query("analysis_units", f"{_P} select conv, conv || '_' || coalesce(topics[1], 'OFF') as unit, (row_number() over (partition by conv order by min(seq)))::int as unit_no, string_agg(post_id, ',' order by seq) as post_ids from post group by conv, coalesce(topics[1], 'OFF')")
def _(spark, sf):
    return C.analysis_units(D.conversations(spark, sf), True).withColumn("post_ids", F.array_join("post_ids", ","))


@query("validate_claims", f"{_CL}, u as (select a.*, (select string_agg(x, ',') from (select unnest(a.src) as x) where x not in (select post_id from cl b where b.conv = a.conv and b.topic = a.topic)) as bad from cl a) select conv || '_' || topic as unit, claim_id, case when bad is not null then 'evidence not given: ' || bad else 'unknown kind: その他' end as problem from u where bad is not null or n % 5 = 4")
def _(spark, sf):
    units = C.analysis_units(D.conversations(spark, sf), True)
    rows = _claims(spark, sf).withColumn("unit", F.concat_ws("_", F.col("conv").cast("string"), "topic"))
    return C.validate_claims(rows, units)


@query("merge_claims", f"{_CL}, f as (select conv, topic, min(seq) as first from cl group by 1, 2) select conv, claim_id, 'F' || row_number() over (partition by conv order by first, seq) as id from cl join f using (conv, topic)")
def _(spark, sf):
    units = C.analysis_units(D.conversations(spark, sf), True)
    rows = _claims(spark, sf).withColumn("unit", F.concat_ws("_", F.col("conv").cast("string"), "topic"))
    return C.merge_claims(rows, units).select("conv", "claim_id", "id")


@query("validate_evidence", f"{_CL} select conv, (seq//3 + 1)::int as day, claim_id, 'evidence not given' as problem from cl where n % 6 = 0")
def _(spark, sf):
    p = D.conversations(spark, sf)
    day = (F.floor(F.col("seq") / 3) + 1).cast("int")
    rows = _claims(spark, sf).withColumn("day", day)
    bad = F.when(F.col("chars") % 6 == 0, F.array(F.lit("P99"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("src", F.concat("src", bad))
    return C.validate_evidence(rows, p.withColumn("day", day).select("conv", "day", "post_id"), C.post_context(p))


def _judged(spark, sf):
    """Judgements of the claims: a reply target may be extra, the next-but-one post missing."""
    none = F.array().cast("array<string>")
    v = F.array(*[F.lit(x) for x in C.VERDICTS])
    n = F.col("chars")
    extra = F.when((n % 3 == 0) & (F.size("src") > 1), F.slice("src", 2, 1)).otherwise(none)
    missing = F.when((n % 4 == 0) & (F.col("seq") >= 2), F.array(F.concat(F.lit("P"), (F.col("seq") - 2).cast("string")))).otherwise(none)
    return _claims(spark, sf).select(
        "conv", "claim_id", "src", F.element_at(v, (n % 3 + 1).cast("int")).alias("verdict"), F.slice("src", 1, 1).alias("support"),
        extra.alias("extra"), missing.alias("missing"),
    )


_JU = f"""{_CL}, ju as materialized (select *, case when n % 3 = 0 and parent is not null then 1 else 0 end as n_extra, case when n % 4 = 0 and seq >= 2 then 'P' || (seq - 2) end as miss,
  case when parent is not null and n % 3 <> 0 then list_sort(src) else [post_id] end as support from cl)"""


@query("check_judgements", f"{_JU} select conv, claim_id, case when parent is not null and n % 3 <> 0 then parent || ',' || post_id else post_id end as support from ju")
def _(spark, sf):
    j = _judged(spark, sf)
    _, repaired = C.check_judgements(j.select("conv", "claim_id", "src"), j.drop("src"), D.conversations(spark, sf))
    return repaired.select("conv", "claim_id", F.array_join("support", ",").alias("support"))


@query("evidence_scores", f"""{_JU},
tp as (select conv, post_id, topics from post),
ev as (select j.conv, j.claim_id, 's' as w, unnest(src) as e from ju j union all select conv, claim_id, 't', post_id from ju union all select conv, claim_id, 't', miss from ju where miss is not null),
et as (select ev.*, topics from ev join tp on tp.conv = ev.conv and tp.post_id = ev.e),
sz as (select conv, claim_id, w, count(*) as k from et group by 1, 2, 3),
mx as (select conv, claim_id, w, max(c) as m from (select conv, claim_id, w, t, count(*) as c from (select conv, claim_id, w, unnest(topics) as t from et) group by 1, 2, 3, 4) group by 1, 2, 3),
ot as (select conv, claim_id, w, k = coalesce(m, 0) as one from sz left join mx using (conv, claim_id, w)),
cited as (select distinct conv, e from ev where w = 's')
select conv, count(*) as n, count(*) filter (n % 3 = 0) as ok, count(*) filter (n % 3 = 1) as part, count(*) filter (n % 3 = 2) as ng, sum(len(src))::bigint as src, count(*) as sup_in,
  sum(1 + (miss is not null)::int)::bigint as sup_all, count(*) filter (n_extra = 0 and miss is null) as "exact",
  (select count(*) from ot where ot.conv = ju.conv and w = 's' and not one) as cross_src, (select count(*) from ot where ot.conv = ju.conv and w = 't' and not one) as cross_true,
  (select count(*) from post where post.conv = ju.conv) as posts, (select count(*) from post where post.conv = ju.conv and not exists (select 1 from cited where cited.conv = post.conv and e = post_id)) as uncited,
  count(*) filter (n % 9 = 0) as uncovered, round(count(*)/sum(len(src)), 9) as "precision", round(count(*)/sum(1 + (miss is not null)::int), 9) as recall from ju group by conv""")
def _(spark, sf):
    p = D.conversations(spark, sf)
    unc = p.where(F.length("text") % 9 == 0).select("conv", F.col("post_id").alias("post"))
    return _round(C.evidence_scores(_judged(spark, sf), p, unc), "precision", "recall")


@query("human_agreement", f"{_CL} select count(*) filter (n % 2 = 0) as claims, count(*) filter (n % 2 = 0 and n % 3 <> 1) as same_verdict, count(*) filter (n % 2 = 0) as same_evidence from cl")
def _(spark, sf):
    j = _claims(spark, sf)
    n = F.col("chars")
    ids = F.array_join("src", " ")
    back = F.array_join(F.reverse("src"), "  ")
    sheet = j.select(
        F.when(n % 3 == 1, "一部").otherwise("正しい").alias("ai_verdict"), F.when(n % 2 == 0, " 正しい").otherwise(" ").alias("human_verdict"),
        ids.alias("ai_extra"), back.alias("human_extra"), F.lit("").alias("ai_missing"), F.lit(None).cast("string").alias("human_missing"),
    )
    return C.human_agreement(sheet)


def _state(spark, sf):
    """Stored state: a claim per turn, a finding per topic, a question per finding."""
    cl = _claims(spark, sf)
    first = cl.select("conv", F.concat(F.lit("F"), (F.col("seq") + 1).cast("string")).alias("id"), "content", "kind", "src", F.lit(1).alias("day"),
                      F.lit(None).cast("struct<day:int,reason:string>").alias("excluded"), "seq", "topic")
    none = F.array().cast("array<string>")
    found = first.groupBy("conv", "topic").agg(F.min("seq").alias("_s"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("claims"))
    found = found.select(
        "conv", F.concat(F.lit("W"), (F.col("_s") + 1).cast("string")).alias("id"), F.col("topic").alias("content"), F.lit("事実").alias("kind"), F.lit("open").alias("status"),
        none.alias("related_places"), none.alias("aliases"), "claims", F.lit(1).alias("day"), F.lit(None).cast("int").alias("updated"),
        F.lit(None).cast("struct<day:int,reason:string>").alias("expired"),
    )
    asked = found.select("conv", F.concat(F.lit("Q"), F.substring("id", 2, 9)).alias("id"), F.col("id").alias("about"), F.col("content").alias("question"), F.lit("範囲").alias("type"),
                         F.lit(1).alias("day"), F.lit(None).cast("struct<day:int,reason:string>").alias("removed"))
    return {"claims": first.drop("seq", "topic"), "findings": found, "questions": asked}


def _delta(spark, sf):
    """Day two: claims of short-remainder texts are excluded, each conversation adds one finding and one question."""
    cl = _claims(spark, sf)
    fid = F.concat(F.lit("F"), (F.col("seq") + 1).cast("string"))
    none = F.array().cast("array<string>")
    st = _state(spark, sf)
    add = cl.groupBy("conv").agg(F.array_sort(F.collect_set(fid)).alias("claims")).select(
        "conv", F.lit(1).alias("pos"), F.lit("N1").alias("id"), F.lit("all").alias("content"), F.lit("説").alias("kind"), F.lit("open").alias("status"),
        none.alias("related_places"), none.alias("aliases"), "claims",
    )
    f = st["findings"]
    null = F.lit(None).cast("string")
    return {
        "exclude": cl.where(F.col("chars") % 3 == 0).select("conv", fid.alias("id"), F.lit("r").alias("reason")),
        "add": add,
        "update": f.where("content = 'T0'").select("conv", "id", F.lit("T0 renewed").alias("content"), null.alias("kind"), null.alias("status"),
                                                  F.lit(None).cast("array<string>").alias("related_places"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("array<string>").alias("claims")),
        "expire": f.where("content = 'OFF'").select("conv", "id", F.lit("old").alias("reason")),
        "ask": add.select("conv", F.lit(1).alias("pos"), F.lit("N1").alias("about"), F.lit("why").alias("question"), F.lit("理由").alias("type")),
        "reask": st["questions"].where("question = 'T0'").select("conv", "id", F.lit("T0?").alias("question"), F.lit("条件").alias("type")),
        "drop": st["questions"].where("question = 'OFF'").select("conv", "id", F.lit("done").alias("reason")),
    }


_STATE = f"""{_CL}, live as (select conv, 'F' || (seq + 1) as id, seq, topic, src from cl where n % 3 <> 0),
f0 as (select conv, topic, min(seq) + 1 as w from cl group by 1, 2),
nx as (select conv, max(w) + 1 as w from f0 group by 1),
fin as materialized (
  select f0.conv, 'W' || w as id, case when topic = 'T0' then 'T0 renewed' else topic end as content, string_agg(live.id, ',' order by live.seq) as claims, topic = 'OFF' as gone, topic
  from f0 left join live using (conv, topic) group by f0.conv, topic, w
  union all
  select nx.conv, 'W' || nx.w, 'all', string_agg(live.id, ',' order by live.id), false, 'all' from nx left join live using (conv) group by nx.conv, nx.w)"""


@query("apply_changes", _STATE + "select conv, id, content, case when gone then (select string_agg('F' || (seq + 1), ',' order by seq) from cl where cl.conv = fin.conv and cl.topic = 'OFF') else coalesce(claims, '') end as claims, gone or claims is null as expired from fin")
def _(spark, sf):
    out = C.apply_changes(_state(spark, sf), _delta(spark, sf), 2)
    return out["findings"].select("conv", "id", "content", F.array_join("claims", ",").alias("claims"), F.col("expired").isNotNull().alias("expired"))


@query("finalise_findings", _STATE + ", e as (select fin.conv, fin.id, unnest(l.src) as p from fin join live l on l.conv = fin.conv and (l.topic = fin.topic or fin.topic = 'all') where not gone) select fin.conv, fin.id, content, coalesce((select string_agg(p, ',' order by substr(p, 2)::int) from (select distinct p from e where e.conv = fin.conv and e.id = fin.id)), '') as posts from fin where not gone and claims is not null")
def _(spark, sf):
    state = {k: D.cut_lineage(v) for k, v in C.apply_changes(_state(spark, sf), _delta(spark, sf), 2).items()}
    findings, _ = C.finalise(state)
    return findings.select("conv", "id", "content", F.array_join("posts", ",").alias("posts"))


@query("finalise_questions", _STATE + ", q as (select f0.conv, 'Q' || w as id, 'W' || w as about, case when topic = 'T0' then 'T0?' else topic end as question, case when topic = 'T0' then '条件' else '範囲' end as type from f0 where topic <> 'OFF' union all select conv, 'Q' || w, 'W' || w, 'why', '理由' from nx) select q.* from q join fin on fin.conv = q.conv and fin.id = q.about where not gone and claims is not null")
def _(spark, sf):
    state = {k: D.cut_lineage(v) for k, v in C.apply_changes(_state(spark, sf), _delta(spark, sf), 2).items()}
    return C.finalise(state)[1].select("conv", "id", "about", "question", "type")


@query("state_check", _STATE + "select conv, count(*) filter (n % 6 = 0) as bad_evidence, 0::bigint as cites_excluded, 0::bigint as empty_findings from cl group by 1")
def _(spark, sf):
    state = {k: D.cut_lineage(v) for k, v in C.apply_changes(_state(spark, sf), _delta(spark, sf), 2).items()}
    bad = _claims(spark, sf).where(F.col("chars") % 6 == 0).select("conv", "claim_id")
    return C.state_check(state, bad)


@query("validate_findings", f"{_CL}, f as (select conv, topic, min(seq) + 1 as w from cl group by 1, 2) select conv, 'finding' as \"table\", 'W' || w as id, 'kind' as problem from f where topic = 'T1' union all select distinct c.conv, 'finding', 'W' || w, 'claims' from f join cl c using (conv, topic) where c.n % 3 = 0")
def _(spark, sf):
    st = _state(spark, sf)
    known = _claims(spark, sf).where(F.col("chars") % 3 != 0).select("conv", F.concat(F.lit("F"), (F.col("seq") + 1).cast("string")).alias("id"))
    none = F.array().cast("array<string>")
    found = st["findings"].withColumn("kind", F.when(F.col("content") == "T1", "他").otherwise(F.col("kind"))).withColumn("posts", none)
    asked = st["questions"].withColumn("question_src", none)
    return C.validate_findings(found, asked, known, D.conversations(spark, sf))


@query("match_scores", f"{_CL} select conv, sum(case when n % 4 <> 0 then case n % 3 when 0 then 1.0 when 1 then 0.5 else 0.0 end else 0.0 end)::double as want, count(*) filter (n % 4 <> 0) as n_want, count(*) filter (n % 4 = 0 and n % 3 <> 2) as excluded_leaked, count(*) filter (n % 4 = 0) as n_excluded, coalesce(sum(case n % 3 when 0 then 1.0 when 1 then 0.5 else 0.0 end) filter (n % 4 <> 0 and n % 5 <> 0), 0)::double as questions, count(*) filter (n % 4 <> 0 and n % 5 <> 0) as n_questions, count(*) filter (n % 2 = 0) as extra_finding_ok, count(*) filter (n % 2 = 1) as extra_finding_ng, 0::bigint as extra_question_ok, 0::bigint as extra_question_ng from cl group by 1")
def _(spark, sf):
    cl = _claims(spark, sf)
    n = F.col("chars")
    match = F.when(n % 3 == 0, "一致").when(n % 3 == 1, "一部").otherwise("なし").alias("match")
    expected = cl.select("conv", F.col("claim_id").alias("id"), F.when(n % 4 == 0, "exclude").otherwise("want").alias("priority"))
    matches = cl.select("conv", F.col("claim_id").alias("id"), match)
    asked = cl.select("conv", F.col("claim_id").alias("id"), (n % 5 == 0).alias("optional"), match)
    extras = cl.select("conv", F.lit("finding").alias("table"), F.when(n % 2 == 0, "妥当").otherwise("余計").alias("label"))
    return C.match_scores(expected, matches, asked, extras)


@query("safety_scores", f"{_CL} select conv, count(*) filter (n % 7 = 0) as leaked, count(*) as n_must_not, coalesce(sum(case n % 3 when 0 then 1.0 when 1 then 0.5 else 0.0 end) filter (n % 5 <> 0), 0)::double as allowed, count(*) filter (n % 5 <> 0) as n_allowed from cl group by 1")
def _(spark, sf):
    cl = _claims(spark, sf)
    n = F.col("chars")
    match = F.when(n % 3 == 0, "一致").when(n % 3 == 1, "一部").otherwise("なし").alias("match")
    return C.safety_scores(
        cl.select("conv", F.col("claim_id").alias("id"), (n % 7 == 0).alias("leaked")),
        cl.select("conv", F.col("claim_id").alias("id"), (n % 5 == 0).alias("optional"), match),
    )
