"""Readers, sinks, incremental maintenance and streaming, run over the shared tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from stopover.functions import sets as SETS
from stopover.functions import text as T
from stopover.operators import claims as C
from stopover.plans import derived as D
from stopover.plans import sql as S
from stopover.plans.conversation_queries import _chunks, _claims
from stopover.sources import incremental, readers, writers
from stopover.streaming import findings as findings_stream
from stopover.streaming import texts as texts_stream
from stopover.streaming import topics as topics_stream
from stopover.streaming import versions

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def scratch(spark, name: str) -> str:
    """New folder next to the checkpoints, which every executor can reach."""
    D.cut_lineage(spark.range(1))
    root = spark.sparkContext.getCheckpointDir()
    stamp = tempfile.mktemp(prefix=f"{name}-", dir="/").lstrip("/")
    return f"{root}/{stamp}"


@query("geojson_roundtrip", f"with {S.RAIL} select operator, line_name, count(*) as stations, round(avg(lon), 6) as lon from st group by 1, 2")
def _(spark, sf):
    lines = D.rail_features(spark, sf)[0]
    props = {code: F.col(n) for n, code in readers.RAIL_PROPERTIES.items()}
    geometry = F.struct(
        F.lit("LineString").alias("type"), F.transform("line", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")
    )
    path = scratch(spark, "stations")
    writers.write_feature_lines(lines, writers.feature(props, geometry), path)
    back = readers.rail_features(readers.read_feature_lines(spark, path), stations=True)
    return back.groupBy("operator", "line_name").agg(
        F.count(F.lit(1)).alias("stations"), F.round(F.avg(F.element_at("line", 1)["lon"]), 6).alias("lon")
    )


@query("road_features", "select count(*)*2 as roads, count(*) filter (o_orderstatus = 'O')*2 as classed from orders")
def _(spark, sf):
    r = D.roads(spark, sf)
    props = {c: F.col(n) if n in r.columns else F.lit(None).cast("string") for n, c in readers.ROAD_PROPERTIES.items()}
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("line", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    path = scratch(spark, "roads")
    # Each feature ends with a comma, as in a file written one feature per line.
    writers.feature_lines(r, writers.feature(props, geometry)).select(F.concat("value", F.lit(","))).write.text(path)
    back = readers.road_features(readers.read_feature_lines(spark, path))
    return back.agg(F.count(F.lit(1)).alias("roads"), F.count("road_class").alias("classed"))


@query("collapse_places", "select 'Q' || l_partkey as ext_id, count(distinct l_returnflag) as kinds, 'part ' || l_partkey as name from lineitem where l_partkey % 10 <> 9 group by l_partkey")
def _(spark, sf):
    k = F.col("l_partkey")
    b = D.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("http://example.org/entity/Q"), k.cast("string")).alias("item"),
        F.when(k % 10 == 9, F.concat(F.lit("Q"), k.cast("string"))).otherwise(F.concat(F.lit("part "), k.cast("string"))).alias("label"),
        F.lit("a part").alias("description"), F.col("l_returnflag").alias("kind"),
        F.format_string("Point(%.4f %.4f)", D.lon_of(k, D.PART_TILE), D.lat_of(k, D.PART_TILE)).alias("coord"),
    )
    return readers.collapse_places(b).select("ext_id", F.size(F.split("kinds", "、")).cast("long").alias("kinds"), "name")


@query("normalise_items", """
with s as (select distinct l_suppkey as item, l_returnflag || l_linestatus as subject from lineitem)
select item::varchar as item_id, count(distinct lower(subject)) as subjects, count(*) filter (subject like 'A%') as views from s group by 1""")
def _(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("s")).distinct()
    kind = F.when(F.col("s").startswith("A"), "viewpoint").otherwise("target")
    pairs = F.sort_array(F.collect_list(F.array("s", kind)))
    item = li.groupBy("id").agg(pairs.alias("subjects")).select(
        "id", F.col("id").alias("name"), F.lit("point").alias("spatial_type"), F.lit("").alias("note"), "subjects",
        F.array(F.array(F.lit("事実"), F.lit("x"))).alias("findings"),
    )
    topic = item.select(F.concat(F.lit("T"), "id").alias("id"), F.col("id").alias("discovery_id"), F.lit("").alias("about"), "findings")
    q = item.select(F.concat(F.lit("q"), "id").alias("id"), F.lit("text").alias("type"), F.col("name").alias("text"), F.lit(None).cast("string").alias("source"),
                    "note", F.lit(None).cast("string").alias("category"), F.create_map("id", F.lit(3)).alias("judgments"), F.lit('["a","b"]').alias("expect_topic"))
    t = readers.normalise_items(item, topic, q)
    return t["item_subject"].groupBy("item_id").agg(
        F.count(F.lit(1)).alias("subjects"), F.count(F.when(F.col("role") == "観点", 1)).alias("views")
    )


@query("conversation_scan", "select conv_id::varchar as conv, count(*) as posts, count(*) filter (turn > 0) as replies from conversations group by 1")
def _(spark, sf):
    c = D.table(spark, sf, "conversations")
    post = F.struct(
        F.concat(F.lit("P"), F.col("turn").cast("string")).alias("id"), F.lit(None).cast("int").alias("day"), F.col("role").alias("author"),
        F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") % 2 == 0, F.concat(F.lit('["P'), (F.col("turn") - 1).cast("string"), F.lit('"]')))
        .otherwise(F.concat(F.lit("P"), (F.col("turn") - 1).cast("string"))).alias("reply_to"),
        "text", F.lit(None).cast("string").alias("note"), F.lit(False).alias("new_thread"), F.array(F.lit("T")).alias("topics"),
    )
    docs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("p")))), lambda x: x["p"]).alias("posts"))
    raw = docs.select(F.col("conv_id").cast("string").alias("conv"), F.lit(None).cast("map<string,string>").alias("alias"), F.lit(None).cast("string").alias("written_by"), "posts")
    out = readers.visible_posts(readers.flatten_posts(raw))
    return out.groupBy("conv").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.size("reply_to")).cast("long").alias("replies"))


@query("csv_review_sheet", "select c_custkey as spot_id, c_name as name, c_acctbal as score from customer")
def _(spark, sf):
    sheet = writers.add_human_columns(D.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), ["人：判定"])
    path = scratch(spark, "sheet")
    writers.write_csv_tables({"sheet": sheet}, path)
    back = readers.read_csv(spark, f"{path}/sheet", "c_custkey bigint, c_name string, c_acctbal double")
    return back.toDF("spot_id", "name", "score")


@query("variant_chunks", "select variant, turn//10 + 1 as chunk, count(*) as posts, count(*) filter (variant = 'reply' and turn > 0 and (conv_id*31 + turn*17) % 4 <> 0) as replies from conversations, unnest(['reply', 'noreply']) u(variant) group by 1, 2")
def _(spark, sf):
    out = writers.variant_chunks(D.conversations(spark, sf))
    return out.groupBy("variant", F.col("chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("posts"), F.sum(F.size("reply_to")).cast("long").alias("replies"))


@query("upsert", "select c_custkey as id, case when o.n is null then c_name else 'buyer' end as name, coalesce(o.n, 0) as orders from customer full join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey")
def _(spark, sf):
    base = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).cast("long").alias("orders"))
    new = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders")).select("id", F.lit("buyer").alias("name"), "orders")
    return incremental.upsert(base, new, ["id"])


@query("changed_texts", "select doc_id, substr(sha256(text), 1, 16) as content_hash from documents where doc_id not in (select doc_id from labels) or length(text) % 2 = 0")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("source_text"))
    # Labelled documents are stored; those of even length were stored with an older text.
    old = docs.join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", T.content_hash(F.when(F.length("source_text") % 2 == 0, F.lit("older")).otherwise(F.col("source_text"))).alias("content_hash")
    )
    return incremental.changed_texts(docs, old, ["doc_id"]).select("doc_id", "content_hash")


@query("embed_missing", "select count(distinct text) as cached, 384::int as dim from documents")
def _(spark, sf):
    docs = D.table(spark, sf, "documents")
    held = docs.join(D.table(spark, sf, "labels"), "doc_id", "left_semi").select(T.content_hash(F.col("text"), 20).alias("text_key"), T.ngram_vector(F.col("text")).alias("embedding"))
    cache = D.cut_lineage(held.dropDuplicates(["text_key"]))
    out = incremental.embed_missing(docs, cache, "text", T.ngram_vector)
    return out.agg(F.count(F.lit(1)).alias("cached"), F.max(F.size("embedding")).alias("dim"))


@query("fetch_list", "select user_id, min(event_id) as event_id from events where user_id not in (select c_custkey from customer where c_acctbal < 0) group by 1 order by 2, 1 limit 100")
def _(spark, sf):
    have = D.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return incremental.fetch_list(D.table(spark, sf, "events").select("user_id", "event_id"), have, "user_id", "event_id", 100)


@query("reaggregate_runs", """with b as (select vec_id//6 as q, list(vec_id order by vec_id) as ids from embeddings group by 1),
r as (select ids[1:5] as truth, list_concat(ids[1:4], ids[6:6]) as got, vec_id_sum from (select ids, list_sum(ids) as vec_id_sum from b))
select 'all' as size, 'approx' as cond, avg(len(list_intersect(truth, got))::double / len(truth)) as recall, avg((truth[1] = got[1])::int::double) as top1,
  avg((vec_id_sum % 2 = 0)::int::double) as ordered, avg((len(got) < 5)::int::double) as short from r""")
def _(spark, sf):
    # Six neighbouring ids are a query whose five lowest are the truth; the stored approximate run has the sixth for the fifth,
    # and its distances fall at the end where the ids add up to an odd number.
    six = D.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 6).alias("query")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    odd = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x) % 2
    dists = F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2), F.when(odd == 0, F.lit(0.3)).otherwise(F.lit(0.1)))

    def run(cond: str, number: int, ids, d):
        return six.select(F.lit("all").alias("size"), F.lit(cond).alias("cond"), F.lit(number).alias("run"), "query", ids.alias("ids"), d.alias("dists"))

    first = F.slice("ids", 1, 5)
    runs = run("exact", 1, first, dists).unionByName(run("exact", 2, F.reverse(first), dists))  # the second exact run counts for nothing
    return incremental.reaggregate_runs(runs.unionByName(run("approx", 1, F.concat(F.slice("ids", 1, 4), F.slice("ids", 6, 1)), dists)), 5)


@query("text_functions", """select page_id, length(trim(regexp_replace(html, '\\s+', ' ', 'g'))[1:300]) as clipped,
  (page_id % 30)*3600 + 61 as seconds, printf('%02d:01:01', page_id % 30) as clock, printf('%02d:%02d', (page_id*7 % 1440)//60, page_id*7 % 60) as hhmm from pages""")
def _(spark, sf):
    p = D.table(spark, sf, "pages")
    sec = (F.col("page_id") % 30) * 3600 + 61
    return p.select("page_id", F.length(T.clip_text(F.col("html"), 300)).cast("long").alias("clipped"), sec.alias("seconds"), T.seconds_to_gtfs(sec).alias("clock"),
                    T.minutes_to_hhmm(F.col("page_id") * 7).alias("hhmm"))


@query("item_texts", "select s_suppkey, 'S' || s_suppkey || '。対象：N' || s_nationkey || '。観点：v。fact。' as text from supplier")
def _(spark, sf):
    s = D.table(spark, sf, "supplier")
    subject = F.array(
        F.struct(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("name"), F.lit("place").alias("kind")),
        F.struct(F.lit("v").alias("name"), F.lit("viewpoint").alias("kind")),
    )
    found = F.array(F.struct(F.lit("事実").alias("kind"), F.lit("fact").alias("text")))
    rows = s.select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), subject.alias("subjects"), found.alias("findings"))
    topic = F.array().cast("array<struct<about:string,findings:array<struct<kind:string,text:string>>>>")
    return rows.select("s_suppkey", T.item_texts(F.col("name"), F.col("subjects"), F.col("findings"), topic)["topics"].alias("text"))


@query("set_difference", "select id, 'a' as side from (select distinct user_id as id from events) where id not in (select o_custkey from orders) union all select id, 'b' from (select distinct o_custkey as id from orders) where id not in (select user_id from events)")
def _(spark, sf):
    users = D.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return SETS.set_difference(users, D.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@query("json_tokens", "select doc_id, round(length(to_json({'doc_id': doc_id, 'source': source, 'n_chars': n_chars})) * 1.3, 6) as tokens from documents")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.round(T.json_tokens(F.struct("doc_id", "source", "n_chars")), 6).alias("tokens"))


@query("clock_minutes", "select event_id, extract(hour from ts)*60 + extract(minute from ts) as minutes, strftime(ts, '%H:%M') as clock from events")
def _(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", T.minutes_to_hhmm(F.hour("ts") * 60 + F.minute("ts")).alias("clock"))
    return e.select("event_id", T.hhmm_to_minutes(F.col("clock")).cast("long").alias("minutes"), "clock")


# ------------------------------------------------------------------ streaming


def _stream(spark, df, path: str):
    """The rows written once as files and read back as a stream."""
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("stream_merge_chunks", f"""with {S.CONVERSATIONS}, c as (select *, seq//3 + 1 as chunk, length(text) % 11 = 0 as bad from post),
ok as (select conv, chunk, not bool_or(bad) as ok from c group by 1, 2)
select conv, chunk::int as chunk, ok as accepted, post_id, case when ok then coalesce(topics[1], 'OFF') end as assign from c join ok using (conv, chunk)""")
def _(spark, sf):
    root = scratch(spark, "chunks")
    chunks = _stream(spark, D.cut_lineage(_chunks(spark, sf)), f"{root}/in")
    merged = topics_stream.merge_chunk_stream(chunks)
    q = merged.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("conv", "chunk", "accepted", "post_id", "assign")


@query("stream_embed_texts", "select count(*) as texts, count(distinct substr(sha256(text), 1, 16)) as hashes from documents")
def _(spark, sf):
    root = scratch(spark, "texts")
    rows = D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("source_text"), F.lit(1).alias("seq"))
    texts_stream.embed_stream(_stream(spark, rows, f"{root}/in"), f"{root}/table", f"{root}/check", ["doc_id"], "seq").awaitTermination()
    table = versions.read(spark, f"{root}/table", versions.latest(spark, f"{root}/table"))
    return table.agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("content_hash").alias("hashes"))


@query("stream_findings", f"""with {S.CONVERSATIONS} select conv, count(*) as claims, count(*) filter (length(text) % 3 = 0) as excluded, 1::bigint as findings,
  (count(*) filter (length(text) % 3 <> 0) = 0)::int::bigint as expired from post group by 1""")
def _(spark, sf):
    cl = D.cut_lineage(_claims(spark, sf))
    none = F.array().cast("array<string>")

    def records(rows, day: int, change: str, *cols):
        return rows.select("conv", F.lit(day).alias("day"), F.lit(change).alias("change"), F.to_json(F.struct(*cols)).alias("body"))

    kind = F.when(F.col("kind").isin(*C.CLAIM_KINDS), F.col("kind")).otherwise(F.lit("事実")).alias("kind")
    day1 = records(cl, 1, "claim", "pos", "content", kind, "src")
    fid = F.concat(F.lit("F"), (F.col("seq") + 1).cast("string"))
    add = cl.groupBy("conv").agg(F.array_sort(F.collect_set(fid)).alias("claims"))
    day2 = records(add, 2, "add", F.lit(1).alias("pos"), F.lit("N1").alias("id"), F.lit("all").alias("content"), F.lit("説").alias("kind"), F.lit("open").alias("status"),
                   none.alias("related_places"), none.alias("aliases"), "claims")
    day3 = records(cl.where(F.col("chars") % 3 == 0), 3, "exclude", fid.alias("id"), F.lit("r").alias("reason"))
    root = scratch(spark, "findings")
    stream = _stream(spark, day1.unionByName(day2).unionByName(day3), f"{root}/in")
    findings_stream.finding_stream(stream, f"{root}/state", f"{root}/check").awaitTermination()
    v = versions.latest(spark, f"{root}/state/questions")
    claims, found = (versions.read(spark, f"{root}/state/{k}", v) for k in ("claims", "findings"))
    a = claims.groupBy("conv").agg(F.count(F.lit(1)).alias("claims"), F.count("excluded").alias("excluded"))
    b = found.groupBy("conv").agg(F.count(F.lit(1)).alias("findings"), F.count("expired").alias("expired"))
    return a.join(b, "conv")


