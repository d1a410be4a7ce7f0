"""Claims, findings and questions with evidence, checked and kept up to date day by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopover.functions.sets import common_to_all, disjoint, same_set, subset_of
from stopover.functions.stats import prefix_sum, share
from stopover.operators.graph import reply_chains

# Fixed values.
CLAIM_KINDS = ("事実", "体験", "評価", "疑問")
FINDING_KINDS = ("事実", "説", "価値")
QUESTION_TYPES = ("範囲", "確度", "理由", "条件", "現状")
VERDICTS = ("正しい", "一部", "誤り")
MATCH_POINTS = {"一致": 1.0, "一部": 0.5, "なし": 0.0}
GOOD_EXTRA = "妥当"
CHAIN_DEPTH, PREVIOUS = 8, 5
EMPTY_REASON = "根拠の主張がすべて除外された"

_IDS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_IDS)


def analysis_units(posts: DataFrame, by_topic: bool) -> DataFrame:
    """Units one extraction call works on: (conv, unit, unit_no, post_ids).

    Whole conversations, or one unit per primary topic in first-seen order.
    """
    topic = F.coalesce(F.get("topics", F.lit(0)), F.lit("OFF")) if by_topic else F.lit("")
    unit = F.concat(F.col("conv").cast("string"), F.when(topic != "", F.concat(F.lit("_"), topic)).otherwise(""))
    rows = posts.select("conv", unit.alias("unit"), "seq", "post_id")
    per = rows.groupBy("conv", "unit").agg(
        F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "post_id"))), lambda x: x["post_id"]).alias("post_ids")
    )
    w = Window.partitionBy("conv").orderBy("first")
    return per.select("conv", "unit", F.row_number().over(w).alias("unit_no"), "post_ids")


def post_context(posts: DataFrame, depth: int = CHAIN_DEPTH, previous: int = PREVIOUS) -> DataFrame:
    """Context of each post: its reply chain and the posts just before it, in arrival order.

    ``seq`` numbers a conversation's posts without gaps, so the five posts before a post are
    found by an equi-join on their positions and no conversation is sorted in one task.
    """
    chain = reply_chains(posts, depth).select("conv", "post_id", F.explode("chain").alias("ctx_id"))
    where = posts.select("conv", F.col("post_id").alias("ctx_id"), F.col("seq").alias("ctx_seq"))
    before = posts.select(
        "conv", "post_id", F.explode(F.sequence(F.col("seq") - previous, F.col("seq") - 1)).alias("ctx_seq")
    ).join(where, ["conv", "ctx_seq"]).select("conv", "post_id", "ctx_id")
    both = chain.unionByName(before).distinct().join(where, ["conv", "ctx_id"])
    packed = both.groupBy("conv", "post_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ctx_seq", "ctx_id"))), lambda x: x["ctx_id"]).alias("context")
    )
    return posts.select("conv", "post_id").join(packed, ["conv", "post_id"], "left").select(
        "conv", "post_id", F.coalesce("context", _empty()).alias("context")
    )


# ------------------------------------------------------------------ claims


def validate_claims(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Violations of extracted claims: missing field, unknown kind, evidence outside the unit.

    ``claims``: conv, unit, claim_id, content, kind, src.
    """
    rows = claims.join(units.select("unit", "post_ids"), "unit", "left")
    missing = F.col("content").isNull() | F.col("kind").isNull() | F.col("src").isNull()
    outside = F.array_except("src", F.coalesce("post_ids", _empty()))
    problem = (
        F.when(missing, "missing field")
        .when(F.size(outside) > 0, F.concat(F.lit("evidence not given: "), F.array_join(outside, ",")))
        .when(~F.col("kind").isin(*CLAIM_KINDS), F.concat(F.lit("unknown kind: "), F.col("kind")))
    )
    return rows.select("unit", "claim_id", problem.alias("problem")).where("problem is not null")


def validate_evidence(claims: DataFrame, day_posts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Violations of a day's claims: evidence must lie in the day's posts or their contexts and touch the day's posts.

    ``claims``: conv, day, claim_id, src; ``day_posts``: conv, day, post_id; ``contexts``: conv, post_id, context.
    Evidence ids are looked up by join, so a busy day is never gathered in one row.
    """
    ev = claims.select("conv", "day", "claim_id", F.explode(F.array_distinct("src")).alias("post_id"))
    target = day_posts.select("conv", "day", "post_id").withColumn("_t", F.lit(True))
    given = (
        day_posts.join(contexts, ["conv", "post_id"])
        .select("conv", "day", F.explode("context").alias("post_id"))
        .distinct()
        .withColumn("_c", F.lit(True))
    )
    seen = ev.join(target, ["conv", "day", "post_id"], "left").join(given, ["conv", "day", "post_id"], "left")
    per = seen.groupBy("conv", "day", "claim_id").agg(
        F.count(F.when(F.col("_t").isNull() & F.col("_c").isNull(), 1)).alias("outside"), F.count("_t").alias("targets")
    )
    empty = claims.where(F.size("src") == 0).select("conv", "day", "claim_id", F.lit(0).cast("long").alias("outside"), F.lit(0).cast("long").alias("targets"))
    problem = F.when(F.col("outside") > 0, "evidence not given").when(F.col("targets") == 0, "no post of the day")
    return per.unionByName(empty).select("conv", "day", "claim_id", problem.alias("problem")).where("problem is not null")


def merge_claims(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Unit claims joined in unit order and renumbered F1.. per conversation.

    ``claims`` carry ``pos``, their place in the unit. Numbers are running counts.
    """
    rows = claims.drop("conv").join(units.select("unit", "conv", "unit_no"), "unit").withColumn("_one", F.lit(1))
    run = prefix_sum(rows, ["conv", "unit_no", "pos"], "_one", "_n")
    base = run.groupBy("conv").agg((F.min("_n") - 1).alias("_base"))
    return run.join(base, "conv").withColumn("id", F.concat(F.lit("F"), (F.col("_n") - F.col("_base")).cast("string"))).drop("_one", "_n", "_base", "unit_no")


def append_claims(stored: DataFrame, new: DataFrame, day: int) -> DataFrame:
    """Stored claims plus a day's new ones, numbering continued, stamped with the day, none excluded.

    ``stored``: conv, id, content, kind, src, day, excluded; ``new``: conv, pos, content, kind, src.
    """
    last = stored.groupBy("conv").agg(F.max(F.substring("id", 2, 12).cast("long")).alias("_nf"))
    run = prefix_sum(new.withColumn("_one", F.lit(1)), ["conv", "pos"], "_one", "_n")
    base = run.groupBy("conv").agg((F.min("_n") - 1).alias("_base"))
    rows = run.join(base, "conv").join(last, "conv", "left")
    number = F.coalesce("_nf", F.lit(0)) + F.col("_n") - F.col("_base")
    add = rows.select(
        "conv", F.concat(F.lit("F"), number.cast("string")).alias("id"), "content", "kind", "src", F.lit(day).alias("day"),
        F.lit(None).cast("struct<day:int,reason:string>").alias("excluded"),
    )
    return stored.unionByName(add)


def number_of(post_id: Column) -> Column:
    return F.substring(post_id, 2, 12).cast("long")


def by_number(ids: Column) -> Column:
    """Ids like P12 sorted by their number."""
    return F.transform(F.array_sort(F.transform(ids, lambda i: F.struct(number_of(i).alias("n"), i.alias("i")))), lambda s: s["i"])


def check_judgements(claims: DataFrame, judged: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(violations, repaired judgements).

    ``claims``: conv, claim_id, src; ``judged``: conv, claim_id, verdict, support, extra, missing.
    When support and extra do not cover the evidence, support becomes the evidence less extra.
    """
    both = claims.withColumn("_c", F.lit(True)).join(judged.withColumn("_j", F.lit(True)), ["conv", "claim_id"], "full")
    cited = F.array_union("support", "extra")
    gone = (
        judged.select("conv", "claim_id", F.explode("missing").alias("post_id"))
        .join(posts.select("conv", "post_id"), ["conv", "post_id"], "left_anti")
        .select("conv", "claim_id").distinct().withColumn("_unknown", F.lit(True))
    )
    both = both.join(gone, ["conv", "claim_id"], "left")
    problem = (
        F.when(F.col("_j").isNull(), "not judged").when(F.col("_c").isNull(), "unknown claim")
        .when(~F.col("verdict").isin(*VERDICTS), "unknown verdict")
        .when(~subset_of(cited, F.col("src")), "cites other evidence")
        .when(~disjoint(F.col("missing"), F.col("src")), "missing is evidence")
        .when(F.col("_unknown"), "missing is unknown")
    )
    rows = both.withColumn("problem", problem)
    support = F.when(same_set(cited, F.col("src")), F.col("support")).otherwise(by_number(F.array_except("src", "extra")))
    repaired = rows.where("problem is null").select("conv", "claim_id", "verdict", support.alias("support"), "extra", "missing", "src")
    return rows.where("problem is not null").select("conv", "claim_id", "problem"), repaired


def one_topic(posts: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the gold topic sets of the evidence share a topic; no evidence counts as yes.

    ``evidence``: conv, keys.., ids. A topic held by all of a row's posts is one that occurs as
    often as there are posts.
    """
    ids = evidence.select("conv", *keys, F.explode("ids").alias("post_id"))
    size = ids.groupBy("conv", *keys).agg(F.count(F.lit(1)).alias("_n"))
    held = ids.join(posts.select("conv", "post_id", F.explode(F.array_distinct("topics")).alias("t")), ["conv", "post_id"])
    most = held.groupBy("conv", *keys, "t").agg(F.count(F.lit(1)).alias("_k")).groupBy("conv", *keys).agg(F.max("_k").alias("_k"))
    return (
        evidence.select("conv", *keys).join(size, ["conv", *keys], "left").join(most, ["conv", *keys], "left")
        .select("conv", *keys, (F.coalesce("_n", F.lit(0)) == F.coalesce("_k", F.lit(0))).alias("one_topic"))
    )


def same_topic_arrays(sets: Column) -> Column:
    """Column form of :func:`one_topic` for rows that already hold their topic sets."""
    return F.coalesce(F.size(common_to_all(sets)) > 0, F.lit(True))


def evidence_scores(judged: DataFrame, posts: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Per conversation: verdicts, evidence precision and recall, exact, uncovered, uncited, cross-topic.

    ``judged``: conv, claim_id, verdict, src, support, extra, missing; ``uncovered``: conv, post.
    """
    src = one_topic(posts, judged.select("conv", "claim_id", F.col("src").alias("ids")), ["claim_id"]).withColumnRenamed("one_topic", "_src1")
    true = one_topic(posts, judged.select("conv", "claim_id", F.concat("support", "missing").alias("ids")), ["claim_id"]).withColumnRenamed("one_topic", "_true1")
    rows = judged.join(src, ["conv", "claim_id"]).join(true, ["conv", "claim_id"])

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    per = rows.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"),
        n(F.col("verdict") == VERDICTS[0]).alias("ok"), n(F.col("verdict") == VERDICTS[1]).alias("part"), n(F.col("verdict") == VERDICTS[2]).alias("ng"),
        F.sum(F.size("src")).alias("src"), F.sum(F.size("support")).alias("sup_in"),
        F.sum(F.size("support") + F.size("missing")).alias("sup_all"),
        n((F.size("extra") == 0) & (F.size("missing") == 0)).alias("exact"),
        n(~F.col("_src1")).alias("cross_src"), n(~F.col("_true1")).alias("cross_true"),
    )
    cited = judged.select("conv", F.explode("src").alias("post_id")).distinct().withColumn("_c", F.lit(True))
    totals = posts.select("conv", "post_id").join(cited, ["conv", "post_id"], "left").groupBy("conv").agg(
        F.count(F.lit(1)).alias("posts"), n(F.col("_c").isNull()).alias("uncited")
    )
    unc = uncovered.groupBy("conv").agg(F.count(F.lit(1)).alias("uncovered"))
    return (
        per.join(totals, "conv").join(unc, "conv", "left").fillna(0, ["uncovered"])
        .withColumn("precision", share(F.col("sup_in"), F.col("src")))
        .withColumn("recall", share(F.col("sup_in"), F.col("sup_all")))
    )


def human_agreement(sheet: DataFrame) -> DataFrame:
    """One row: filled-in claims, equal verdicts, equal extra and missing sets.

    ``sheet``: ai_verdict, human_verdict, and space-separated ai/human extra and missing ids.
    """
    def ids(c: str) -> Column:
        return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")

    filled = sheet.where(F.trim(F.coalesce("human_verdict", F.lit(""))) != "")
    same_ids = same_set(ids("ai_extra"), ids("human_extra")) & same_set(ids("ai_missing"), ids("human_missing"))
    return filled.agg(
        F.count(F.lit(1)).alias("claims"),
        F.count(F.when(F.trim("human_verdict") == F.col("ai_verdict"), 1)).alias("same_verdict"),
        F.count(F.when(same_ids, 1)).alias("same_evidence"),
    )


# ------------------------------------------------------------------ findings and questions


def _unknown(df: DataFrame, ids: str, known: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Rows of ``df`` with an id that ``known`` (conv, key) lacks."""
    return (
        df.select("conv", *keys, F.explode(ids).alias(key)).join(known.select("conv", key), ["conv", key], "left_anti").select("conv", *keys).distinct()
    )


def validate_findings(findings: DataFrame, questions: DataFrame, claims: DataFrame, posts: DataFrame) -> DataFrame:
    """Violations of kind, type and references: (conv, table, id, problem)."""
    def rows(df: DataFrame, table: str, problem: str) -> DataFrame:
        return df.select("conv", F.lit(table).alias("table"), "id", F.lit(problem).alias("problem"))

    known_claims = claims.select("conv", F.col("id").alias("ref"))
    known_posts = posts.select("conv", F.col("post_id").alias("ref"))
    about = questions.join(findings.select("conv", F.col("id").alias("about")), ["conv", "about"], "left_anti")
    return (
        rows(findings.where(~F.col("kind").isin(*FINDING_KINDS)), "finding", "kind")
        .unionByName(rows(_unknown(findings, "claims", known_claims, "ref", ["id"]), "finding", "claims"))
        .unionByName(rows(_unknown(findings, "posts", known_posts, "ref", ["id"]), "finding", "posts"))
        .unionByName(rows(questions.where(~F.col("type").isin(*QUESTION_TYPES)), "question", "type"))
        .unionByName(rows(about, "question", "about"))
        .unionByName(rows(_unknown(questions, "question_src", known_posts, "ref", ["id"]), "question", "question_src"))
    )


def points(match: Column) -> Column:
    return F.when(match == "一致", 1.0).when(match == "一部", 0.5).otherwise(0.0)


def match_scores(expected: DataFrame, matches: DataFrame, questions: DataFrame, extras: DataFrame) -> DataFrame:
    """Per conversation: wanted findings found, questions found, excluded ones leaked, extras.

    ``expected``: conv, id, priority; ``matches``: conv, id, match; ``questions``: conv, id,
    optional, match; ``extras``: conv, table (finding|question), label.
    """
    rows = expected.join(matches, ["conv", "id"])
    want, exclude = F.col("priority") == "want", F.col("priority") == "exclude"
    a = rows.groupBy("conv").agg(
        F.sum(F.when(want, points(F.col("match"))).otherwise(0.0)).alias("want"), F.count(F.when(want, 1)).alias("n_want"),
        F.count(F.when(exclude & (F.col("match") != "なし"), 1)).alias("excluded_leaked"), F.count(F.when(exclude, 1)).alias("n_excluded"),
    )
    asked = questions.where(~F.coalesce("optional", F.lit(False))).join(expected.where(want).select("conv", "id"), ["conv", "id"])
    b = asked.groupBy("conv").agg(F.sum(points(F.col("match"))).alias("questions"), F.count(F.lit(1)).alias("n_questions"))
    good = F.col("label") == GOOD_EXTRA
    c = extras.groupBy("conv").agg(
        *[F.count(F.when((F.col("table") == t) & (good if ok else ~good), 1)).alias(f"extra_{t}_{'ok' if ok else 'ng'}") for t in ("finding", "question") for ok in (True, False)]
    )
    return a.join(b, "conv", "left").join(c, "conv", "left").na.fill(0)


def safety_scores(must_not: DataFrame, allowed: DataFrame) -> DataFrame:
    """Leaks among what must not appear, and points of what may, optional items left out.

    ``must_not``: conv, id, leaked; ``allowed``: conv, id, optional, match.
    """
    a = must_not.groupBy("conv").agg(F.count(F.when(F.col("leaked"), 1)).alias("leaked"), F.count(F.lit(1)).alias("n_must_not"))
    ok = allowed.where(~F.coalesce("optional", F.lit(False)))
    b = ok.groupBy("conv").agg(F.sum(points(F.col("match"))).alias("allowed"), F.count(F.lit(1)).alias("n_allowed"))
    return a.join(b, "conv", "full").na.fill(0)


# ------------------------------------------------------------------ daily changes

_MARK = "struct<day:int,reason:string>"
# What a question may carry besides its text: whether the conversation itself asks it, and the posts it comes from.
QUESTION_EXTRAS = {"in_conversation": "boolean", "question_src": "array<string>"}
FINDING_FIELDS = ("content", "kind", "status", "related_places", "aliases", "claims")


def _mark(day: Column | int, reason: Column) -> Column:
    d = F.lit(day) if isinstance(day, int) else day
    return F.struct(d.cast("int").alias("day"), reason.alias("reason")).cast(_MARK)


def _next_ids(stored: DataFrame, added: DataFrame, prefix: str) -> DataFrame:
    """Added rows (conv, pos, temp id) with new ids that continue the stored numbering."""
    last = stored.groupBy("conv").agg(F.max(number_of(F.col("id"))).alias("_last"))
    run = prefix_sum(added.withColumn("_one", F.lit(1)), ["conv", "pos"], "_one", "_n")
    base = run.groupBy("conv").agg((F.min("_n") - 1).alias("_base"))
    rows = run.join(base, "conv").join(last, "conv", "left")
    number = F.coalesce("_last", F.lit(0)) + F.col("_n") - F.col("_base")
    return rows.withColumn("new_id", F.concat(F.lit(prefix), number.cast("string"))).drop("_one", "_n", "_base", "_last")


def _only_live(rows: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """``claims`` of each row cut down to live claims, order kept."""
    ref = rows.select("conv", key, F.posexplode("claims").alias("_i", "claim")).join(
        live.select("conv", F.col("id").alias("claim")), ["conv", "claim"]
    )
    kept = ref.groupBy("conv", key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "claim"))), lambda x: x["claim"]).alias("_kept"))
    return rows.join(kept, ["conv", key], "left").withColumn("claims", F.coalesce("_kept", _empty())).drop("_kept")


def apply_changes(state: dict[str, DataFrame], delta: dict[str, DataFrame], day: int) -> dict[str, DataFrame]:
    """State after one day's delta, for all conversations at once.

    State: ``claims`` (conv, id, content, kind, src, day, excluded), ``findings`` (conv, id,
    content, kind, status, related_places, aliases, claims, day, updated, expired),
    ``questions`` (conv, id, about, question, type, day, removed). Delta: ``exclude`` (conv,
    id, reason), ``add`` (conv, pos, id, finding fields), ``update`` (conv, id, finding
    fields, NULL keeps), ``expire`` (conv, id, reason), ``ask`` (conv, pos, about, question,
    type), ``reask`` (conv, id, question, type), ``drop`` (conv, id, reason). Questions keep ``in_conversation`` and
    ``question_src`` where ``ask`` or the state has them.

    Claims are excluded first; findings are added, updated and expired; questions follow;
    last, excluded claims leave every live finding, and a finding without claims expires.
    """
    def joined(rows: DataFrame, change: DataFrame, cols: list[str]) -> DataFrame:
        c = change.select("conv", "id", F.lit(True).alias("_hit"), *[F.col(x).alias(f"_{x}") for x in cols])
        return rows.join(c, ["conv", "id"], "left")

    hit = F.coalesce("_hit", F.lit(False))
    claims = joined(state["claims"], delta["exclude"], ["reason"]).withColumn(
        "excluded", F.when(hit, _mark(day, F.col("_reason"))).otherwise(F.col("excluded"))
    ).drop("_hit", "_reason")
    live = claims.where("excluded is null")

    findings = joined(state["findings"], delta["update"], list(FINDING_FIELDS))
    for f in FINDING_FIELDS:
        findings = findings.withColumn(f, F.coalesce(f"_{f}", f))
    findings = findings.withColumn("updated", F.when(hit, F.lit(day)).otherwise(F.col("updated"))).drop("_hit", *[f"_{f}" for f in FINDING_FIELDS])
    numbered = _next_ids(state["findings"], delta["add"], "W")
    added = numbered.select(
        "conv", F.col("new_id").alias("id"), *FINDING_FIELDS, F.lit(day).alias("day"),
        F.lit(None).cast("int").alias("updated"), F.lit(None).cast(_MARK).alias("expired"),
    )
    findings = joined(findings, delta["expire"], ["reason"]).withColumn(
        "expired", F.when(hit, _mark(day, F.col("_reason"))).otherwise(F.col("expired"))
    ).drop("_hit", "_reason")
    findings = findings.unionByName(added)

    names = numbered.select("conv", F.col("id").alias("about"), "new_id")
    asked = _next_ids(state["questions"], delta["ask"], "Q").withColumnRenamed("new_id", "qid")
    extras = [c for c in QUESTION_EXTRAS if c in asked.columns or c in state["questions"].columns]
    asked = _with_extras(asked.join(names, ["conv", "about"], "left"), extras).select(
        "conv", F.col("qid").alias("id"), F.coalesce("new_id", "about").alias("about"), "question", "type",
        F.lit(day).alias("day"), F.lit(None).cast(_MARK).alias("removed"), *extras,
    )
    questions = joined(_with_extras(state["questions"], extras), delta["reask"], ["question", "type"]).withColumn(
        "question", F.coalesce("_question", "question")
    ).withColumn("type", F.coalesce("_type", "type")).drop("_hit", "_question", "_type")
    questions = joined(questions, delta["drop"], ["reason"]).withColumn(
        "removed", F.when(hit, _mark(day, F.col("_reason"))).otherwise(F.col("removed"))
    ).drop("_hit", "_reason").unionByName(asked)

    alive = _only_live(findings.where("expired is null"), live)
    alive = alive.withColumn("expired", F.when(F.size("claims") == 0, _mark(day, F.lit(EMPTY_REASON))))
    return {"claims": claims, "findings": findings.where("expired is not null").unionByName(alive), "questions": questions}


def invalid_changes(state: dict[str, DataFrame], delta: dict[str, DataFrame]) -> DataFrame:
    """Changes that name unknown rows or unknown kinds and types: (conv, change, id, problem)."""
    def missing(name: str, table: str) -> DataFrame:
        return delta[name].join(state[table].select("conv", "id"), ["conv", "id"], "left_anti").select(
            "conv", F.lit(name).alias("change"), "id", F.lit("unknown id").alias("problem")
        )

    known = state["findings"].select("conv", F.col("id").alias("about")).unionByName(delta["add"].select("conv", F.col("id").alias("about")))
    out = missing("exclude", "claims").unionByName(missing("update", "findings")).unionByName(missing("expire", "findings"))
    out = out.unionByName(missing("reask", "questions")).unionByName(missing("drop", "questions"))
    kinds = delta["add"].where(~F.col("kind").isin(*FINDING_KINDS)).select("conv", F.lit("add").alias("change"), "id", F.lit("kind").alias("problem"))
    about = delta["ask"].join(known, ["conv", "about"], "left_anti").select("conv", F.lit("ask").alias("change"), F.col("about").alias("id"), F.lit("about").alias("problem"))
    types = delta["ask"].where(~F.col("type").isin(*QUESTION_TYPES)).select("conv", F.lit("ask").alias("change"), F.col("about").alias("id"), F.lit("type").alias("problem"))
    return out.unionByName(kinds).unionByName(about).unionByName(types)


def _with_extras(questions: DataFrame, names) -> DataFrame:
    """The question columns ``names``, NULL where ``questions`` lacks them."""
    lacking = {c: F.lit(None).cast(QUESTION_EXTRAS[c]) for c in names if c not in questions.columns}
    return questions.withColumns(lacking) if lacking else questions


def finalise(state: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Live findings with the posts behind their claims, and the questions about them, with their QUESTION_EXTRAS."""
    live = state["findings"].where("expired is null")
    src = state["claims"].select("conv", F.col("id").alias("claim"), "src")
    posts = (
        live.select("conv", "id", F.explode("claims").alias("claim")).join(src, ["conv", "claim"])
        .select("conv", "id", F.explode("src").alias("post_id")).groupBy("conv", "id").agg(by_number(F.collect_set("post_id")).alias("posts"))
    )
    findings = live.join(posts, ["conv", "id"], "left").select("conv", "id", *FINDING_FIELDS, F.coalesce("posts", _empty()).alias("posts"))
    questions = _with_extras(state["questions"], QUESTION_EXTRAS).where("removed is null").join(live.select("conv", F.col("id").alias("about")), ["conv", "about"], "left_semi")
    return findings, questions


def state_check(state: dict[str, DataFrame], evidence_problems: DataFrame) -> DataFrame:
    """Per conversation: claims with bad evidence, live findings that cite excluded claims, live findings without claims."""
    live = state["findings"].where("expired is null")
    gone = state["claims"].where("excluded is not null").select("conv", F.col("id").alias("claim"))
    cites = live.select("conv", "id", F.explode("claims").alias("claim")).join(gone, ["conv", "claim"], "left_semi").select("conv", "id").distinct()
    convs = state["claims"].select("conv").distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("conv").agg(F.count(F.lit(1)).alias(name))

    out = convs.join(count(evidence_problems, "bad_evidence"), "conv", "left").join(count(cites, "cites_excluded"), "conv", "left")
    return out.join(count(live.where(F.size("claims") == 0), "empty_findings"), "conv", "left").na.fill(0)
