"""Readers for the input files: GeoJSON, query-result JSON, item and conversation documents, CSV, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopover.functions.geo import LINE
from stopover.functions.text import normalize_name

_GEOMETRY = "struct<type:string,coordinates:array<array<double>>>"
_COLLECTION = f"type string, features array<struct<type:string,properties:map<string,string>,geometry:{_GEOMETRY}>>"
_FEATURE = f"type string, properties map<string,string>, geometry {_GEOMETRY}"

# Property codes of the railway data set.
RAIL_PROPERTIES = {
    "rail_class": "N02_001",
    "operator_type": "N02_002",
    "line_name": "N02_003",
    "operator": "N02_004",
    "station_name": "N02_005",
    "station_code": "N02_005c",
    "group_code": "N02_005g",
}
# Property codes of the road data set.
ROAD_PROPERTIES = {
    "kind": "N13_002",
    "road_class": "N13_003",
    "state": "N13_004",
    "layer": "N13_005",
    "width": "N13_006",
    "toll": "N13_007",
}


def to_line(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).cast(LINE)


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of whole-file GeoJSON documents, one row each, properties as a map."""
    raw = spark.read.schema(_COLLECTION).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select("f.*")


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON file written one feature per line; the text is splittable."""
    lines = spark.read.text(path).select(F.rtrim(F.trim("value"), F.lit(",")).alias("value"))
    parsed = lines.where(F.col("value").startswith("{")).select(F.from_json("value", _FEATURE).alias("f"))
    return parsed.where(F.col("f.type") == "Feature").select("f.*")


def rail_features(features: DataFrame, stations: bool, strict: bool = True) -> DataFrame:
    """Typed station or section rows; a geometry that is not a LineString is an error unless ``strict`` is off."""
    names = RAIL_PROPERTIES if stations else dict(list(RAIL_PROPERTIES.items())[:4])
    is_line = F.col("geometry.type") == "LineString"
    line = to_line(F.col("geometry.coordinates"))
    if strict:
        line = F.when(is_line, line).otherwise(
            F.raise_error(F.concat(F.lit("unexpected geometry: "), F.col("geometry.type"))).cast(LINE)
        )
    else:
        features = features.where(is_line)
    return features.select(*[F.col("properties")[code].alias(n) for n, code in names.items()], line.alias("line"))


def road_features(features: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """Typed road rows; only LineStrings are kept."""
    codes = codes or ROAD_PROPERTIES
    cols = [F.col("properties")[code].alias(n) for n, code in codes.items()]
    out = features.where(F.col("geometry.type") == "LineString").select(
        *cols, to_line(F.col("geometry.coordinates")).alias("line")
    )
    return out.withColumn("layer", F.col("layer").cast("int"))


_BINDING = "map<string,struct<type:string,value:string>>"


def read_query_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a query-result JSON document, in file order."""
    schema = f"results struct<bindings:array<{_BINDING}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("results.bindings").alias("seq", "r"))
    return rows.select(
        "seq",
        *[
            F.col("r")[k]["value"].alias(a)
            for k, a in {
                "item": "item", "itemLabel": "label", "itemDescription": "description",
                "typeLabel": "kind", "coord": "coord",
            }.items()
        ],
    )


def collapse_places(bindings: DataFrame) -> DataFrame:
    """One place per item id: first name and position, kinds in first-seen order, and its document text.

    Rows without a parsable ``Point(lon lat)`` or whose label is only the id are dropped first.
    """
    pattern = r"Point\(([-0-9.eE]+) ([-0-9.eE]+)\)"
    rows = (
        bindings.withColumn("ext_id", F.element_at(F.split("item", "/"), -1))
        .withColumn("lon", F.expr(f"try_cast(regexp_extract(coord, r'^{pattern}', 1) as double)"))
        .withColumn("lat", F.expr(f"try_cast(regexp_extract(coord, r'^{pattern}', 2) as double)"))
        .withColumn("name", F.coalesce("label", "ext_id"))
        .where(F.col("lon").isNotNull() & (F.col("name") != F.col("ext_id")))
    )
    first = rows.groupBy("ext_id").agg(
        F.min_by(F.struct("name", "description", "lon", "lat"), "seq").alias("f"),
    )
    kinds = (
        rows.where(F.coalesce(F.col("kind"), F.lit("")) != "")
        .groupBy("ext_id", "kind")
        .agg(F.min("seq").alias("seq"))
        .groupBy("ext_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda k: k["kind"]), "、").alias("kinds"))
    )
    out = first.join(kinds, "ext_id", "left").select(
        F.lit("wikidata").alias("source"), "ext_id", "f.name", "f.description",
        F.coalesce("kinds", F.lit("")).alias("kinds"), "f.lon", "f.lat",
    )
    return out.withColumn("doc", document_text("name", "description", "kinds"))


def document_text(*parts: str) -> Column:
    """Non-empty parts joined by a full stop."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "。")


_ITEM_DOC = (
    "discoveries array<struct<id:string,name:string,spatial_type:string,note:string,"
    "subjects:array<array<string>>,findings:array<array<string>>>>,"
    "topics array<struct<id:string,discovery_id:string,place:string,target:string,viewpoint:string,about:string,"
    "findings:array<array<string>>>>,"
    "queries array<struct<id:string,type:string,text:string,source:string,note:string,category:string,"
    "judgments:map<string,int>,expect_topic:string>>"
)


def read_item_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Normalised tables of the nested item document.

    Keys: item, subject, item_subject, finding, topic, topic_finding, query, judgment, expected_topic.
    """
    raw = spark.read.schema(_ITEM_DOC).option("multiLine", True).json(path)
    item = raw.select(F.explode("discoveries").alias("d")).select("d.*")
    topic = raw.select(F.explode("topics").alias("t")).select("t.*")
    query = raw.select(F.explode("queries").alias("q")).select("q.*")
    return normalise_items(item, topic, query)


def normalise_items(item: DataFrame, topic: DataFrame, query: DataFrame) -> dict[str, DataFrame]:
    pairs = item.select(F.col("id").alias("item_id"), F.posexplode("subjects").alias("seq", "s")).select(
        "item_id", "seq", F.col("s")[0].alias("name"), F.col("s")[1].alias("kind")
    )
    pairs = pairs.withColumn("normalized_name", normalize_name(F.col("name")))
    # Names that normalise alike are one subject; the last spelling stays, the first kind stays.
    order = F.struct("item_id", "seq")
    subject = pairs.groupBy("normalized_name").agg(
        F.max_by("name", order).alias("name"), F.min_by("kind", order).alias("kind")
    )
    link = pairs.select(
        "item_id", "normalized_name", F.when(F.col("kind") == "viewpoint", "観点").otherwise("対象").alias("role")
    ).dropDuplicates(["item_id", "normalized_name"])

    def findings(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("id").alias(key), F.posexplode("findings").alias("seq", "f")).select(
            key, "seq", F.col("f")[0].alias("kind"), F.col("f")[1].alias("text")
        )

    # A JSON array read as a string keeps its brackets; both forms become an array of ids.
    expected = F.when(
        F.col("expect_topic").startswith("["), F.from_json("expect_topic", "array<string>")
    ).otherwise(F.array("expect_topic"))
    return {
        "item": item.select("id", "name", "spatial_type", "note"),
        "subject": subject,
        "item_subject": link,
        "finding": findings(item, "item_id"),
        "topic": topic.drop("findings"),
        "topic_finding": findings(topic, "topic_id"),
        "query": query.select("id", "type", "text", "source", "note", F.coalesce("category", F.lit("その他")).alias("category")),
        "judgment": query.select(F.col("id").alias("qid"), F.explode("judgments").alias("item_id", "grade")),
        "expected_topic": query.where(F.col("expect_topic").isNotNull()).select(
            F.col("id").alias("qid"), F.explode(expected).alias("topic_id")
        ),
    }


_POST = (
    "struct<id:string,day:int,author:string,reply_to:string,text:string,note:string,"
    "new_thread:boolean,topics:array<string>>"
)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Posts of conversation documents with arrival order, reply links as arrays and default day 1.

    ``reply_to`` may be null, one id or a list; reading it as a string keeps a list as JSON text.
    """
    schema = f"alias map<string,string>, written_by string, posts array<{_POST}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    raw = raw.withColumn("conv", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return flatten_posts(raw)


def flatten_posts(raw: DataFrame) -> DataFrame:
    """One row per post that stays in its conversation, numbered without gaps: posts of a new thread go first."""
    own = F.filter("posts", lambda p: ~F.coalesce(p["new_thread"], F.lit(False)))
    posts = raw.select("conv", "alias", "written_by", F.posexplode(own).alias("seq", "p"))
    reply = (
        F.when(F.col("p.reply_to").isNull() | (F.col("p.reply_to") == ""), F.array().cast("array<string>"))
        .when(F.col("p.reply_to").startswith("["), F.from_json("p.reply_to", "array<string>"))
        .otherwise(F.array("p.reply_to"))
    )
    return posts.select(
        "conv", "seq", F.col("p.id").alias("post_id"), F.coalesce("p.day", F.lit(1)).alias("day"),
        "p.author", reply.alias("reply_to"), "p.text",
        F.coalesce("p.topics", F.array().cast("array<string>")).alias("topics"), "alias", "written_by",
    )


def visible_posts(posts: DataFrame) -> DataFrame:
    """Posts without the gold columns, as an annotator may see them."""
    return posts.select("conv", "seq", "post_id", "day", "author", "reply_to", "text")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte-order mark before the first column name is dropped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    clean = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return clean.select(*[F.expr(f"try_cast(`{n}` as {t})").alias(n) for n, t in fields])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def items_with_coordinates(items: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Items that have a hand-made position; the optimiser broadcasts the coordinate table when it is small."""
    return items.join(coordinates, "id")


def item_documents(tables: dict[str, DataFrame], coordinates: DataFrame) -> DataFrame:
    """Place rows of the sample items: name, subjects and findings run together as the document."""
    subject = tables["item_subject"].join(tables["subject"], "normalized_name").groupBy("item_id").agg(
        F.array_join(F.array_sort(F.collect_list("name")), "、").alias("subjects")
    )
    found = tables["finding"].groupBy("item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda f: f["text"]), "。").alias("findings")
    )
    rows = (
        items_with_coordinates(tables["item"], coordinates)
        .withColumnRenamed("id", "item_id")
        .join(subject, "item_id", "left")
        .join(found, "item_id", "left")
    )
    return rows.select(
        F.lit("sample").alias("source"), F.col("item_id").alias("ext_id"), "name",
        F.lit(None).cast("string").alias("description"), F.lit("サンプルの Discovery").alias("kinds"),
        document_text("name", "subjects", "findings").alias("doc"), "lon", "lat",
    )
