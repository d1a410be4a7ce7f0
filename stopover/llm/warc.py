"""WARC archives: written by Spark, read back through a verified chain of record boundaries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopover.llm.common import settle
from stopover.session import ensure_checkpoint_dir, skew_join

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
# Payloads from this many bytes on are stored once; smaller copies are cheaper than a reference.
REVISIT_BYTES = 1000


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, ``record_type`` and ``refers_to`` of every page.

    Of equal payloads of at least ``revisit_bytes`` bytes the page with the largest id is the response and the others
    refer to it. Ids are not assumed unique: all rows under the largest id are responses; a null id is never the largest,
    and payloads that only pages without an id hold are all responses. A null html is an empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= revisit_bytes
    shared = settle(
        rows.where(large).groupBy("digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("digest", "_first")
    )
    joined = skew_join(rows, shared, ["digest"], [F.col("page_id")], "left")
    again = large & F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_first")))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def write_warc(records: DataFrame, folder: str, compression: str = "gzip", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the planned records, one archive a task, committed by Spark.

    Control characters of a url are percent-encoded; null ids and urls leave their header out. Revisits carry the digest
    of the full payload and an empty block after the HTTP header.
    """
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit(END))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Target-URI", url), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(http) + F.octet_length(body), F.lit(END),
    )
    records.select(F.concat(head, http, body).alias("value")).write.option("lineSep", END).option("compression", compression).text(folder)


def _parse(rows: DataFrame) -> DataFrame:
    """What stands between two magics (``value``), read as a record; ``total`` is null if it is none."""
    head = F.substring_index("value", END, 1)
    field = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), F.col("_head")), rf"\r\n{name}: ?([^\r\n]*)", 1), F.lit(""))
    number = lambda name: F.regexp_extract(F.coalesce(field(name), F.lit("")), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    rows = rows.withColumns({"_head": head, "_size": F.octet_length("value").cast("long")})
    rows = rows.withColumns({"_start": F.octet_length("_head").cast("long") + len(END), "_length": field("Content-Length").try_cast("long"), "_type": field("WARC-Type")})
    rows = rows.withColumn("_ok", (F.col("_start") <= F.col("_size")) & (F.col("_length") >= 0) & F.col("_type").isNotNull())
    rows = rows.withColumn("_block", F.expr("if(_ok, substring(cast(value as binary), cast(_start + 1 as int), cast(_length as int)), cast('' as binary))"))
    rows = rows.withColumn("_http", F.octet_length(F.substring_index(F.col("_block").cast("string"), END, 1)) + len(END))
    rows = rows.withColumn("_payload", F.expr("substring(_block, _http + 1, greatest(octet_length(_block) - _http, 0))"))
    return rows.select(
        "file", "split", *[c for c in ("at",) if c in rows.columns], F.col("_size").alias("size"),
        F.when(F.col("_ok"), F.lit(len(MAGIC)) + F.col("_start") + F.col("_length") + len(END)).alias("total"),
        number("WARC-Record-ID").alias("page_id"), number("WARC-Refers-To").alias("refers_to"), F.col("_type").alias("record_type"),
        field("WARC-Target-URI").alias("url"), F.regexp_extract(F.coalesce(field("WARC-Payload-Digest"), F.lit("")), "sha1:(.*)", 1).alias("stated"),
        F.octet_length("_payload").cast("long").alias("payload_bytes"), F.sha1("_payload").alias("digest"),
    )


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``, the offset of each row's magic from the start of its split; rows come in file order."""
    key, run = None, 0
    for batch in batches:
        names = [f"{f}\0{s}" for f, s in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), strict=True)]
        at = np.zeros(batch.num_rows, np.int64)
        for i, size in enumerate(batch.column("size").to_pylist()):
            if names[i] != key:
                key, run = names[i], 0
            at[i] = run - len(MAGIC)
            run += size + len(MAGIC)
        yield batch.append_column("at", pa.array(at))


def _with_offsets(df: DataFrame) -> DataFrame:
    kept = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return df.mapInArrow(_offsets, f"{kept}, at long")


def _chain(table: pa.Table) -> pa.Table:
    """Where each candidate of one split leaves the split, by pointer doubling over the candidates' successors."""
    table = table.sort_by("at")
    at, after = table["at"].to_numpy(), table["next"].to_numpy()
    here = np.searchsorted(at, after)
    inside = (here < len(at)) & (at[np.minimum(here, len(at) - 1)] == after)
    hop, leaves = np.where(inside, here, np.arange(len(at))), after.copy()
    while (hop[hop] != hop).any():
        hop = hop[hop]
    return table.append_column("leaves", pa.array(leaves[hop]))


def _reach(table: pa.Table) -> pa.Table:
    """Marks the candidates of one split that its entry reaches, by pointer doubling, and the record each row lies in."""
    table = table.sort_by("at")
    at = table["at"].to_numpy()
    after = np.asarray(table["next"].fill_null(-1)).astype(np.int64)
    live, entry = after >= 0, table["entry"][0].as_py()
    here = np.searchsorted(at, after)
    end = len(at)
    inside = live & (here < end)
    inside[inside] &= at[here[inside]] == after[inside]
    hop = np.append(np.where(inside, here, end), end)
    reached = np.zeros(end + 1, bool)
    if entry is not None:
        reached[:end] = (at == entry) & live
    while True:
        more = reached.copy()
        more[hop[reached]] = True
        hop = hop[hop]
        if (more[:end] == reached[:end]).all():
            break
        reached = more
    owner = np.maximum.accumulate(np.where(reached[:end], at, -1))
    return table.drop_columns(["entry"]).append_column("reached", pa.array(reached[:end])).append_column("owner", pa.array(owner))


def _entries(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """First verified record of every split: (file, split, entry), by pointer jumping from split to split."""
    spark = rows.sparkSession
    if starts.where("split > 0").isEmpty():
        return starts.select("file", "split", F.lit(0).cast("long").alias("entry"))
    live = rows.where("total is not null").select("file", "split", "at", (F.col("at") + F.col("total")).alias("next"))
    jump = live.groupBy("file", "split").applyInArrow(_chain, "file string, split long, at long, next long, leaves long")
    jump = settle(jump.select("file", "split", "at", "leaves"))
    nodes = settle(jump.join(jump.select("file", F.col("leaves").alias("at")).distinct(), ["file", "at"], "left_semi").union(jump.where("at = 0")).distinct())
    reach, hop = nodes.where("at = 0").select("file", "at"), nodes.select("file", "at", F.col("leaves").alias("to"))
    known = reach.count()
    while True:
        far = reach.join(hop, ["file", "at"]).join(nodes.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi")
        reach = settle(reach.union(far.select("file", F.col("to").alias("at"))).distinct())
        now = reach.count()
        if now == known:
            break
        known = now
        hop = settle(hop.join(hop.select("file", F.col("at").alias("to"), F.col("to").alias("_far")), ["file", "to"]).select("file", "at", F.col("_far").alias("to")))
    entry = reach.join(nodes.select("file", "split", "at"), ["file", "at"]).groupBy("file", "split").agg(F.min("at").alias("entry"))
    return settle(starts.select("file", "split").join(entry, ["file", "split"], "left").select("file", "split", "entry"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Everything between two magics, in file order within a split: (file, split, value)."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives of a folder: page_id, record_type, refers_to, url, payload_bytes, digest, stated digest.

    Every magic is a candidate with a successor offset from its stated length. Pointer jumping from the start of each file
    (inside a split in numpy, from split to split in joins) keeps the candidates on the chain; magics inside payloads are
    not on it, and records cut by them are put together again. Text before the first record or after a broken length ends
    the chain there. Compressed archives are one split each.
    """
    narrow = settle(_with_offsets(_parse(_rows(spark, folder))))
    sums = narrow.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("_sum"))
    before = F.sum("_sum").over(_by_file()) - F.col("_sum")
    starts = settle(sums.select("file", "split", before.alias("_base")))  # one row a split
    rows = narrow.join(starts, ["file", "split"]).withColumn("at", F.col("at") + F.col("_base")).drop("_base")
    entry = _entries(rows, starts)
    kept = ("page_id", "refers_to", "record_type", "url", "stated", "payload_bytes", "digest", "size", "total")
    marked = rows.withColumn("next", F.when(F.col("total").isNotNull(), F.col("at") + F.col("total"))).join(entry, ["file", "split"])
    plain = {n: t for n, t in marked.dtypes if n != "entry"}
    marked = settle(marked.groupBy("file", "split").applyInArrow(_reach, ", ".join(f"{n} {t}" for n, t in plain.items()) + ", reached boolean, owner long"))
    whole = len(MAGIC) + F.col("size") >= F.col("total") - len(END)
    good = marked.where("reached").where(whole)
    cut = marked.where("reached").where(~whole).select("file", F.col("at").alias("owner"))
    if cut.isEmpty():
        return good.select(*kept)
    last = marked.where("reached").groupBy("file", "split").agg(F.max("at").alias("_last"))
    carried = starts.join(last, ["file", "split"], "left").select("file", "split", F.last("_last", True).over(_by_file().rowsBetween(-(2**31), -1)).alias("_carry"))
    owners = marked.join(carried, ["file", "split"]).select("file", "at", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("_carry")).alias("owner"))
    owners = owners.join(cut, ["file", "owner"], "left_semi")
    again = _with_offsets(_rows(spark, folder).withColumn("size", F.octet_length("value").cast("long")))
    again = again.join(starts, ["file", "split"]).withColumn("at", F.col("at") + F.col("_base")).join(owners, ["file", "at"])
    joined = again.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_parts"))  # one record's parts
    glued = joined.select("file", F.lit(0).cast("long").alias("split"), F.array_join(F.transform("_parts", lambda p: p["value"]), MAGIC).alias("value"))
    return good.select(*kept).unionByName(_parse(glued).select(*kept))


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("split")


def resolve(records: DataFrame) -> DataFrame:
    """Records with the full payload's size and digest: a revisit takes the size from the response it refers to."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    own = records.where("record_type <> 'revisit'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url")
    full = settle(own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), "payload_bytes").distinct())
    again = records.where("record_type = 'revisit'").select("page_id", "refers_to", "record_type", "url", "stated")
    again = skew_join(again, full, ["refers_to", "stated"], [F.col("page_id")], "left").withColumnRenamed("stated", "payload_digest")
    return own.select(*names).unionByName(again.select(*names))


def archive_pages(pages: DataFrame, folder: str | None = None, compression: str = "gzip") -> DataFrame:
    """Write ``pages`` to archives and return their records as read back; an empty table gives no record."""
    spark = pages.sparkSession
    folder = folder or archive_folder(spark)
    write_warc(plan_records(pages), folder, compression)
    return resolve(settle(read_warc(spark, folder)))
