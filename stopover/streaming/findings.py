"""Daily changes of claims, findings and questions applied as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopover.operators.claims import append_claims, apply_changes
from stopover.session import cut_lineage
from stopover.streaming import versions

_MARK = "struct<day:int,reason:string>"
STATE_SCHEMAS = {
    "claims": f"conv long, id string, content string, kind string, src array<string>, day int, excluded {_MARK}",
    "findings": (
        "conv long, id string, content string, kind string, status string, related_places array<string>, "
        f"aliases array<string>, claims array<string>, day int, updated int, expired {_MARK}"
    ),
    "questions": f"conv long, id string, about string, question string, type string, day int, removed {_MARK}",
}
_FINDING = "content string, kind string, status string, related_places array<string>, aliases array<string>, claims array<string>"
# Body of each kind of change record.
CHANGE_SCHEMAS = {
    "claim": "pos int, content string, kind string, src array<string>",
    "exclude": "id string, reason string",
    "add": f"pos int, id string, {_FINDING}",
    "update": f"id string, {_FINDING}",
    "expire": "id string, reason string",
    "ask": "pos int, about string, question string, type string",
    "reask": "id string, question string, type string",
    "drop": "id string, reason string",
}


def changes_of(records: DataFrame) -> dict[str, DataFrame]:
    """Change records (conv, day, change, body) parsed into one table per kind."""
    return {
        name: records.where(F.col("change") == name).select("conv", F.from_json("body", schema).alias("b")).select("conv", "b.*")
        for name, schema in CHANGE_SCHEMAS.items()
    }


def apply_day(state: dict[str, DataFrame], records: DataFrame, day: int) -> dict[str, DataFrame]:
    """New claims of the day first, then the day's changes."""
    delta = changes_of(records)
    state = {**state, "claims": append_claims(state["claims"], delta.pop("claim"), day)}
    return {k: cut_lineage(v) for k, v in apply_changes(state, delta, day).items()}


def finding_stream(records: DataFrame, root: str, checkpoint: str, **trigger):
    """Keep claims, findings and questions below ``root``; a batch that runs again rewrites the same version.

    A batch may hold several days, which are applied in order.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        version = epoch + 1
        if (versions.latest(spark, f"{root}/questions") or 0) >= version:
            return
        # A half-written version is redone from the last one whose final table is complete.
        before = versions.latest(spark, f"{root}/questions")
        state = {
            k: spark.createDataFrame([], s) if before is None else versions.read(spark, f"{root}/{k}", before)
            for k, s in STATE_SCHEMAS.items()
        }
        for day in sorted(r[0] for r in batch.select("day").distinct().collect()):
            state = apply_day(state, batch.where(F.col("day") == day), day)
        for k in STATE_SCHEMAS:
            versions.write(state[k], f"{root}/{k}", version)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
