"""The quality verdict against the labels, in both directions."""

from pathlib import Path

from stopover.llm import queries
from stopover.llm.common import table


def test_verdict_against_labels(spark, sf):
    sf = str(Path(sf).parent / "sf0.01")
    judged = queries.op6_quality(spark, sf).where("not base_failed").select("doc_id", "kept", "score")
    rows = judged.join(table(spark, sf, "labels"), "doc_id").collect()
    junk = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(junk) > 20 and sum(junk) <= 0.05 * len(junk)
    assert len(good) > 200 and sum(good) >= 0.95 * len(good)
