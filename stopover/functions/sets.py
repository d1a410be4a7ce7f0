"""Set algebra on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subset_of(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return subset_of(a, b) & subset_of(b, a)


def common_to_all(sets: Column) -> Column:
    """Intersection over an array of arrays; NULL for an empty array."""
    return F.when(
        F.size(sets) > 0,
        F.aggregate(F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0))), F.element_at(sets, 1), F.array_intersect),
    )


def distinct_list(col: Column, sep: str = "、") -> Column:
    """Aggregate: distinct values in order, joined by a separator."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def set_difference(a, b, keys: list[str]):
    """Rows of either side without a partner on the keys, tagged with the side they are on."""
    only_a = a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti").withColumn("side", F.lit("a"))
    only_b = b.select(*keys).distinct().join(a.select(*keys), keys, "left_anti").withColumn("side", F.lit("b"))
    return only_a.unionByName(only_b)
