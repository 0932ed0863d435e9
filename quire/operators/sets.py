"""Set operations on keys and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replaced_flags(old: Column, managed: list[str], new: Column) -> Column:
    """Flags in order: the old ones that are not managed here, and the new ones."""
    return F.array_sort(F.array_union(F.array_except(old, F.array(*map(F.lit, managed))), new))


def overlap(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays as sets, 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Keys of both in order of first occurrence, those of `first` before the others."""
    rows = first.select(key, F.struct(F.lit(0).alias("t"), F.col(order).alias("o")).alias("__o")).unionByName(second.select(key, F.struct(F.lit(1).alias("t"), F.col(order).alias("o")).alias("__o")))
    return rows.groupBy(key).agg(F.min("__o").alias("place"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are on one side only, and whether there is none."""
    sides = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full")
    return sides.agg(F.count(F.when(F.col("__b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("__a").isNull(), 1)).alias("only_right")).withColumn("equal", F.col("only_left") + F.col("only_right") == 0)
