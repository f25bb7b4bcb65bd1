"""Set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweft.operators.search import ordered_union


def without_ids(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows but those whose key is in the table of removals."""
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def is_contained(part: DataFrame, whole: DataFrame, column: str) -> bool:
    """Whether every value of ``part`` is also in ``whole``."""
    return part.select(column).join(whole.select(column), column, "left_anti").isEmpty()


def only_new(final: DataFrame, emitted: DataFrame, keys: list[str]) -> DataFrame:
    """What the closing pass adds to what was already emitted; equal texts count as one."""
    return final.dropDuplicates(keys).join(emitted.select(*keys).distinct(), keys, "left_anti")


def ahead(first: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows of ``first`` before those of ``rest``, by the column ``branch``."""
    return ordered_union(first, rest)


def flag_members(rows: DataFrame, members: DataFrame, column: str, out: str = "member") -> DataFrame:
    marks = members.select(column).distinct().withColumn(out, F.lit(True))
    return rows.join(marks, column, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and largest absolute difference of two tables of pairs; a pair that one lacks counts as 0 there."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return both.agg(F.count("*").alias("pairs"), F.avg(gap).alias("mean"), F.max(gap).alias("largest"))
