"""Bounded samples that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bounded_sample(df: DataFrame, columns: list[str], max_rows: int, by: str = "text") -> list[T.Row]:
    """At most ``max_rows`` distinct rows, the first by the hash of ``by``, so the same ones for the same table.

    Of a large table only rows under a threshold of the hash are looked at, about four times as many as are wanted; so what
    reaches the driver doesn't grow with the table. Where rows repeat so much that fewer are found, the threshold is raised
    until there are enough, or all have been looked at: the rows are the same however large the table is."""
    rows = df.select(*columns).filter(F.col(by).isNotNull())
    share = 4 * max_rows / max(1, rows.count())
    while True:
        below = rows if share >= 1 else rows.filter(F.xxhash64(by) < F.lit(int(-(2**63) + 2**64 * share)))
        found = below.distinct().orderBy(F.xxhash64(by), *columns).limit(max_rows).collect()
        if len(found) == max_rows or share >= 1:
            return found
        share *= 16
