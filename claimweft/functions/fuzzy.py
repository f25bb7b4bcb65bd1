"""Best-window similarity of short in long strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors: one step a letter of ``b``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: the best 200 * common / (lengths) of the shorter string and any window of its length in the longer one,
    cut windows at both ends included."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    letters = set(short)
    for start in range(-n + 1, len(long)):
        window = long[max(0, start):start + n]
        if window[0] not in letters and start > 0 or window[-1] not in letters and start + n < len(long):
            continue
        if 200 * min(n, len(window)) / (n + len(window)) <= best:
            continue
        best = max(best, 200 * common_length(short, window) / (n + len(window)))
    return best


@F.pandas_udf(T.DoubleType())
def _partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) for x, y in zip(a, b)])


def partial_ratio_column(a: Column, b: Column) -> Column:
    return _partial_ratio(a, b)
