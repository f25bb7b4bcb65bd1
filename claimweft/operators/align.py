"""Local alignment of token or letter sequences (Smith-Waterman), for pairs that a join has already made.

Rows of the score matrix are whole numpy vectors: with a linear gap, the best of all gaps to the left is a running
maximum. The score is divided by the best that the shorter sequence could reach, so it never passes 1.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.operators.search import top_per_key

MATCH, MISMATCH, GAP = 3, -2, -1
_WORD = re.compile(r"[^\W]+")

RESULT = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType()),
    T.StructField("matches", T.IntegerType()), T.StructField("mismatches", T.IntegerType()), T.StructField("gaps", T.IntegerType()),
])


class Alignment(NamedTuple):
    score: float
    left: str
    right: str
    matches: int
    mismatches: int
    gaps: int


def sequence(text: str | None, letters: bool) -> list[str]:
    low = (text or "").lower()
    return list(low) if letters else _WORD.findall(low)


def score_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    ramp = -GAP * np.arange(1, len(b) + 1, dtype=np.int32)
    for i in range(1, len(a) + 1):
        best = np.maximum(np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], MATCH, MISMATCH), h[i - 1, 1:] + GAP), 0)
        h[i, 1:] = np.maximum.accumulate(best + ramp) - ramp
    return h


def encode(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    return tuple(np.array([ids.setdefault(x, len(ids)) for x in s], np.int32) for s in (a, b))


def align(a: list[str], b: list[str], trace: bool = True) -> Alignment:
    """Empty sequences, or none in common, give score 0. Ties in the trace go left, then up, then along the diagonal."""
    if not a or not b:
        return Alignment(0.0, "", "", 0, 0, 0)
    x, y = encode(a, b)
    h = score_matrix(x, y)
    top = int(h.max())
    if top == 0:
        return Alignment(0.0, "", "", 0, 0, 0)
    score = top / (MATCH * min(len(a), len(b)))
    if not trace:
        return Alignment(score, "", "", 0, 0, 0)
    i, j = (int(k) for k in np.unravel_index(int(h.argmax()), h.shape))
    left, right = [], []
    matches = mismatches = gaps = 0
    while i > 0 and j > 0 and h[i, j] > 0:
        if h[i, j] == h[i, j - 1] + GAP:
            j -= 1
            left.append("-")
            right.append(b[j])
            gaps += 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
            left.append(a[i])
            right.append("-")
            gaps += 1
        else:
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
            if a[i] == b[j]:
                matches += 1
            else:
                mismatches += 1
    return Alignment(score, " ".join(left[::-1]), " ".join(right[::-1]), matches, mismatches, gaps)


def scores(left: list[list[str]], right: list[list[str]], cells: int = 1 << 22) -> np.ndarray:
    """Scores of many pairs at once: pairs of similar size share a batch, whose score rows are one array."""
    out = np.zeros(len(left))
    ids: dict[str, int] = {}
    a = [np.array([ids.setdefault(x, len(ids)) for x in s], np.int32) for s in left]
    b = [np.array([ids.setdefault(x, len(ids)) for x in s], np.int32) for s in right]
    order = sorted((k for k in range(len(a)) if len(a[k]) and len(b[k])), key=lambda k: (len(b[k]), len(a[k])))
    begin = 0
    while begin < len(order):
        longest = len(b[order[begin]])
        end = begin + 1
        while end < len(order) and len(b[order[end]]) <= longest * 1.3 + 4 and (end - begin + 1) * (len(b[order[end]]) + 1) <= cells // 16:
            end += 1
        group = order[begin:end]
        n, m = max(len(a[k]) for k in group), len(b[group[-1]])
        x, y = np.full((len(group), n), -1, np.int32), np.full((len(group), m), -2, np.int32)
        for g, k in enumerate(group):
            x[g, :len(a[k])], y[g, :len(b[k])] = a[k], b[k]
        h, top = np.zeros((len(group), m + 1), np.int32), np.zeros(len(group), np.int32)
        ramp = -GAP * np.arange(1, m + 1, dtype=np.int32)
        for i in range(n):
            best = np.maximum(np.maximum(h[:, :-1] + np.where(y == x[:, i:i + 1], MATCH, MISMATCH), h[:, 1:] + GAP), 0)
            h[:, 1:] = np.maximum.accumulate(best + ramp, 1) - ramp
            np.maximum(top, h.max(1), out=top)
        short = np.array([min(len(a[k]), len(b[k])) for k in group])
        out[group] = top / (MATCH * short)
        begin = end
    return out


def score_column(left: Column, right: Column, letters: bool = False) -> Column:
    """Scores alone, in batches; most pairs of a search need no more."""
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scores([sequence(x, letters) for x in a], [sequence(x, letters) for x in b]))

    return run(left, right)


def alignment_column(left: Column, right: Column, letters: bool = False, trace: bool = True) -> Column:
    """Struct RESULT of two text columns."""
    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(sequence(p, letters), sequence(q, letters), trace) for p, q in zip(a, b)], columns=RESULT.names)

    return run(left, right)


def best_aligned(pairs: DataFrame, key: list[str], left: str, right: str, pos: str, n: int = 3, letters: bool = False) -> DataFrame:
    """The ``n`` best right sides of each key, by score and then by position. Only the winners are traced."""
    keys = list(dict.fromkeys([*key, left]))
    scored = pairs.select(*keys, pos, right, F.round(score_column(F.col(left), F.col(right), letters), 6).alias("score"))
    best = top_per_key(scored.filter("score > 0"), key, n, F.desc("score"), F.asc(pos))
    traced = best.withColumn("sw", alignment_column(F.col(left), F.col(right), letters))
    return traced.select(*key, pos, right, "score", "sw.matches", "sw.mismatches", "sw.gaps", F.col("sw.left").alias("aligned"), "rank")


def strongest(scores: DataFrame, key: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """The row of the largest absolute score of each key; of equal ones the first."""
    rest = [c for c in scores.columns if c not in key]
    return scores.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.abs(F.col(score)), -F.col(pos))).alias("_r")).select(*key, "_r.*")
