"""Finding a quotation in a text: exactly, without regard to white space, or by a shortened quotation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.functions.text import alignment_label

_SPACE = re.compile(r"\s+")


def find(haystack: str | None, needle: str | None, step: int = 8, least: int = 24) -> int:
    """Start of the needle from 0, -1 where it isn't found. A needle is shortened from its end by ``step`` characters as
    long as ``least`` are left."""
    if not haystack or not needle:
        return -1
    at = haystack.find(needle)
    if at >= 0:
        return at
    flat, want = _SPACE.sub(" ", haystack), _SPACE.sub(" ", needle).strip()
    while want:
        at = flat.find(want)
        if at >= 0:
            return _original(haystack, at)
        if len(want) - step < least:
            return -1
        want = want[:-step]
    return -1


def _original(haystack: str, at: int) -> int:
    """Where the place ``at`` of the collapsed text is in the text itself."""
    gone = 0
    for run in _SPACE.finditer(haystack):
        if run.start() - gone >= at:
            break
        gone += run.end() - run.start() - 1
    return at + gone


@F.pandas_udf(T.IntegerType())
def _find(haystack: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([find(h, n) for h, n in zip(haystack, needle)])


def position(haystack: Column, needle: Column) -> Column:
    """The exact search stays in the JVM; only its misses are looked at again."""
    exact = F.instr(haystack, needle) - 1
    return F.when(exact >= 0, exact).otherwise(_find(F.when(exact < 0, haystack), needle))


def exact_position(haystack: Column, needle: Column) -> Column:
    return F.when(F.length(needle) > 0, F.instr(haystack, needle) - 1).otherwise(-1)


def highlight_target(quote: Column, text: Column) -> Column:
    """The quotation, or the claim's text where it is null or empty; null under 8 characters."""
    target = F.coalesce(F.nullif(quote, F.lit("")), text)
    return F.when(F.length(F.trim(target)) >= 8, target)


def highlights(claims: DataFrame, pages: DataFrame, exact_only: bool = False) -> DataFrame:
    """(id, page_id, kind, start, end, found, exact): where each claim's quotation stands on its page, and whether letter for
    letter."""
    held = claims.select("id", "page_id", highlight_target(F.col("quote"), F.col("text")).alias("needle")).filter("needle is not null")
    met = held.join(pages.select("page_id", F.col("text").alias("page")), "page_id")
    at = exact_position(F.col("page"), F.col("needle")) if exact_only else position(F.col("page"), F.col("needle"))
    placed = met.withColumn("start", at)
    found = (F.col("start") >= 0) & (F.col("start") + F.length("needle") <= F.length("page"))
    return placed.select("id", "page_id", F.lit("claim").alias("kind"), "start", (F.col("start") + F.length("needle")).alias("end"), found.alias("found"),
        (exact_position(F.col("page"), F.col("needle")) >= 0).alias("exact"))


def running_offsets(parts: DataFrame, key: str, pos: str = "pos", text_col: str = "chunk") -> DataFrame:
    """Each part's start: the length of all parts before it."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(F.length(text_col)).over(w), F.lit(0)))


def node_at(offsets: DataFrame, nodes: DataFrame, key: str, offset: str = "offset", start: str = "start", length: str = "length", pos: str = "pos") -> DataFrame:
    """As-of lookup: for each offset the last node that starts at or before it, null where that node ends before it.

    Offsets and nodes are merged in order of place within each key, so no offset meets all nodes."""
    n = nodes.select(key, F.col(start).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(pos).alias("p"), F.col(start).cast("bigint").alias("s"), F.col(length).cast("bigint").alias("l")).alias("_node"), F.lit(None).cast("bigint").alias(offset))
    o = offsets.select(key, F.col(offset).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<p:int,s:bigint,l:bigint>").alias("_node"), F.col(offset).cast("bigint").alias(offset))
    w = Window.partitionBy(key).orderBy("_at", "_kind", F.col("_node.p")).rowsBetween(Window.unboundedPreceding, 0)
    last = n.withColumn("_node", F.col("_node").cast("struct<p:int,s:bigint,l:bigint>")).unionByName(o).withColumn("_last", F.last("_node", ignorenulls=True).over(w)).filter("_kind = 1")
    inside = F.col(offset) < F.col("_last.s") + F.col("_last.l")
    return last.select(key, offset, F.when(inside, F.col("_last.p")).alias("node"), F.when(inside, F.col(offset) - F.col("_last.s")).alias("within"))


def evidence_targets(verdicts: DataFrame) -> DataFrame:
    """(claimId, url, kind, evidence) of verdicts that take a side and quote something."""
    label = alignment_label("alignment")
    sided = verdicts.filter((F.coalesce("evidence", F.lit("")) != "") & (label != "unrelated"))
    return sided.select("claimId", "url", F.when(label == "agrees", "evidence-agree").otherwise("evidence-disagree").alias("kind"), "evidence")
