"""Composition of search results: ordering, fallback, first occurrence, exclusion, and joins with verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweft.functions.text import canonical_url


def ordered_union(*branches: DataFrame) -> DataFrame:
    """All branches one after the other: ``branch`` numbers them, so that their order survives the shuffle."""
    return reduce(DataFrame.unionByName, (b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. As an aggregate, it combines before the shuffle: a hot key costs one row a partition."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def prefer_branch(df: DataFrame, keys: list[str], branch: str = "branch") -> DataFrame:
    """Rows of the first branch that has any for the key."""
    least = df.groupBy(*keys).agg(F.min(branch).alias("_least"))
    return df.join(least, keys).filter(F.col(branch) == F.col("_least")).drop("_least")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each partition to ``n`` a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def distinct_hits(hits: DataFrame, keys: list[str], *order: Column, url: str = "url") -> DataFrame:
    """One hit for each key and canonical address, the first in order."""
    return first_by(hits.withColumn("canonical", canonical_url(url)), [*keys, "canonical"], *order)


def without_own_page(hits: DataFrame, own: DataFrame, key: str, url: str = "url", own_url: str = "own_url") -> DataFrame:
    """Hits but those that lead back to the page that the key belongs to."""
    back = own.select(key, canonical_url(own_url).alias("_canonical"))
    return hits.withColumn("_canonical", canonical_url(url)).join(back, [key, "_canonical"], "left_anti").drop("_canonical")


def last_verdicts(verdicts: DataFrame, *order: Column, keys: tuple[str, ...] = ("claimId", "url")) -> DataFrame:
    """The last verdict of each claim and address."""
    row = F.struct(*[c for c in verdicts.columns if c not in keys])
    return verdicts.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def flatten_fact_checks(replies: DataFrame, claims: str = "claims", query: str = "query") -> DataFrame:
    """One row a review that has an address and a publisher's name; a missing rating is a dash, a missing claim the query."""
    rows = replies.select(query, F.explode(claims).alias("c")).select(query, "c.text", F.explode("c.claimReview").alias("r"))
    kept = rows.filter(F.col("r.url").isNotNull() & (F.col("r.url") != "") & F.col("r.publisher.name").isNotNull())
    return kept.select(
        query, F.col("r.publisher.name").alias("publisher"), F.col("r.publisher.site").alias("publisher_site"), F.col("r.url").alias("url"),
        F.coalesce(F.col("r.textualRating"), F.lit("—")).alias("rating"), F.coalesce(F.col("text"), F.col(query)).alias("claim_text"),
    )


def addable_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Addresses that parse and whose host has a dot, each once."""
    parsed = F.try_parse_url(F.col(url), F.lit("HOST"))
    return df.filter(parsed.contains(".")).dropDuplicates([url])
