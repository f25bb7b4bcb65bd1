"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; a directory of part files and one file both work."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For a scan, not for a shuffled result: a table of fewer splits than there are cores, dealt out to all of them before costly work on its rows.

    A table that is large enough to have a split for every core is left as it is, so nothing large is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
