"""Export formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_line(time: Column, level: Column, phase: Column, message: Column, claim: Column | None = None) -> Column:
    """``HH:MM:SS.mmm LEVEL phase [claim] message`` with padded level and phase."""
    tag = F.when(claim.isNotNull(), F.concat(F.lit("["), claim, F.lit("] "))).otherwise("") if claim is not None else F.lit("")
    return F.concat(F.date_format(time, "HH:mm:ss.SSS"), F.lit(" "), F.rpad(F.upper(level), 5, " "), F.lit(" "), F.rpad(phase, 18, " "), F.lit(" "), tag, message)


def write_log(df: DataFrame, folder: str, order: list[str], line: str = "line", header: str | None = None) -> None:
    """Ordered text files, one header file first where a header is given."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(line)
    if header is not None:
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/header")
    ordered.write.mode("overwrite").text(f"{folder}/lines")


def json_reply(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("reply"))
