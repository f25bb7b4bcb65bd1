"""How operators treat columns that they don't know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The name under which an operator reads its value; no table has such a column.
VALUE = "__claimweft_value"


def carried(df: DataFrame, value_col: str, outputs: list[str], leave_out: str | None = None) -> tuple[DataFrame, list[T.StructField]]:
    """``df`` with its value under VALUE, and the fields that pass through.

    All other columns pass through untouched, but one that has the name of an output (in any case of letters) gives way
    to that output. Meanwhile they have plain names, so that names with dots and the like do no harm.
    """
    taken = {o.lower() for o in outputs}
    passing = [f for f in df.schema.fields if f.name.lower() not in taken and f.name != leave_out]
    kept = [T.StructField(f"__k{i}", f.dataType, f.nullable, {"name": f.name}) for i, f in enumerate(passing)]
    return df.select(*[F.col(f"`{f.name}`").alias(k.name) for f, k in zip(passing, kept)], F.col(f"`{value_col}`").alias(VALUE)), kept


def restored(df: DataFrame, kept: list[T.StructField]) -> DataFrame:
    """Columns that passed through, first and in order, under their own names again."""
    return df.toDF(*[k.metadata["name"] for k in kept], *df.columns[len(kept):])
