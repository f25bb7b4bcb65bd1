"""Times without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(column: str) -> Column:
    """Microseconds since 1970, whatever the session's zone and whichever kind of timestamp the column has."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{column}` AS TIMESTAMP_NTZ))")
