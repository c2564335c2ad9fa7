"""Which side of a join is small enough to be sent to all executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables up to so many bytes are sent to all executors.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """df with the broadcast hint if its rows, counted, add up to BROADCAST_BYTES at most; else as it is, for an exchange."""
    total = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
