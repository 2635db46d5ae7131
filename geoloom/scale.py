"""What may be sent to every executor, measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether all rows and the bytes of their values are within the bounds; one aggregation."""
    varying = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    lengths = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in varying]
    got = df.agg(F.count("*"), *[x.alias(f"_{i}") for i, x in enumerate(lengths)]).first()
    return got[0] <= rows and sum(got[1:]) + 8 * got[0] * (len(df.columns) - len(varying)) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it is measured to be within the bounds, else left to a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df
