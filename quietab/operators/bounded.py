"""Size-checked broadcasts: a side is broadcast only after its rows and bytes are
known to be within bounds; otherwise the join stays an ordinary shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: default upper bounds of a broadcast side: rows, and bytes as JSON text
BROADCAST_ROWS_MAX = 1_000_000
BROADCAST_BYTES_MAX = 64 << 20


def _fixed(kind: T.DataType) -> bool:
    """Values of this type have a fixed width."""
    if isinstance(kind, T.StructType):
        return all(_fixed(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS_MAX, max_bytes: int = BROADCAST_BYTES_MAX) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows of at most ``max_bytes`` in all, else ``df``;
    written first, so the count is not recomputed by the join and nothing stays cached."""
    df = materialise(df, "bounded")
    if df.count() > max_rows:
        return df
    if all(_fixed(f.dataType) for f in df.schema.fields) and 16 * len(df.columns) * max_rows <= 4 * max_bytes:
        return F.broadcast(df)  # the rows bound the bytes
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
