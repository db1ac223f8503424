"""Broadcasts are decided by a counted size, never by hope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows times estimated bytes a row beyond which a side is not broadcast.
BROADCAST_BYTES = 48 << 20


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below ``limit`` bytes; otherwise as it is, so that the
    join shuffles. ``df`` should be checkpointed or cheap, since it is counted here."""
    most = max(1, limit // row_bytes)
    small = df.limit(most + 1).count() <= most
    return F.broadcast(df) if small else df
