"""Broadcasts whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table under this many bytes may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, at ``row_bytes`` and the measured bytes of their texts, stay below ``limit``.

    Beyond the limit both sides are shuffled and sorted, so that no broadcast grows with the data.  That needs a hint too: files
    of values that repeat are far smaller than their rows, and Spark would broadcast a table by the size of its files.
    ``df`` should be cheap to count: a written table, say.
    """
    texts = [F.octet_length(F.col(f"`{name}`")) for name, kind in df.dtypes if kind in ("string", "binary")]
    long = sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0)).cast("long")
    most = limit // row_bytes
    rows, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(long), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and rows * row_bytes + size <= limit else df.hint("merge")
