"""Pages of ordered results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, cursor: DataFrame, size: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The rows after the cursor row (c_ts, c_id), newest first, and one more that tells whether a page follows."""
    after = (F.col(ts) < F.col("c_ts")) | ((F.col(ts) == F.col("c_ts")) & (F.col(key) < F.col("c_id")))
    return df.crossJoin(F.broadcast(cursor)).filter(after).orderBy(F.desc(ts), F.desc(key)).limit(size + 1)  # the cursor is one row
