"""Relational state: upserts, anti-joins, retention, transitions. Tables are DataFrames, results replace them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unseen(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys do not exist yet (resume, insert if absent, new or changed by hash)."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def merge_by_key(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent upsert: rows of ``new`` replace those of equal keys."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes last in ``order`` (descending columns)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def retain_newest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def transition(df: DataFrame, state: str, event: str, allowed: dict[tuple[str, str], str]) -> DataFrame:
    """State after an event where the table allows it; otherwise the state stays."""
    out = F.col(state)
    for (was, on), to in allowed.items():
        out = F.when((F.col(state) == was) & (F.col(event) == on), F.lit(to)).otherwise(out)
    return df.withColumn("new_state", out)


def current_status(log: DataFrame, key: str, status: str, ts: str, tie: str) -> DataFrame:
    """Latest status of each key from an event log."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(ts, tie)).alias("status"), F.max(ts).alias("since"))


def admit(df: DataFrame, key: str, ts: str, limit: int, window_s: float, order: str) -> DataFrame:
    """Exact sliding-window admission of each key: a rejected request does not count, one exactly as old as the window
    has left it. A fold over each key's rows, which Spark sorts by time, keeps only the admitted times of the window
    (at most ``limit``), so a key of any size goes through one task batch by batch."""
    rows = df.select(F.col(key), F.col(ts).alias("_t"), F.col(order).alias("_o")).repartition(F.col(key)).sortWithinPartitions(key, "_t", "_o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import deque

        kept: deque = deque()
        first, at = True, None
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if first or k != at:
                    first, at, kept = False, k, deque()
                while kept and kept[0] <= t - window_s:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.bool_())], names=[key, order, "admitted"])

    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, admitted boolean")


def offered_load(df: DataFrame, key: str, seconds: Column, window_s: int, order: str) -> DataFrame:
    """Requests of the key within the window before each request, itself included (rejected ones too)."""
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-(window_s - 1), 0)
    return df.select(key, order, F.count("*").over(w).alias("offered"))
