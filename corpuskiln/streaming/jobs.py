"""Structured Streaming jobs: admission, micro-batches with overlap, keyed counters, daily windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskiln.operators.state import merge_by_key, unseen
from corpuskiln.operators.versions import IndexVersions


def admission(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: float) -> DataFrame:
    """Sliding-window rate limit per key, exact across batches: only admitted times are kept as state.

    ``ts`` is epoch seconds; input of one batch is taken in order of (ts, order)."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values([ts, order])
        out = []
        for t, o in zip(rows[ts], rows[order], strict=True):
            kept = [x for x in kept if x > t - window_s]
            ok = len(kept) < limit
            if ok:
                kept.append(float(t))
            out.append((k[0], o, ok))
        state.update((kept,))
        yield pd.DataFrame(out, columns=[key, order, "admitted"])

    kind = lambda c: events.schema[c].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind(key)}, {order} {kind(order)}, admitted boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def overlapping_batches(changes: DataFrame, key: str, modified: str, lateness: str = "8 days") -> DataFrame:
    """Each change once although slices overlap: state lives as long as a repeat may come."""
    return changes.withWatermark(modified, lateness).dropDuplicatesWithinWatermark([key])


def counters(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def daily(events: DataFrame, ts: str, *keys: str, lateness: str = "1 day") -> DataFrame:
    """Closed days only, one row per key and day."""
    w = events.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def incremental_index(raw: DataFrame, chunk: Callable[[DataFrame], DataFrame], index_path: str, checkpoint: str) -> StreamingQuery:
    """Available files through ``chunk`` into an index of Parquet versions: only new or changed points are written, and a
    replayed batch writes its own folder again, so a batch counts once whatever fails."""
    keys = ["point_id", "text_hash"]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = chunk(batch).dropDuplicates(["point_id"])
        old = [f"{index_path}/batch={i}" for i in range(epoch)]
        new = unseen(rows, spark.read.parquet(*old), keys) if old else rows
        new.write.mode("overwrite").parquet(f"{index_path}/batch={epoch}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_index(spark, index_path: str) -> DataFrame:
    """Current point of each id over all batches."""
    rows = spark.read.option("basePath", index_path).parquet(index_path)
    return rows.groupBy("point_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "point_id"]), "batch").alias("r")).select("point_id", "r.*").drop("batch")


def versioned_index(raw: DataFrame, chunk: Callable[[DataFrame], DataFrame], index: IndexVersions, checkpoint: str) -> StreamingQuery:
    """As ``incremental_index``, into an index with committed versions: an epoch of this checkpoint counts once, several streams
    may feed one index, and what an epoch reads does not grow with the epochs before it."""

    def write(batch: DataFrame, epoch: int) -> None:
        replace(index, spark=batch.sparkSession).upsert(chunk(batch), checkpoint, epoch)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark, out_path: str, before: int) -> int | None:
    """The greatest finished version under ``out_path`` that is less than ``before``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/version=*/_SUCCESS"))
    found = [int(f.getPath().getParent().getName().partition("=")[2]) for f in done or []]
    return max((v for v in found if v < before), default=None)


def upsert_into(base_path: str, out_path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the newest earlier version (at first: base) merged with the batch as a new version.

    A batch that runs again starts from the same earlier version, so it gives the same rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = newest_version(spark, out_path, epoch)
        base = spark.read.parquet(base_path if last is None else f"{out_path}/version={last}")
        merge_by_key(base, batch.dropDuplicates(keys), keys).write.mode("overwrite").parquet(f"{out_path}/version={epoch}")

    return write
