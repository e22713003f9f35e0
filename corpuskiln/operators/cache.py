"""An answer cache in the data flow: a bounded least-recently-used cache with expiry, as a batch fold and as a stream.

Requests are dealt by their key to ``parts`` caches of ``most`` entries each. A hit is answered by the request that made the entry
and does not prolong it; an entry older than ``ttl_s`` is a miss and made anew; where a cache is full the entry that was
used longest ago goes. Requests that may not be cached are answered by themselves and leave no entry.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TTL_S = 86_400.0
MOST = 1_000
PARTS = 64

# Words of questions whose answers change with time; such questions are not cached.
FRESH_WORDS = ["dzisiaj", "dziś", "teraz", "aktualnie", "ostatnio", "wczoraj", "w tym roku", "od kiedy", "do kiedy", "kiedy", "current", "now", "today"]


class Entries:
    """One cache: entries in order of use, each with its time and the request that made it."""

    def __init__(self, ttl_s: float, most: int, held: list[tuple[str, float, int]] = ()):
        self.ttl_s, self.most = ttl_s, most
        self.held: OrderedDict[str, tuple[float, int]] = OrderedDict((k, (t, i)) for k, t, i in held)

    def ask(self, key: str, t: float, request: int) -> int:
        """The request that answers this one."""
        found = self.held.get(key)
        if found is not None and t - found[0] <= self.ttl_s:
            self.held.move_to_end(key)
            return found[1]
        self.held[key] = (t, request)
        self.held.move_to_end(key)
        if len(self.held) > self.most:
            self.held.popitem(last=False)
        return request

    def expire(self, t: float) -> None:
        for k in [k for k, (made, _) in self.held.items() if t - made > self.ttl_s]:
            del self.held[k]


def _dealt(requests: DataFrame, key: Column, seconds: Column, request: Column, cacheable: Column, parts: int) -> DataFrame:
    return requests.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), key.alias("key"), seconds.cast("double").alias("t"), request.cast("long").alias("request"), F.coalesce(cacheable, F.lit(False)).alias("cacheable"))


def through_cache(requests: DataFrame, key: Column, seconds: Column, request: Column, cacheable: Column, ttl_s: float = TTL_S, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(request, answered_by, hit) of all requests, in order of (seconds, request). A part's rows are sorted by Spark and folded batch
    by batch; a task holds the entries of one cache."""
    rows = _dealt(requests, key, seconds, request, cacheable, parts)
    # what may not be cached meets no cache, so it needs no exchange
    free = rows.filter("not cacheable").select("request", F.col("request").alias("answered_by"))
    kept = rows.filter("cacheable").drop("cacheable").repartition("part").sortWithinPartitions("part", "t", "request")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cache = None, Entries(ttl_s, most)
        for b in batches:
            out = []
            for p, k, t, r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if p != at:
                    at, cache = p, Entries(ttl_s, most)
                out.append(cache.ask(k, t, r))
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(out, pa.int64())], names=["request", "answered_by"])

    return kept.mapInArrow(run, "request long, answered_by long").unionByName(free).withColumn("hit", F.col("request") != F.col("answered_by"))


class CacheProcessor(StatefulProcessor):
    """The same cache over a stream of parts: its entries are state, a timer takes out what has expired."""

    def __init__(self, ttl_s: float, most: int):
        self.ttl_s, self.most = ttl_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "keys array<string>, made array<double>, requests array<long>")

    def _load(self) -> Entries:
        held = self.entries.get() if self.entries.exists() else None
        return Entries(self.ttl_s, self.most, [] if held is None else list(zip(*(list(x) for x in held), strict=True)))

    def _store(self, cache: Entries) -> None:
        if cache.held:
            made = [t for t, _ in cache.held.values()]
            self.entries.update((list(cache.held), made, [r for _, r in cache.held.values()]))
            self.handle.registerTimer(int((min(made) + self.ttl_s) * 1000) + 1)
        else:
            self.entries.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cache = self._load()
        asked = pd.concat(list(rows)).sort_values(["t", "request"])
        by = [cache.ask(k, t, r) if c else r for k, t, r, c in zip(asked["key"], asked["t"], asked["request"].tolist(), asked["cacheable"], strict=True)]
        self._store(cache)
        yield pd.DataFrame({"request": asked["request"], "answered_by": by})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cache = self._load()
        cache.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._store(cache)
        yield pd.DataFrame({"request": pd.Series(dtype="int64"), "answered_by": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def stream_through_cache(requests: DataFrame, key: Column, ts: str, request: Column, cacheable: Column, ttl_s: float = TTL_S, most: int = MOST, parts: int = PARTS, lateness: str = "1 minute") -> DataFrame:
    """``through_cache`` over a stream with event time ``ts``; needs the RocksDB state store. Each batch is taken in order of time."""
    marked = requests.withWatermark(ts, lateness)
    seconds = F.unix_micros(F.col(ts)) / 1e6
    rows = marked.select(F.col(ts), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), key.alias("key"), seconds.alias("t"), request.cast("long").alias("request"), F.coalesce(cacheable, F.lit(False)).alias("cacheable"))
    out = rows.groupBy("part").transformWithStateInPandas(CacheProcessor(ttl_s, most), "request long, answered_by long", "Append", "EventTime")
    return out.withColumn("hit", F.col("request") != F.col("answered_by"))


def answered(requests: DataFrame, request: str, cached: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers of all requests: only those that no entry answers go through ``answer`` ((request, ...) -> (request, answer columns))."""
    asked = requests.join(cached.filter("not hit").select(F.col("request").alias(request)), request, "left_semi")
    made = answer(asked).withColumnRenamed(request, "answered_by")
    return cached.join(made, "answered_by").withColumnRenamed("request", request)
