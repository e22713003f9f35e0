"""The answer cache against a plain simulation, as a batch and as a stream."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import cache

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def trace():
    rng, t, out = random.Random(8), 0, []
    for i in range(600):
        t += rng.choice([0, 1, 5, 20, 90])
        out.append((i, f"question {rng.choice('abcdefgh')}", BEGIN + timedelta(seconds=t), rng.random() > 0.1))
    return out


def plain(rows, ttl, most):
    held, out = OrderedDict(), {}
    for i, q, ts, ok in rows:
        if not ok:
            out[i] = i
            continue
        if q in held and (ts - held[q][0]).total_seconds() <= ttl:
            held.move_to_end(q)
            out[i] = held[q][1]
            continue
        held.pop(q, None)
        held[q] = (ts, i)
        out[i] = i
        if len(held) > most:
            held.popitem(last=False)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, question string, ts timestamp, ok boolean")


@pytest.mark.parametrize(("ttl", "most"), [(300.0, 4), (100.0, 100), (10**6, 3)])
def test_batch_equals_a_simulation(spark, ttl, most):
    rows = trace()
    got = cache.through_cache(table(spark, rows).repartition(5), F.col("question"), F.unix_micros("ts") / 1e6, F.col("id"), F.col("ok"), ttl, most, parts=1)
    assert {r.request: r.answered_by for r in got.collect()} == plain(rows, ttl, most)
    parted = cache.through_cache(table(spark, rows), F.col("question"), F.unix_micros("ts") / 1e6, F.col("id"), F.col("ok"), ttl, 100, parts=7)
    assert {r.request: r.answered_by for r in parted.collect()} == plain(rows, ttl, 10**6)


def test_stream_equals_batch(spark, tmp_path):
    rows = trace()
    for n in range(4):
        table(spark, rows[150 * n : 150 * (n + 1)]).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema("id long, question string, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = cache.stream_through_cache(events, F.col("question"), "ts", F.col("id"), F.col("ok"), 300.0, 4, parts=1, lateness="0 seconds")
        query = out.writeStream.format("memory").queryName("cache_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        got = {r.request: r.answered_by for r in spark.table("cache_out").collect()}
    finally:
        spark.conf.unset(provider)
    assert got == plain(rows, 300.0, 4)


def test_a_hit_does_not_reach_the_answerer(spark):
    rows = trace()[:80]
    cached = cache.through_cache(table(spark, rows), F.col("question"), F.unix_micros("ts") / 1e6, F.col("id"), F.col("ok"), 300.0, 4, parts=1)
    want = plain(rows, 300.0, 4)
    seen = spark.sparkContext.accumulator(0)

    def answer(asked):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                seen.add(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"A{i}" for i in b.column(0).to_pylist()])], names=["id", "answer"])

        return asked.select("id").mapInArrow(run, "id long, answer string")

    got = {r.id: r.answer for r in cache.answered(table(spark, rows), "id", cached, answer).collect()}
    assert got == {i: f"A{by}" for i, by in want.items()}
    assert seen.value == len(set(want.values()))
