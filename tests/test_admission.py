"""Admission of a key that holds most events."""

import random

from corpuskiln.operators import state


def test_large_key_goes_batch_by_batch(spark):
    rng = random.Random(5)
    data = [(1 if rng.random() < 0.8 else rng.choice((2, 3, None)), float(rng.randrange(4000)), i) for i in range(6000)]
    df = spark.createDataFrame(data, "k long, t double, o long").repartition(7)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = state.admit(df, "k", "t", 3, 10.0, "o")
        got = {r.o: (r.k, r.admitted) for r in out.collect()}
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want, kept = {}, {}
    for k, t, o in sorted(data, key=lambda r: r[1:]):
        live = kept[k] = [x for x in kept.get(k, []) if x > t - 10.0]
        want[o] = (k, len(live) < 3)
        if want[o][1]:
            live.append(t)
    assert got == want and len({a for _, a in got.values()}) == 2
    assert "collect_list" not in plan  # no key is one row
