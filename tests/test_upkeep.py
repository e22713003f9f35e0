import time

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import analytics, sketches
from corpuskiln.operators.versions import Busy, IndexVersions, run_steps
from corpuskiln.plans.enrich import context_prefixes, with_prefix
from corpuskiln.plans.hops import multi_hop
from corpuskiln.streaming import jobs


def frame(spark, rows):
    return spark.createDataFrame([(i, f"h{v}", v) for i, v in rows], "point_id long, text_hash string, text string")


def held(index, number=None):
    return sorted((r.point_id, r.text) for r in index.rows(number).collect())


def test_versions_are_read_whole_and_an_epoch_counts_once(spark, tmp_path):
    index = IndexVersions(spark, str(tmp_path / "index"), buckets=4)
    with pytest.raises(FileNotFoundError):
        index.rows()
    index.upsert(frame(spark, [(1, "a"), (2, "b"), (2, "c")]), "s", 0)
    assert held(index) == [(1, "a"), (2, "c")]
    index.upsert(frame(spark, [(1, "a"), (2, "d"), (None, "n")]), "s", 1)
    index.upsert(frame(spark, [(1, "z")]), "s", 1)  # committed already
    index.upsert(frame(spark, [(3, "e")]), "other", 0)  # an epoch of another source
    rows = {r.point_id: r.text for r in index.rows().collect()}
    assert rows == {1: "a", 2: "d", None: "n", 3: "e"}
    assert held(index, 0) == [(1, "a"), (2, "c")]
    before = index.manifest()["folders"]
    assert index.upsert(frame(spark, [(1, "a"), (3, "e")]))["folders"] == before  # nothing new, no folder
    assert index.upsert(frame(spark, []))["folders"] == before


def test_deltas_are_merged_so_that_a_write_reads_few_folders(spark, tmp_path):
    index = IndexVersions(spark, str(tmp_path / "index"), buckets=2, most_deltas=3)
    want = {}
    for epoch in range(9):
        index.upsert(frame(spark, [(epoch % 4, f"v{epoch}"), (100 + epoch, "x")]), "s", epoch)
        want |= {epoch % 4: f"v{epoch}", 100 + epoch: "x"}
        assert len(index.manifest()["folders"]) <= 3
    assert dict(held(index)) == want
    assert len(index.compact()["folders"]) == 1 and dict(held(index)) == want
    assert index.clean(keep=1) > 0 and dict(held(index)) == want


def test_a_killed_write_leaves_the_version_before_and_a_missing_folder_is_named(spark, tmp_path, monkeypatch):
    index = IndexVersions(spark, str(tmp_path / "index"), buckets=2)
    index.upsert(frame(spark, [(1, "a")]), "s", 0)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(IndexVersions, "_commit", killed)
        with pytest.raises(RuntimeError, match="killed"):
            index.upsert(frame(spark, [(1, "b")]), "s", 1)
    assert held(index) == [(1, "a")]
    index.upsert(frame(spark, [(1, "b")]), "s", 1)  # the epoch runs again
    assert held(index) == [(1, "b")]
    assert index.clean(keep=2) == 1  # the folder that no version names
    name = index.manifest()["folders"][0]
    (tmp_path / "index" / name).rename(tmp_path / "gone")
    with pytest.raises(FileNotFoundError, match=name):
        index.rows()


def test_one_writer_at_a_time_until_its_lease_ends(spark, tmp_path):
    index = IndexVersions(spark, str(tmp_path / "index"))
    with index.writer():
        with pytest.raises(Busy):
            index.upsert(frame(spark, [(1, "a")]))
    index._write_text("writer.lock", "", overwrite=False)  # a writer that died
    time.sleep(1.1)
    IndexVersions(spark, index.place, lease_s=1).upsert(frame(spark, [(1, "a")]))
    assert held(index) == [(1, "a")]


def test_a_stream_feeds_the_versions(spark, tmp_path):
    schema, index = "point_id long, text string", IndexVersions(spark, str(tmp_path / "index"), buckets=2)

    def feed(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "raw" / name))
        raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "raw"))
        jobs.versioned_index(raw, lambda b: b.withColumn("text_hash", F.md5("text")), index, str(tmp_path / "ck")).awaitTermination()

    feed("a", [(1, "one"), (2, "two")])
    feed("b", [(2, "two"), (3, "three"), (1, "uno")])
    assert held(index) == [(1, "uno"), (2, "two"), (3, "three")]
    newest = index.manifest()
    assert list(newest["epochs"].values()) == [1] and spark.read.parquet(f"{index.place}/{newest['folders'][-1]}").count() == 2


def test_steps_stop_at_the_first_failure():
    ran = []

    def fail():
        raise ValueError("no file")

    got = run_steps([("fetch", lambda: ran.append(1)), ("preprocess", fail), ("ingest", lambda: ran.append(2))])
    assert got == [("fetch", True, ""), ("preprocess", False, "ValueError: no file")] and ran == [1]


def test_merged_sketches_are_near_the_exact_figures(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), (F.xxhash64("id") % 9000).alias("user"), F.rand(1).alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows = rows.unionByName(spark.sql("SELECT 'nulls' AS k, CAST(NULL AS bigint) AS user, CAST(NULL AS double) AS v, CAST(NULL AS timestamp) AS ts"))
    whole = sketches.merged(sketches.by_day(rows, "ts", ["k"], "user", F.col("v")), ["k"])
    exact = {r.k: r for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user").alias("users")).collect()}
    got = whole.select("k", "n", sketches.distinct_count("items").alias("users"), F.when(F.col("k") != "nulls", sketches.quantile("values", 0.5)).alias("mid")).collect()
    assert {r.k for r in got} == set(exact)
    for r in got:
        assert r.n == exact[r.k].n and abs(r.users - exact[r.k].users) <= 0.08 * exact[r.k].users
        assert r.mid is None if r.k == "nulls" else abs(r.mid - 0.5) < 0.06
    bins = sketches.histogram(whole.filter("k = 'hot'"), "values", "n", [-1.0, 0.25, 0.5, 2.0]).collect()
    n = exact["hot"].n
    assert [r.up_to for r in bins] == [0.25, 0.5, 2.0] and all(abs(r.approx_n - s * n) < 0.05 * n for r, s in zip(bins, (0.25, 0.25, 0.5), strict=True))


def test_json_elements_skip_what_is_no_list(spark):
    logs = ['[{"type": "a"}, {"type": "b"}, 3, null, {"x": 1}]', '[{"type": ""}]', "[{", None, '{"type": "c"}', '"a"', "[]", '[{"type": "a"}]', '[{"type": "old"}]']
    df = spark.createDataFrame(list(enumerate(logs)), "i int, logs string")
    assert {r.type: r.n for r in analytics.json_elements(df, "logs", [F.asc("i")], 8, "type").collect()} == {"a": 2, "b": 1}


def test_prefixes_resume_and_take_failures_again(spark):
    chunks = spark.createDataFrame([(1, "T", "one"), (2, None, "bad"), (3, "U", None)], "point_id long, title string, text string")
    calls = "One. Two! Three?"

    def first(title, text):
        if text == "bad":
            raise RuntimeError("model")
        return f"{title}: {calls}"

    got = {r.point_id: (r.prefix, r.failed) for r in context_prefixes(chunks, None, first).collect()}
    assert got == {1: ("T: One. Two!", False), 2: ("", True), 3: ("U: One. Two!", False)}
    done = spark.createDataFrame([(i, p, f) for i, (p, f) in got.items()], "point_id long, prefix string, failed boolean")
    again = context_prefixes(chunks, done, lambda title, text: "no end")
    assert [(r.point_id, r.prefix, r.failed) for r in again.collect()] == [(2, "no end", False)]
    shown = {r.point_id: r.embed_text for r in with_prefix(chunks, done).collect()}
    assert shown == {1: "T: One. Two!\n\none", 2: "bad", 3: "U: One. Two!"}


def test_hops_end_with_the_budget_or_when_nothing_is_new(spark):
    """Text i leads to text i + 1; question 1 is simple, 2 complex, 3 complex with long texts, 4 runs in a circle."""
    links = {"a0": "a1", "b0": "b1", "b1": "b2", "b2": "b3", "c0": "c1" * 20, "c1" * 20: "c2", "d0": "d1", "d1": "d0", "d0 ": "d1"}
    table = spark.createDataFrame([(t, n) for t, n in links.items()], "asked string, found string")
    points = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(set(links.values())))], "point_id long, found string")

    def search(asked):
        hits = asked.join(table, asked.text == table.asked).join(points, "found")
        return hits.select("query_id", "point_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.col("found").alias("text"))

    questions = spark.createDataFrame([(1, "b0", "simple"), (2, "b0", "complex"), (3, "c0", "complex"), (4, "d0", "complex")], "query_id long, text string, class string")
    got = multi_hop(questions, search, lambda new: new.select("query_id", "text"), budget=30).join(points, "point_id").collect()
    assert sorted((r.query_id, r.hop, r.found) for r in got) == [(1, 0, "b1"), (2, 0, "b1"), (2, 1, "b2"), (2, 2, "b3"), (3, 0, "c1" * 20), (4, 0, "d1"), (4, 1, "d0")]
    assert multi_hop(questions.filter("false"), search, lambda new: new.select("query_id", "text")).count() == 0
