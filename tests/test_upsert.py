from corpuskiln.streaming import jobs


def test_each_version_holds_what_earlier_batches_wrote(spark, tmp_path):
    base, out = str(tmp_path / "base"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(base)
    write = jobs.upsert_into(base, out, ["id"])
    for epoch, row in enumerate([(1, "A"), (2, "B"), (3, "C")]):
        write(spark.createDataFrame([row], "id long, v string"), epoch)
    write(spark.createDataFrame([(2, "B")], "id long, v string"), 1)  # a batch that runs again
    read = lambda n: sorted((r.id, r.v) for r in spark.read.parquet(f"{out}/version={n}").collect())
    assert [read(n) for n in range(3)] == [[(1, "A"), (2, "b")], [(1, "A"), (2, "B")], [(1, "A"), (2, "B"), (3, "C")]]
    assert jobs.newest_version(spark, out, 9) == 2 and jobs.newest_version(spark, out, 0) is None
