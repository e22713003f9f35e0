"""Private collections: only the owner drops partitions, and nothing else is rewritten."""

import os

import pytest

from corpuskiln.sources import sinks


def test_owner_drops_partitions_and_the_others_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "private")
    data = [("ann", "d1", 1, "a"), ("ann", "d/2 :x", 2, "b"), ("bob", "d1", 3, "c")]
    sinks.replace_user_documents(spark.createDataFrame(data, "user_id string, doc_id string, chunk int, text string"), path)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    for caller in (None, "", "bob"):
        with pytest.raises(PermissionError):
            sinks.drop_private(spark, path, caller, "ann")
    assert files() == before
    assert sinks.drop_private(spark, path, "ann", "ann", "d/2 :x") and not sinks.drop_private(spark, path, "ann", "ann", "d/2 :x")
    left = files()
    assert len(left) == len(before) - 1 and left.items() <= before.items()
    assert sinks.drop_private(spark, path, "ann", "ann")
    assert [r.text for r in spark.read.parquet(path).collect()] == ["c"]
    assert not sinks.drop_private(spark, path, "eve", "eve")
