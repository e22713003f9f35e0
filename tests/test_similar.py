import numpy as np
import pytest

from corpuskiln.operators import search as S


@pytest.mark.parametrize("held,part", [(3, 7), (1000, 1000)])
def test_tiles_give_all_pairs(spark, monkeypatch, held, part):
    """The same pairs whatever the groups of queries and parts of the corpus; null vectors are left out, zero ones score 0."""
    monkeypatch.setattr(S, "QUERIES_HELD", held)
    monkeypatch.setattr(S, "CORPUS_PART", part)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 5))
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    corpus = spark.createDataFrame([*rows, (99, None)], "point_id long, vec array<double>")
    asked = spark.createDataFrame([*rows[:11], (98, None)], "query_id long, vec array<float>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {(i, j): u[i] @ u[j] for i in range(11) for j in range(30)}
    got = {(r.query_id, r.point_id): r.score for r in S.similar_pairs(asked, corpus).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    near = S.similar_pairs(asked, corpus, least=0.5).collect()
    assert len(near) == sum(v >= 0.5 for v in got.values())
    best = {(r.query_id, r.point_id) for r in S.similar_pairs(asked, corpus, top=4).collect()}
    assert best == {(i, j) for i in range(11) for j in sorted(range(30), key=lambda j: (-got[i, j], j))[:4]}


def test_no_queries(spark):
    empty = spark.createDataFrame([], "query_id long, vec array<double>")
    assert S.similar_pairs(empty, spark.createDataFrame([(1, [1.0])], "point_id long, vec array<double>"), top=3).count() == 0


def _labelled(spark, n=40, queries=17, seed=9):
    """Vectors of small whole numbers (many equal scores) with labels, some of them null."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (n, 3)).astype(float)
    x[3] = x[4]
    label = [None if i % 9 == 0 else i % 4 for i in range(n)]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return rows, label, np.round(u[:queries] @ u.T, 9)


@pytest.mark.parametrize("held,part,batch", [(3, 7, 5), (1000, 1000, 1000)])
def test_best_of_each_kind(spark, monkeypatch, held, part, batch):
    """The best of each query in each kind, whatever the tiles and batches; tasks hand on fewer rows than there are pairs."""
    monkeypatch.setattr(S, "QUERIES_HELD", held)
    monkeypatch.setattr(S, "CORPUS_PART", part)
    rows, label, score = _labelled(spark)
    corpus = spark.createDataFrame(rows, "point_id long, vec array<double>, kind int")
    asked = spark.createDataFrame([r[:2] for r in rows[:17]], "query_id long, vec array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = S.similar_pairs(asked, corpus, top=2, kinds="each").selectExpr("query_id", "point_id", "kind", "round(score, 9) score").collect()
        own = S.similar_pairs(asked.join(corpus.selectExpr("point_id query_id", "kind"), "query_id").filter("kind is not null"), corpus.filter("kind is not null"), kinds="own").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for q in range(17):
        for k in {*label}:
            want = sorted((-score[q, p] for p in range(40) if label[p] == k))[:2]
            assert sorted(-r.score for r in got if r.query_id == q and r.kind == k) == pytest.approx(want)
    assert len(own) == sum(label[q] == label[p] and label[q] is not None for q in range(17) for p in range(40))
    assert all(abs(r.score - score[r.query_id, r.point_id]) < 1e-6 for r in own)


@pytest.mark.parametrize("held,part", [(3, 7), (1000, 1000)])
def test_best_query_of_each_owner(spark, monkeypatch, held, part):
    """For each point the best other query of each owner, ties by the least query, and one row of a point and owner from a task."""
    monkeypatch.setattr(S, "QUERIES_HELD", held)
    monkeypatch.setattr(S, "CORPUS_PART", part)
    rows, label, score = _labelled(spark)
    corpus = spark.createDataFrame([r[:2] for r in rows], "point_id long, vec array<double>")
    asked = spark.createDataFrame(rows[:17], "query_id long, vec array<double>, kind int")
    for least in (None, 0.45):
        want = {}
        for p in range(40):
            for k in {*label[:17]}:
                met = [(-score[q, p], q) for q in range(17) if label[q] == k and q != p and (least is None or score[q, p] >= least)]
                if met:
                    want[p, k] = min(met)[1]
        assert {(r.point_id, r.kind): r.query_id for r in S.best_queries(asked, corpus, least).collect()} == want


def test_hits_of_kinds_rank_no_pairs(spark, sf, monkeypatch):
    """fanout_topk and compare_panels rank what tasks kept of each kind, cosine_columns multiplies tiles: before, all pairs were sorted or folded one by one."""
    from corpuskiln.plans import search_queries as Q

    asked = []
    real = S.scores_of_tiles
    monkeypatch.setattr(S, "scores_of_tiles", lambda *a, **k: asked.append((a[3] if len(a) > 3 else k.get("top"), k.get("kinds"))) or real(*a, **k))
    Q.fanout_topk(spark, sf), Q.compare_panels(spark, sf), Q.cosine_columns(spark, sf)
    assert asked == [(5, "each"), (6, "each"), (None, "own")]
    assert "Join" not in Q.variant_merge(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_null_vectors_have_null_scores(spark, tmp_path):
    """cosine_columns keeps the pairs of null and zero vectors, as its SQL does."""
    from corpuskiln.plans.search_queries import cosine_columns

    rows = [(0, [1.0, 0.0], 1), (20, None, 1), (3, None, 1), (4, [1.0, 1.0], 1), (5, [1.0, 1.0], None), (40, [0.0, 1.0], None), (6, [0.0, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.point_id): r.score for r in cosine_columns(spark, str(tmp_path)).collect()}
    assert np.isnan(got.pop((0, 6)))
    assert got == {(0, 0): 1.0, (0, 20): None, (0, 3): None, (0, 4): 0.707107, (20, 6): None, **{(20, p): None for p in (0, 20, 3, 4)}}
