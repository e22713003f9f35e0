import numpy as np
import pytest

from corpuskiln.operators import search as S
from corpuskiln.operators.dense import DenseIndex

POINT, QUERY = "point_id long, vec array<double>, kind int", "query_id long, vec array<double>"


def _brute(rows, queries, top, keep=lambda kind: True):
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(v), 1e-300)
    out = {}
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(w)), 6), p) for p, w, k in rows if keep(k))
        out[q] = [(p, -s) for s, p in scored[:top]]
    return out


def _found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.point_id, round(r.score, 6)))
    return out


@pytest.fixture(scope="module")
def data():
    """Clusters, a third of all rows equal (one hot cell), and zero vectors."""
    rng = np.random.default_rng(5)
    heads = rng.standard_normal((12, 6))
    rows = [(i, np.round(heads[i % 12] + 0.3 * rng.standard_normal(6), 2).tolist(), i % 3) for i in range(240)]
    rows += [(1000 + i, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0], i % 3) for i in range(120)] + [(2000, [0.0] * 6, 0), (2001, [0.0] * 6, 1)]
    queries = [(i, rows[i][1]) for i in range(0, 360, 20)] + [(900, [0.0] * 6), (901, (-heads[0]).tolist())]
    return rows, queries


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    bad = [(3000, None, 0), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (3002, [float("nan")] * 6, 0), (3003, [float("inf")] * 6, 0), (3004, [], 0)]
    return DenseIndex.build(spark.createDataFrame([*data[0], *bad], POINT), str(tmp_path_factory.mktemp("dense") / "i"), cell_rows=20)


@pytest.mark.parametrize("part", [25, 10_000])
def test_exact_search_is_brute_force(spark, data, index, monkeypatch, part):
    """Whatever parts a hot cell is dealt to: equal vectors tie by id, zero vectors score 0, unusable rows are not found."""
    monkeypatch.setattr(S, "CORPUS_PART", part)
    rows, queries = data
    asked = spark.createDataFrame([*queries, (902, None), (903, [])], QUERY)
    assert len(index.stats) > 8
    assert _found(index.search(asked, 7)) == _brute(rows, queries, 7)
    even = index.search(asked, 7, where=[(S.F.col("kind") == 0)])
    assert _found(even) == _brute(rows, queries, 7, lambda k: k == 0)


def test_more_asked_than_there_is(spark, data, index):
    rows, queries = data
    got = _found(index.search(spark.createDataFrame(queries[:2], QUERY), 500))
    assert all(len(v) == len(rows) for v in got.values())


def test_recall_and_probes(spark, data, index):
    rows, queries = data
    asked = spark.createDataFrame(queries, QUERY)
    found, n = index.recall(asked, 5, len(index.stats))
    assert (found, n) == (5 * len(queries), 5 * len(queries))
    probes, found, n = index.tuned(asked, 5)
    assert found >= 0.95 * n
    assert index.recall(asked, 5, 1)[0] < n
    some = _found(index.search(asked, 5, probes=1))
    assert all(len(v) <= 5 for v in some.values())


def test_only_probed_cells_are_read(spark, data, index):
    plan = index.search(spark.createDataFrame(data[1][:1], QUERY), 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "cell" in plan.split("PartitionFilters")[1][:200]


def test_add_keeps_old_rows_and_finds_far_ones(spark, data, tmp_path):
    rows, _ = data
    index = DenseIndex.build(spark.createDataFrame(rows[:100], POINT), str(tmp_path / "i"), cell_rows=10)
    before = index.stats
    new = [(0, [9.0] * 6, 0), (5000, (-np.array(rows[0][1])).tolist(), 1), (5001, [0.0] * 6, 1)]
    index.add(spark.createDataFrame(new, POINT))
    index.add(spark.createDataFrame(new, POINT))  # again: nothing
    assert index.rows().count() == 102 and sum(n for _, n in index.stats.values()) == 102
    assert all(index.stats[c][0] >= r for c, (r, _) in before.items())
    queries = [(1, new[1][1]), (2, rows[3][1])]
    assert _found(index.search(spark.createDataFrame(queries, QUERY), 4)) == _brute(rows[:100] + new[1:], queries, 4)


def test_empty_and_zero_tables(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], QUERY)
    none = DenseIndex.build(spark.createDataFrame([], POINT), str(tmp_path / "none"))
    assert none.search(asked, 3).count() == 0
    zero = DenseIndex.build(spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0)], POINT), str(tmp_path / "zero"))
    assert _found(zero.search(asked, 3)) == {1: [(1, 0.0), (2, 0.0)]}


def test_vectors_of_two_widths_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="one number of components"):
        DenseIndex.build(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0], 0)], POINT).coalesce(1), str(tmp_path / "w"))


def test_rows_meet_cells_in_strips(spark, tmp_path, monkeypatch):
    """No matrix of a batch's rows by all cells: what a task holds does not grow with the number of cells. The results are the same."""
    import pyarrow as pa

    from corpuskiln.operators import dense

    b = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["x"])
    parts = list(dense._strips(b, 4097))
    assert sum(p.num_rows for p in parts) == 10_000 and max(p.num_rows for p in parts) * 4097 * 8 <= 1 << 21
    monkeypatch.setattr(S, "PAIRS_HELD", 8)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist(), i % 2) for i in range(90)]
    index = DenseIndex.build(spark.createDataFrame(rows, POINT), f"{tmp_path}/index", cell_rows=10)
    queries = [(i, v) for i, v, _ in rows[:12]]
    assert _found(index.search(spark.createDataFrame(queries, QUERY), 5)) == _brute(rows, queries, 5)


def test_tuning_compares_all_pairs_once(spark, data, index, monkeypatch):
    """What tuning counts for its probes is what a search with as many probes finds, and a smaller number is too few."""
    asked = spark.createDataFrame(data[1][:-1], QUERY)  # the last one's last hits are equal rows
    pairs, calls = S.similar_pairs, []
    monkeypatch.setattr(S, "similar_pairs", lambda *a, **b: calls.append(a) or pairs(*a, **b))
    probes, found, n = index.tuned(asked, 5, least=0.99)
    assert len(calls) == 1
    assert probes > 2 and found >= 0.99 * n
    assert (found, n) == index.recall(asked, 5, probes)
    assert index.recall(asked, 5, probes // 2)[0] < 0.99 * n


def test_tuning_of_empty_and_zero_tables(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], QUERY)
    none = DenseIndex.build(spark.createDataFrame([], POINT), str(tmp_path / "none"))
    assert none.tuned(asked, 3)[1:] == (0, 0)
    zero = DenseIndex.build(spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0)], POINT), str(tmp_path / "zero"))
    assert zero.tuned(asked, 3) == (1, 4, 4)
