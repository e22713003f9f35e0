import numpy as np

from corpuskiln.llm import neighbours
from corpuskiln.llm.common import connected


def test_recall_and_cases(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 32))
    for c in range(12):
        x[c * 20 : c * 20 + 20] = x[c * 20] + 0.15 * rng.standard_normal((20, 32))
    x[599] = x[598]
    data = [(i, [float(v) for v in x[i].astype(np.float32)]) for i in range(600)]
    odd = [(700, None), (701, [0.0] * 32), (702, [1.0, None] + [0.0] * 30), (703, [float("nan")] * 32), (704, []), (705, [1.0, 2.0]), (706, [2.0, 4.0]), (None, data[0][1])]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame([*data, *odd], "vec_id long, embedding array<float>")).collect()}
    u = np.array([d[1] for d in data])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(got[i].n_links for i in range(600))
    assert found <= s.sum() and found >= 0.9 * s.sum()
    assert got[598].component_id == got[599].component_id and got[598].n_links >= 1
    for i in (700, 701, 702, 703, 704):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[706].component_id == 705 and got[706].n_links == 1 and not got[706].kept
    assert got[None].component_id is None and not got[None].kept


def test_recall_of_lone_pairs_in_a_crowded_cone(spark):
    """A third of all rows lie in a cone (cosine about 0.7 to each other); pairs at 0.905 are the only links."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre, n = unit(rng.standard_normal(64)), 6000
    x = unit(rng.standard_normal((n, 64)))
    x[: n // 3] = unit(np.sqrt(0.7) * centre + np.sqrt(0.3) * x[: n // 3])
    for i in [*range(0, 600, 2), *range(n // 3, n // 3 + 600, 2)]:
        aside = rng.standard_normal(64)
        aside = unit(aside - (aside @ x[i]) * x[i])
        x[i + 1] = 0.905 * x[i] + np.sqrt(1 - 0.905**2) * aside
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(frame, passes=6, window=16).collect()}
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    for lo, hi in ((0, n // 3), (n // 3, n)):
        assert s[lo:hi].sum() >= 0.9 * 600 and sum(got[i] for i in range(lo, hi)) >= 0.9 * s[lo:hi].sum()
    assert all(got[i] <= s[i].sum() for i in range(n))


def test_vectors_of_equal_bytes_but_other_lengths_stay_alone(spark):
    two = np.array([1.0, 1.5], dtype=np.float32)
    one = two.view(np.float64)  # the same eight bytes as one component
    frame = spark.createDataFrame([(1, [float(v) for v in two]), (2, [float(one[0])])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(frame).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_empty_table(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200, 150), (150, 199), (300, 300)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[199] == got[200] == got[150] == 150 and 300 not in got
