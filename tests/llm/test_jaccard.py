import re

import pytest

from corpuskiln.llm import jaccard

from .fixtures import rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(data):
    sets = []
    for i, t in data:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def test_against_brute_force(spark):
    data = rows()
    got = jaccard.jaccard_components(table(spark, data)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)


def test_many_near_copies_and_sizes(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
        data.append((i, " ".join(w[: rng.randint(60, 90)])))
    got = jaccard.jaccard_components(table(spark, data)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)


def test_empty_table(spark):
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_divide_skip_counts():
    import numpy as np

    rng = np.random.default_rng(5)
    lists = {h: np.unique(rng.integers(0, 40, rng.integers(1, 40))) for h in range(30)}
    for need in (3, 10, 20):
        cand, count = jaccard.divide_skip(np.arange(30, dtype=np.uint64), need, lists)
        all_ = np.bincount(np.concatenate(list(lists.values())), minlength=40)
        assert dict(zip(cand.tolist(), count.tolist(), strict=True)) == {i: int(c) for i, c in enumerate(all_) if c >= need}


def test_documents_that_share_nothing(spark):
    for data in ([(1, "one two three four five six")], [(1, "a b c d e f"), (2, "g h i j k l m")], [(1, None), (2, "")]):
        got = jaccard.jaccard_components(table(spark, data).repartition(13)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)


def test_stars_with_several_components(spark, monkeypatch):
    """Texts of one template whose fillings differ: stars hold several components, larger than a block."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    data = []
    for i in range(90):
        base = [f"t{k}" for k in range(40)]
        kind = rng.randint(0, 6)
        base[20:20] = [f"k{kind}_{k}" for k in range(12 + kind % 3)]
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = f"e{rng.randint(0, 5)}"
        data.append((i, " ".join(base)))
    got = jaccard.jaccard_components(table(spark, data)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)


def test_smaller_set_in_the_later_class(spark):
    """A lone pair links whichever of its sets is smaller, and whichever comes first."""
    long = " ".join(f"w{i}" for i in range(60))
    short = " ".join(f"w{i}" for i in range(58))
    for texts in ([long, short], [short, long]):
        got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
        assert [r.component_id for r in got] == [0, 0]


def test_equals_sql(spark, sf):
    """The query's whole result against its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from corpuskiln.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op5_divide_skip_jaccard", "op6_bucket_pointer_dedup", "op10_quality_ledger"):
        want = con.sql(ORACLE[name])
        columns = want.columns
        assert sorted(map(tuple, QUERIES[name](spark, sf).select(*columns).collect())) == sorted(want.fetchall()), name


def test_classes_that_can_link_with_none_are_left_out(spark):
    """Copies of one text with too many words of their own share its rarest shingles, and are neither in a star nor searched for."""
    import random

    from corpuskiln.llm.shared import shared_features

    rng = random.Random(2)
    data = []
    for i in range(60):
        w = [f"t{k}" for k in range(300)]
        for at in rng.sample(range(0, 300, 5), 1 if i < 12 else 11):
            w[at] = f"own{i}_{at}"
        data.append((i, " ".join(w)))
    _, sets = shared_features(table(spark, data), jaccard.shingle_features(), lambda m, n: 100 * m >= 75 * n)
    sets = sets.selectExpr("*", "monotonically_increasing_id() AS cls").localCheckpoint()
    assert sets.filter("7 * m < 6 * n").count() > 20
    far = sets.filter("7 * m < 6 * n").select("cls").join(jaccard.stars(sets), "cls")
    assert far.count() == 0
    got = jaccard.jaccard_components(table(spark, data)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)


def test_a_query_that_can_link_with_none_is_not_searched_for(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "divide_skip", None)
    v = np.arange(80, dtype=np.uint64)
    block = jaccard.Block(np.array([5]), np.array([100]), np.array([5]), [v.tobytes()], np.array([5, 6]))
    assert block.links(100, 6, v) == []  # at most 80 of 120
    assert block.links(100, 5, np.arange(100, dtype=np.uint64)) == []  # the same component
