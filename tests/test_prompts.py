import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import display as D
from corpuskiln.operators import account as A
from corpuskiln.operators import search as S
from corpuskiln.plans.retrieve import Retriever
from corpuskiln.registry import QUERIES, load
from corpuskiln.sources import readers as R

load()


def test_rate_key(spark):
    rows = [("10.0.0.7", "10.0.0.7"), ("2001:db8:1:2:aaaa::9", "2001:db8:1:2::"), ("::1", "::"), ("no address", "no address"), ("", ""), (None, None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", D.rate_key("a").alias("k")).collect()
    assert [r.k for r in sorted(got)] == [k for _, k in rows]


def test_first_success(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "b")], "x string, y string")
    assert [r.v for r in df.select(D.first_success(F.col("x"), F.col("y")).alias("v")).collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no provider"):
        df.filter("x is null").select(D.first_success(F.col("x")).alias("v")).collect()


def test_record_kinds_and_parts(spark):
    df = spark.createDataFrame([("1", None), (None, "COMMON"), (None, None)], "saos_id string, court_type string")
    assert [r.j for r in df.select(R.is_judgment(F.col("saos_id"), F.col("court_type")).alias("j")).collect()] == [True, True, False]
    rows = [(1, "P\n\n", "t" * 60, "short", None, "because", "all"), (2, "", "", "short", "", " ", "all"), (3, "", None, None, None, None, None)]
    got = R.judgment_parts(spark.createDataFrame(rows, "id int, prefix string, thesis string, ruling string, preamble string, justification string, full string"), "id", "prefix").collect()
    assert [(r.id, r.place, r.section, r.text) for r in sorted(got)] == [(1, 0, "thesis", "P\n\n" + "t" * 60), (1, 1, "justification", "P\n\nbecause"), (2, 0, "full", "all"), (3, 0, "full", "")]


def test_salvage_and_frames(spark):
    answers = ['x [{"question": "q", "answer": "a"}] y', "no list", "[broken", None, '[{"question": "q"}, {"question": "r", "answer": "b"}]']
    got = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", D.salvage_pairs(F.col("a")).alias("p")).collect()
    assert [[(p.question, p.answer) for p in r.p] for r in sorted(got)] == [[("q", "a")], [], [], [], [("r", "b")]]
    text = "data: {}\n\n: ping\ndata: [1]\n\n"
    assert spark.createDataFrame([(text,)], "t string").select(D.stream_payloads(F.col("t")).alias("p")).first().p == ["{}", "[1]"]


def test_cache_hits(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "event_id", "ts").collect()
    made, want = {}, {}
    for r in sorted(events, key=lambda r: (r.ts, r.event_id)):
        key = (r.user_id, r.event_type)
        want[r.event_id] = key in made and (r.ts - made[key]).total_seconds() <= 86400
        if not want[r.event_id]:
            made[key] = r.ts
    got = {r.event_id: r.hit for r in QUERIES["cache_hits"](spark, sf).collect()}
    assert got == want and any(got.values())


def test_changes_of_null_digests(spark):
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "id int, h string")
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "id int, h string")
    assert sorted((r.id, r.kind) for r in A.changes(new, old, "id", "h").collect()) == [(3, "changed"), (4, "new")]


def test_no_second_ranking_for_few_candidates(spark):
    docs = spark.createDataFrame([(i, "act", f"alpha beta word{i}") for i in range(4)], "point_id long, act_id string, text string")
    asked = spark.createDataFrame([(1, "Ile wynosi alpha beta dla word2 teraz?")], "query_id long, question string")
    plain = Retriever(top_k=10).search(asked, docs).select("query_id", "point_id", "score").collect()
    assert sorted(plain) == sorted(Retriever(top_k=10, rerank=True).search(asked, docs).select("query_id", "point_id", "score").collect())
    assert Retriever(top_k=2, rerank=True, filters=S.corpus_filters()).search(asked, docs).count() == 2
