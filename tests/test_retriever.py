"""The retrieval plan: variants, routing, gate, context."""

from pyspark.sql import functions as F

from corpuskiln.operators import search as S
from corpuskiln.plans.retrieve import Retriever, expander, reworded

TEXTS = ["umowa najmu lokalu kaucja", "kaucja najem zwrot termin", "podatek od towarów faktura", "kara umowna za opóźnienie", "wyrok sądu w sprawie najmu", "interpretacja podatek VAT faktura", "lokal użytkowy czynsz", "kaucja przy umowie najmu lokalu mieszkalnego"]


def corpus(spark, **more):
    rows = [(i, f"act{i // 3}", t, f"T{i}", i % 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "point_id long, act_id string, text string, title string, chunk_index int").withColumns({k: F.expr(v) for k, v in more.items()})


def rows(df):
    return sorted((r.query_id, r.rank, r.point_id, r.score) for r in df.collect())


def test_equal_variants_change_nothing(spark):
    asked = spark.createDataFrame([(1, "kaucja przy umowie najmu lokalu i jej zwrot"), (2, "kara za opóźnienie w zapłacie czynszu najmu")], "query_id long, question string")
    plain = rows(Retriever(top_k=5).search(asked, corpus(spark)))
    same = expander(lambda q, n: [q] * n)
    assert rows(Retriever(top_k=5, expand=same).search(asked, corpus(spark))) == plain and len(plain) == 10


def test_variants_keep_the_best_score_of_each_point(spark):
    asked = spark.createDataFrame([(1, "kaucja najmu lokalu czynsz kara")], "query_id long, question string")
    several = {r.point_id: r.score for r in Retriever(top_k=8, expand=expander(reworded)).search(asked, corpus(spark)).collect()}
    single = {r.point_id: r.score for r in Retriever(top_k=8).search(asked, corpus(spark)).collect()}
    assert set(several) == set(single) and all(several[p] >= single[p] for p in single)
    other = spark.createDataFrame([(1, "podatek faktura")], "query_id long, question string")
    alone = {r.point_id: r.score for r in Retriever(top_k=8).search(other, corpus(spark)).collect()}
    both = {r.point_id: r.score for r in Retriever(top_k=8, expand=expander(lambda q, n: ["podatek faktura"])).search(asked, corpus(spark)).collect()}
    assert both == {p: max(single.get(p, 0), alone.get(p, 0)) for p in both}


def test_a_failing_model_leaves_the_question(spark):
    def fails(*_):
        raise RuntimeError("no model")

    asked = spark.createDataFrame([(1, "kaucja najmu", "simple"), (2, "porównaj kaucję i czynsz", "complex")], "query_id long, question string, class string")
    assert sorted(map(tuple, expander(fails, fails)(asked).collect())) == [(1, 0, "kaucja najmu"), (2, 0, "porównaj kaucję i czynsz")]
    found = sorted(map(tuple, expander(lambda q, n: [f"{q} {i}" for i in range(9)], lambda q: "teza " + q)(asked).collect()))
    assert [(q, v) for q, v, _ in found] == [(1, i) for i in range(4)] + [(2, i) for i in range(6)] and found[0][2] == "teza kaucja najmu"


def test_clear_topics_are_searched_among_their_source_types(spark):
    typed = corpus(spark, source_type="case when point_id in (2, 5) then 'tax_interpretation' when point_id = 4 then 'judgment_sn' when point_id = 7 then null else 'legislation' end")
    asked = spark.createDataFrame([(1, "podatek VAT i faktura za najem lokalu"), (2, "wyrok sądu: apelacja i kasacja w sprawie podatku i kaucji"), (3, "kaucja najmu lokalu faktura")], "query_id long, question string")
    found = {}
    for q, _, p, _ in rows(Retriever(top_k=8, expand_context=False).search(asked, typed)):
        found.setdefault(q, set()).add(p)
    assert found[1] == {2, 5} and found[2] == {4} and found[3] == set(range(8))
    assert {p for q, _, p, _ in rows(Retriever(top_k=8, route=False).search(asked, typed)) if q == 1} == set(range(8))


def test_gate_judges_by_the_scorer_and_not_where_candidates_are_few(spark):
    asked = spark.createDataFrame([(1, "kaucja umowa najmu lokalu")], "query_id long, question string")
    low = lambda q, t: F.when(t.contains("kaucja"), 1.0).otherwise(-5.0)
    docs = corpus(spark)
    off = Retriever(top_k=8, gate=True, score=low).search(asked, docs)  # reranking off: judged by a score of its own
    assert {r.point_id for r in off.collect()} == {0, 1, 7}
    on = Retriever(top_k=4, gate=True, rerank=True, score=low).search(asked, docs)
    assert {r.point_id for r in on.collect()} == {0, 1, 7}
    few = Retriever(top_k=8, gate=True, rerank=True, score=low).search(asked, docs)  # no more candidates than hits: no second score
    assert few.count() == 8


def test_children_become_parents_and_neighbours_join(spark):
    asked = spark.createDataFrame([(1, "kara umowna opóźnienie")], "query_id long, question string")
    hit = lambda df: next(r.preview for r in df.collect() if r.point_id == 3)
    assert hit(Retriever(top_k=1).search(asked, corpus(spark))) == TEXTS[3] + "\n\n" + TEXTS[4]
    children = corpus(spark, chunk_type="'child'", parent_text="concat('parent of ', act_id)")
    found = Retriever(top_k=8).search(asked, children).collect()
    assert sorted(r.preview for r in found) == ["parent of act0", "parent of act1", "parent of act2"]


def test_an_explicit_publisher_wins_and_years_are_numbers(spark):
    acts = spark.createDataFrame([(1, "WDU", "987", False, 0), (2, "DU", "2010", False, 0), (3, "EURLEX", "2012", False, 0), (4, "KIS", None, False, 0)], "id int, publisher string, year string, is_repealed boolean, valid_from_year int")

    def ids(**request):
        df = acts
        for f in S.corpus_filters(**request):
            df = df.filter(f)
        return {r.id for r in df.collect()}

    assert ids(source_type="legislation", publisher="EURLEX") == {3} and ids(source_type="eu_regulation") == {3}
    assert ids(source_type="legislation") == {1, 2} and ids(year_from=1000) == {2, 3} and ids(year=987) == {1}
