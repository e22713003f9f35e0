"""Operators, functions, sources and streams of the library itself."""

import uuid

from pyspark.sql import functions as F

from corpuskiln import registry
from corpuskiln.functions import chunk as C
from corpuskiln.functions import text as X
from corpuskiln.operators import search as S
from corpuskiln.operators import state
from corpuskiln.plans.retrieve import Retriever, overlap_score
from corpuskiln.sources import readers, sinks
from corpuskiln.streaming import jobs

registry.load()


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_payload_rules(spark):
    for status, gone in (("obowiązujący", False), ("", False), ("uchylony", True), ("nieobowiązujący", True), (" UCHYLONY ", True)):
        assert one(spark, X.is_repealed(F.col("s")), s=status) is gone
    for year, want in (("2019", 2019), ("", 0), ("brak", 0), ("2019-05-01", 2019)):
        assert one(spark, X.year_of(F.col("y")), y=year) == want
    for publisher, act, want in (("WDU", "a", "legislation"), ("KIS", "a", "tax_interpretation"), ("Jan Nowak", "kis_7", "tax_interpretation"), ("SUPREME", "a", "judgment_sn"), ("EURLEX", "a", "eu_regulation"), ("??", "a", "legislation")):
        assert one(spark, X.source_type(F.col("p"), F.col("a")), p=publisher, a=act) == want


def test_point_id_is_uuid5(spark):
    assert one(spark, X.point_id(F.col("a"), F.col("i")), a="WDU/2004/ż", i=7) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "WDU/2004/ż__chunk7"))


def test_topics_and_complexity(spark):
    for q, want in (("Jak rozliczyć VAT i podatek od sprzedaży?", "tax"), ("Które wyroki NSA zapadły po skardze kasacyjnej?", "judgment"), ("Które przepisy ustawy nakładają obowiązek?", "legislation"), ("Dzień dobry", None), ("wyrok NSA w sprawie ustawy i przepisów o VAT", None)):
        assert one(spark, X.topic(F.col("q")), q=q) == want
    for q, want in (("Co to jest zasiedzenie?", "trivial"), ("Jaka jest różnica między darowizną a spadkiem?", "complex"), ("Jak ustawa o podatkach i kodeks cywilny regulują najem?", "complex"), ("Ile wynosi opłata za wpis do rejestru?", "simple")):
        assert one(spark, X.complexity(F.col("q")), q=q) == want


def test_citation_forms(spark):
    full = X.citation(F.col("t"), F.col("y"), F.col("p"), F.col("u"), F.lit("A1"))
    assert one(spark, full, t="Akt", y="2020", p="5", u="http://x") == "Akt (2020) poz. 5 <http://x>"
    assert one(spark, full, t="", y="", p="", u="") == "act_id=A1"
    assert one(spark, X.normalise_eli(F.col("c")), c="WDU20040540535") == "WDU/2004/54/535"
    assert one(spark, X.renumber_citations(F.col("c")), c="tak [2] i [10]") == "tak (źródło 2) i (źródło 10)"


def test_cleaning(spark):
    raw = "Dziennik Ustaw  –  12 – Poz. 34 Tekst​ á​   b _____ \n\n\n\n c - 5 - d"
    got = one(spark, X.clean_text(F.col("t")), t=raw)
    assert "Poz." not in got and "á" in got and "_____" not in got and "\n\n\n" not in got and "- 5 -" not in got
    assert one(spark, X.strip_markup(F.col("t")), t="<p>Ala</p><p>kot</p>") == "Ala\nkot"
    assert one(spark, X.html_to_lines(F.col("t")), t="<style>x</style>a &amp; b<br>c<li>d</li>") == "a & b\nc\n- d"


def fold(parts, limit, overlap):
    done, now, size, is_open = [], "", 0, False
    for u in parts:
        if is_open and size + len(u) > limit:
            done.append(now)
            tail = now[-overlap:]
            blank = tail.find(" ")
            tail = tail[blank + 1 :] if blank > 0 else tail
            now, size = tail + " " + u, len(tail) + len(u) + 1
        else:
            now, size = (now + " " + u if is_open else u), size + len(u) + 1
        is_open = True
    return [c for c in [*done, now] if len(c) >= 50]


def test_chunks_follow_the_fold(spark):
    import random

    rng = random.Random(0)
    for _ in range(5):
        parts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 40))) for _ in range(30)]
        got = one(spark, C.chunks(F.col("t"), 60, 10), t="\n\n".join(parts))
        units = [u for p in parts for u in [p]]
        assert got == fold(units, 240, 40)


def test_sections_and_articles(spark):
    text = "Wstęp " * 12 + "\nSENTENCJA\n" + "Orzeka " * 12 + "\n uzasadnienie \n" + "Bo tak " * 12 + "\nSENTENCJA\n" + "Dalej " * 12
    rows = {r.section: r.section_text for r in C.sections(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()}
    assert set(rows) == {"preamble", "ruling", "justification"} and "Orzeka" in rows["ruling"] and "Dalej" in rows["ruling"]
    act = "Tytuł aktu " * 6 + "\nArt. 1.\n" + "Treść " * 12 + "\nArt. 2a.\n" + "Inna " * 12
    assert len(one(spark, C.articles(F.col("t")), t=act)) == 3
    assert len(one(spark, C.articles(F.col("t")), t="bez nagłówków")) == 1


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    times = [(1, float(t), i) for i, t in enumerate([0, 1, 2, 3, 9, 10, 11, 11.5, 12, 30])]
    df = spark.createDataFrame(times, "k int, t double, o int")
    want = {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, 8: True, 9: True}
    assert {r.o: r.admitted for r in state.admit(df, "k", "t", 3, 10.0, "o").collect()} == want
    df.filter("o < 5").coalesce(1).write.parquet(str(tmp_path / "in/a.parquet"))
    df.filter("o >= 5").coalesce(1).write.parquet(str(tmp_path / "in/b.parquet"))
    got = {}
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.admission(stream, "k", "t", "o", 3, 10.0).writeStream.outputMode("append").foreachBatch(lambda b, _: got.update({r.o: r.admitted for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == want


def test_incremental_index_is_idempotent(spark, tmp_path):
    schema = "point_id long, text string"
    chunk = lambda b: b.withColumn("text_hash", F.md5("text"))

    def feed(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "raw" / name))
        raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "raw"))
        jobs.incremental_index(raw, chunk, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()

    feed("a", [(1, "one"), (2, "two")])
    feed("b", [(2, "two"), (3, "three"), (1, "uno")])
    assert {r.point_id: r.text for r in jobs.latest_index(spark, str(tmp_path / "index")).collect()} == {1: "uno", 2: "two", 3: "three"}
    assert spark.read.parquet(str(tmp_path / "index/batch=1")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"a","title":"T"}\n\nnot json\n{"id":"b"}\n')
    assert sorted(r.id for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), readers.RAW).collect()) == ["a", "b"]
    items = spark.createDataFrame([(7, "SUPREME", [("I C 1/20",)], "2020-01-02", "SENTENCE", [("Anna K",)], "Treść wyroku", [("DU", "2004", "54", "535", "Dz.U.")], None), (8, "COMMON", [], "2020-01-02", "S", [], " ", [], None)], readers.COURT_ITEM)
    (j,) = readers.judgments(items).collect()
    assert (j.id, j.case_number, j.judges, j.referenced_regulations[0].citation, j.keywords) == ("saos_7", "I C 1/20", ["Anna K"], "Dz.U.", [])
    rulings = readers.tax_rulings(spark.createDataFrame([("1", "", "S-1", "2021-05-04T10:00:00Z", ["Podatek VAT", "podatek dochodowy od osób prawnych", "VAT"], "t" * 60), ("2", "x", "S-2", "bad", [], "krótki")], "id string, title string, signature string, date string, topics array<string>, text string"))
    (r,) = rulings.collect()
    assert (r.id, r.title, r.year, r.tax_type) == ("kis_1", "Interpretacja S-1", "2021", "CIT, VAT")
    both = readers.canonical(readers.judgments(items), rulings)
    assert {x.id for x in both.collect()} == {"saos_7", "kis_1"}
    out = str(tmp_path / "out")
    sinks.append_unseen(rulings.select("id", "title"), out, ["id"], False)
    sinks.append_unseen(rulings.select("id", "title"), out, ["id"], True)
    assert spark.read.json(out).count() == 1


def test_neighbours_budget_and_gate(spark):
    corpus = spark.createDataFrame([("a", i, f"t{i}") for i in range(5)], "act string, idx int, text string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", 4)], "query_id int, act string, idx int")
    got = {r.idx: (r.before, r.after) for r in S.neighbours(hits, corpus, "act", "idx", "text").collect()}
    assert got == {1: ("t0", None), 2: (None, "t3"), 4: ("t3", None)}
    blocks = spark.createDataFrame([(1, 1, "x" * 300), (1, 2, "y" * 300), (1, 3, "z" * 600), (1, 4, "k")], "q int, r int, t string")
    kept = S.within_budget(blocks, "q", "r", "t", 900).orderBy("r").collect()
    assert [len(r.t) for r in kept] == [300, 300, 297]
    scored = spark.createDataFrame([(1, -3.0), (2, -1.0), (3, 0.5)], "point_id int, score double")
    assert {r.point_id: r.status for r in S.gate(scored).collect()} == {2: "ambiguous", 3: "correct"}


def test_retriever_finds_the_copy_and_leaves_trivial_questions(spark):
    docs = spark.createDataFrame([(1, "A", "umowa najmu lokalu mieszkalnego i kaucja", "Najem"), (2, "B", "podatek od towarów i usług faktura", "VAT"), (3, "C", "kara umowna za opóźnienie", "Kary")], "point_id long, act_id string, text string, title string")
    asked = spark.createDataFrame([(10, "jaka kaucja przy umowie: najmu lokalu mieszkalnego"), (11, "czym jest faktura")], "query_id long, question string")
    rows = Retriever(top_k=2).search(asked, docs).collect()
    assert {r.query_id for r in rows} == {10} and next(r for r in rows if r.rank == 1).point_id == 1
    assert {r.query_id for r in Retriever(top_k=2, rerank=True).search(asked, docs).collect()} == {10}
    assert one(spark, overlap_score(F.col("a"), F.col("b")), a="x y", b="x y z") > 4


def test_plans_push_filters_and_limit_windows(spark, sf):
    def plan(df):
        return df._jdf.queryExecution().toString()

    assert "WindowGroupLimit" in plan(registry.QUERIES["topn_per_user"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan(registry.QUERIES["asof_year_filter"](spark, sf))
    assert "CartesianProduct" not in plan(registry.QUERIES["bm25_topk"](spark, sf))
    assert "text" not in plan(registry.QUERIES["source_stats"](spark, sf)).split("ReadSchema")[1].split("\n")[0]


def test_every_query_matches_its_sql(spark):
    import glob
    import os

    import duckdb
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")

    def rows(df):
        def cell(x):
            if pd.isna(x):
                return None
            if isinstance(x, (bool, str)):
                return x
            return str(x) if hasattr(x, "year") else round(float(x), 6)

        return sorted(str(tuple(map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False))

    for name, sql in registry.ORACLE.items():
        a, b = registry.QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns), name
        assert rows(a) == rows(b), name
