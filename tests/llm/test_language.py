import zlib

from pyspark.sql import functions as F

from corpuskiln.llm import langid, maxent
from corpuskiln.llm.common import crc_mod

from .fixtures import rows, table


def test_fold_rule_is_crc32(spark):
    got = spark.range(50).select("id", crc_mod("id", 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_held_out_accuracy(spark, sf):
    got = langid.op1_string_kernel_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    n, good = got.count(), got.filter("lang = lang_pred").count()
    assert n > 30 and good >= 0.95 * n


def test_cases(spark):
    data = [*rows(), (950, "1234 !!"), (951, "日本語")]
    docs = table(spark, data)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[200].lang_pred == got[201].lang_pred == got[202].lang_pred == got[950].lang_pred == "und"
    assert got[951].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, langid.fit(docs.filter("false"))).filter("lang_pred <> 'und'").count() == 0


def test_every_labelled_language_is_learned(spark):
    """Seventy languages of their own words, and fewer sampled rows than there are labelled ones; one id is a hot one."""
    import random

    rnd = random.Random(3)
    words = {g: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)] for g in range(70)}
    data = [(70 * i + g, " ".join(rnd.choices(words[g], k=30)), f"l{g:02}") for g in range(70) for i in range(12)]
    docs = spark.createDataFrame([*data, *[data[0]] * 200], "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=300)
    assert len(model.langs) == 70 and len(model.landmarks) <= 300
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang").distinct(), "doc_id")
    assert got.count() == 70 * 12 + 200 and got.filter("lang <> lang_pred").count() == 0


def test_a_table_without_labels_or_rows_gives_und(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.fit(docs.filter("false")) is None


def test_base_scores_and_model(spark):
    import math
    import re
    from collections import Counter

    data = rows()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    toks = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]) for i, t in data]
    counts = Counter(x for i, t in toks if zlib.crc32(str(i).encode()) % 5 != 1 for x in t)
    total, size = sum(counts.values()), len(counts)
    want = sorted((i, len(t), sum(counts[x] > 0 for x in t), round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (size + 1))) for x in t), 6)) for i, t in toks)
    got = maxent.score_texts(table(spark, data), crc_mod("doc_id", 5) != 1).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert maxent.score_texts(table(spark, []), F.lit(True)).count() == 0


def test_model_beats_base_on_held_out_texts(spark):
    got = maxent.op7_hashed_maxent(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]
