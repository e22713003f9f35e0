import random
import re

from pyspark.sql import functions as F

from corpuskiln.functions import chunk as C
from corpuskiln.sources import readers


def _chunks(text, size, overlap):
    """Greedy by sentences, counted in words."""
    out, held, n = [], None, 0
    for s in re.split(r"(?<=[.!?])\s+|\n\n+", text):
        w = len(s.split())
        if held is not None and n + w > size:
            out.append(held)
            tail = held.split()[-overlap:]
            held, n = " ".join(tail), len(tail)
        held, n = s if held is None else f"{held} {s}", n + w
    return [c for c in (x.strip() for x in [*out, held]) if c]


def test_sentence_chunks_are_brute_force(spark):
    """Long sentences, blank ones, white space of all kinds, texts that begin or end with gaps."""
    rng = random.Random(3)
    ends = [". ", "! ", "?\n", "\n\n", "\n\n\n", ". ", " ", ".", "\n", ".\t\x1c"]
    texts = ["", " ", "\n\nA. ", "eins", "a " * 50, "a. " * 50]
    texts += ["".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 14))) + rng.choice(ends) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").withColumn("c", C.sentence_chunks(F.col("t"), 12, 4)).collect()
    got = {r.i: r.c for r in rows}
    assert got.pop(-1) is None
    assert got == {i: _chunks(t, 12, 4) for i, t in enumerate(texts)}
    assert any(len(c) > 5 for c in got.values())


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_articles_in_any_case_with_glued_headers(spark):
    body = "Treść przepisu jest tu dość długa, aby zostać. "
    text = f"Ustawa o czymś\n ART. 1.\n\n\n{body * 2}\nartykuł 2a\n{body * 2}\n§ 3.\n \nkrótki\nArt. 4 w środku zdania {body}\n"
    parts = _one(spark, C.articles, text)
    assert parts == [f"ART. 1.\n\n{body * 2}".strip(), f"artykuł 2a\n\n{body * 2}".strip(), f"§ 3.\n\nkrótki\nArt. 4 w środku zdania {body}".strip()]
    assert _one(spark, C.articles, f"{body}\nArt. 1.\n{body}") == [f"{body}\nArt. 1.\n{body}"]  # one header: whole
    assert _one(spark, C.articles, None) is None


def test_sections_reopen_behind_a_blank_line(spark):
    long = "Sąd uznał, że skarga jest zasadna i uchylił zaskarżony wyrok."
    text = f"TEZY\n{long}\n\n uzasadnienie \t\n{long}\r\n\nTeza\n\nb\n  Sentencja bez\nSENTENCJA\nkrótko\nUzasadnienie\n \n"
    got = {r.section: r.section_text for r in C.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").collect()}
    assert got == {"thesis": f"{long}\n\nb\n  Sentencja bez", "justification": long}


def test_titles_of_judgments_and_defaults_of_acts(spark):
    schema = "id string, saos_id string, court_type string, case_number string, judgment_date string, source_url string"
    rows = spark.createDataFrame([(None, "7", "SUPREME", "I C 1", "2020-01-02", "u"), ("x", "8", None, None, None, None)], schema)
    a, b = rows.select(*(c.alias(n) for n, c in readers.judgment_columns().items())).orderBy("id").collect()
    assert tuple(a) == ("saos_7", "Sąd Najwyższy | I C 1 | 2020-01-02", "2020", "SUPREME", "I C 1", "u")
    assert tuple(b) == ("x", " |  | ", "", "", "", "")
    acts = spark.createDataFrame([("a", None, "2001", None, None, None, None), ("b", "T", None, "", "3", "u", "s")], "id string, title string, year string, publisher string, pos string, url string, status string")
    got = acts.select(*(c.alias(n) for n, c in readers.act_columns().items())).orderBy("id").collect()
    assert [(r.title, r.publisher, r.status) for r in got] == [("", "WDU", ""), ("T", "", "s")]


def test_sentence_chunks_fold_numbers_only(spark):
    rng = random.Random(8)
    texts = ["", " ", "a", None, "x" * 9, *("".join(rng.choice(["a", "b.", "c!", " ", "  ", "\n\n", "\u2003", " d e f g"]) for _ in range(90)) for _ in range(60))]
    ws = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def plain(text, size, overlap):
        out, now, n = [], None, 0
        words = lambda s: [w for w in re.split(f"{ws}+", s) if w]
        for s in re.split(rf"(?<=[.!?]){ws}+|\n\n+", text):
            if now is not None and n + len(words(s)) > size:
                out.append(now)
                carried = words(now)[-overlap:]
                now, n = " ".join(carried) + " " + s, len(carried) + len(words(s))
            else:
                now, n = s if now is None else now + " " + s, n + len(words(s))
        return [c for c in (re.sub(rf"^{ws}+|{ws}+\Z", "", c) for c in [*out, now]) if c]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size, overlap in ((12, 5), (6, 8), (3, 1)):
        got = dict(df.select("i", C.sentence_chunks(F.col("t"), size, overlap)).collect())
        assert got == {i: None if t is None else plain(t, size, overlap) for i, t in enumerate(texts)}
    plan = df.select(C.sentence_chunks(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "now" not in plan  # no text is built up in the fold
