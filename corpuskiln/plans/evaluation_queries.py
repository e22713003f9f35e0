"""Evaluation of two retrieval settings: benchmark passages as golden questions over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import evaluation as E
from corpuskiln.operators.sparse import SparseIndex, words
from corpuskiln.operators.store import shared_place
from corpuskiln.plans.search_queries import _TERMS
from corpuskiln.registry import query, table

TOP = 5

_SETTING = """(SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank
FROM (SELECT query_id, point_id, round(sum({weight}), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term) JOIN len USING (point_id), st GROUP BY 1, 2))"""
_FULL = _SETTING.format(weight="tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al)) * ln(1 + (n - df + 0.5) / (df + 0.5))")
_PLAIN = _SETTING.format(weight="tf * 2.2 / (tf + 1.2 * (1 - 0.0 + 0.0 * len / al))")
_SCORED = """SELECT g.query_id, coalesce(h.n, 0)::INTEGER AS n_retrieved, coalesce(top, 0) AS top_score,
CASE WHEN h.n IS NULL THEN 0 ELSE len(list_filter(keywords, lambda k: contains(h.al, lower(k)))) END::INTEGER AS keyword_hits, CASE WHEN h.n IS NULL THEN 0 ELSE len(keywords) END::INTEGER AS keyword_total,
CASE WHEN h.n IS NULL THEN 0 WHEN len(keywords) = 0 THEN 1 ELSE round(len(list_filter(keywords, lambda k: contains(h.al, lower(k)))) / len(keywords), 3) END::DOUBLE AS keyword_rate,
len(list_filter(facts, lambda k: contains(coalesce(h.answer, ''), lower(k))))::INTEGER AS fact_hits, len(facts)::INTEGER AS fact_total,
CASE WHEN len(facts) = 0 THEN 1 ELSE round(len(list_filter(facts, lambda k: contains(coalesce(h.answer, ''), lower(k)))) / len(facts), 3) END::DOUBLE AS fact_rate
FROM g LEFT JOIN (SELECT query_id, count(*) AS n, round(max(score) FILTER (rank = 1), 4) AS top, string_agg(lower(coalesce(text, '')), ' ' ORDER BY rank) || string_agg(lower(coalesce(lang, '')), ' ' ORDER BY rank) AS al,
max(lower(text)) FILTER (rank = 1) AS answer FROM {run} JOIN documents ON doc_id = point_id WHERE rank <= 5 GROUP BY 1) h USING (query_id)"""
_BASE = f"""
WITH d AS MATERIALIZED ({_TERMS.format(id="doc_id", key="point_id", table="documents")}), q AS (SELECT DISTINCT query_id, term FROM ({_TERMS.format(id="item_id", key="query_id", table="benchmark")})),
len AS MATERIALIZED (SELECT point_id, sum(tf) AS len FROM d GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS al FROM len),
p AS MATERIALIZED (SELECT * FROM d WHERE term IN (SELECT term FROM q)), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
gw AS (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT query_id, list_filter(w, lambda x: length(x) >= 9) AS keywords, list_transform(list_filter([1, 11, 21, 31], lambda i: i + 1 <= len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS facts FROM gw),
a AS ({_SCORED.format(run=_FULL)}), b AS ({_SCORED.format(run=_PLAIN)}),
c AS MATERIALIZED (SELECT a.query_id, {", ".join(f"{r}.{c} AS {n}_{c}" for r, n in (("a", "full"), ("b", "plain")) for c in ("n_retrieved", "top_score", "keyword_hits", "keyword_total", "keyword_rate", "fact_hits", "fact_total", "fact_rate"))} FROM a JOIN b USING (query_id))
"""


def _compared(spark, sf):
    """The golden table and both runs over one stored index, in one plan."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "text", F.col("lang").alias("title"))
    index = SparseIndex.build(docs.select("point_id", "text"), shared_place(spark, "sparse"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    w = words(F.col("text"))
    facts = F.transform(F.filter(F.array(*(F.lit(i) for i in (1, 11, 21, 31))), lambda i: i + 1 <= F.size("w")), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    golden = asked.select("query_id", w.alias("w")).select("query_id", F.filter("w", lambda x: F.length(x) >= 9).alias("keywords"), facts.alias("facts"))
    shown = lambda hits: hits.join(docs, "point_id").select("query_id", "rank", "score", "text", "title")
    return E.compare_runs(golden, {"full": shown(index.search(asked, TOP)), "plain": shown(index.search(asked, TOP, b=0.0, idf=False))})


@query("eval_questions", _BASE + "SELECT * FROM c")
def eval_questions(spark, sf):
    """Two settings of the ranking (with and without document frequency and length), question by question."""
    return _compared(spark, sf)


@query(
    "eval_run",
    _BASE + "SELECT *, 'W' || wins || ' L' || losses || ' T' || ties || '  (' || printf('%.0f', 100 * full_avg_fact_rate) || '% vs ' || printf('%.0f', 100 * plain_avg_fact_rate) || '%)' AS verdict FROM (SELECT count(*) AS n_questions, "
    + ", ".join(f"round(avg({r}_{c}), 4) AS {r}_avg_{c}" for r in ("full", "plain") for c in ("top_score", "keyword_rate", "fact_rate"))
    + ", count(*) FILTER (full_fact_rate > plain_fact_rate) AS wins, count(*) FILTER (full_fact_rate < plain_fact_rate) AS losses, count(*) FILTER (full_fact_rate = plain_fact_rate) AS ties FROM c)",
)
def eval_run(spark, sf):
    """The report of the evaluation: means, wins, losses and ties."""
    return E.report(_compared(spark, sf), "full", "plain")
