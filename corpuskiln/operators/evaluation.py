"""Evaluation of retrieval settings over one golden table.

``golden`` has query_id, keywords and facts (arrays of strings). A run is a table of hits (query_id, rank, score, text, title);
a question without hits scores zero. A keyword counts where it is found, ignoring case, in the hits' texts and titles: texts
joined by blanks, titles by blanks, and the titles appended to the texts without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(found: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(found / total, 3)).otherwise(1.0)


def hits_in(needles: Column, text: Column) -> Column:
    return F.size(F.filter(needles, lambda n: F.contains(text, F.lower(n))))


def score_run(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question: top score, keyword hits, total and rate, and the same of the facts in the answer.

    ``hits`` are at most the first k of each question, so a question's texts fit one row. The answer is a column of ``hits``
    where a model has been asked; else the first hit's text stands in."""
    answer = F.col("answer") if "answer" in hits.columns else F.when(F.col("rank") == 1, F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "score", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("title", F.lit("")).alias("title"))))
    found = hits.withColumn("_answer", answer).groupBy("query_id").agg(rows.alias("h"), F.max("_answer").alias("answer"))
    joined = lambda part: F.array_join(F.transform("h", lambda h: F.lower(h[part])), " ")
    found = found.select("query_id", F.round(F.try_element_at("h", F.lit(1))["score"], 4).alias("top_score"), F.size("h").alias("n_retrieved"), F.concat(joined("text"), joined("title")).alias("all"), F.lower("answer").alias("answer"))
    rows = golden.join(found, "query_id", "left")
    none = F.col("n_retrieved").isNull()
    keyword, fact = hits_in(F.col("keywords"), F.col("all")), hits_in(F.col("facts"), F.coalesce("answer", F.lit("")))
    return rows.select(
        "query_id", F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.when(none, 0).otherwise(keyword).alias("keyword_hits"), F.when(none, 0).otherwise(F.size("keywords")).alias("keyword_total"),
        F.when(none, 0.0).otherwise(share(keyword, F.size("keywords"))).alias("keyword_rate"),
        fact.alias("fact_hits"), F.size("facts").alias("fact_total"), share(fact, F.size("facts")).alias("fact_rate"),
    )


def compare_runs(golden: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """Questions by settings: the scores of each run as columns ``<run>_...``, joined question by question."""
    out = golden.select("query_id")
    for name, hits in runs.items():
        scored = score_run(golden, hits)
        out = out.join(scored.select("query_id", *(F.col(c).alias(f"{name}_{c}") for c in scored.columns if c != "query_id")), "query_id")
    return out


def report(compared: DataFrame, ours: str, other: str) -> DataFrame:
    """One row: number of questions, means of both runs, and wins, losses and ties of ``ours`` by rate of facts."""
    a, b = F.col(f"{ours}_fact_rate"), F.col(f"{other}_fact_rate")
    means = [F.round(F.avg(f"{run}_{c}"), 4).alias(f"{run}_avg_{c}") for run in (ours, other) for c in ("top_score", "keyword_rate", "fact_rate")]
    one = compared.agg(F.count("*").alias("n_questions"), *means, F.count_if(a > b).alias("wins"), F.count_if(a < b).alias("losses"), F.count_if(a == b).alias("ties"))
    percent = lambda c: F.concat(F.bround(100 * F.col(c)).cast("long").cast("string"), F.lit("%"))  # noqa: E731  # halves go to the even number, as printf has it
    verdict = F.concat(F.format_string("W%d L%d T%d  (", "wins", "losses", "ties"), percent(f"{ours}_avg_fact_rate"), F.lit(" vs "), percent(f"{other}_avg_fact_rate"), F.lit(")"))
    return one.withColumn("verdict", verdict)
