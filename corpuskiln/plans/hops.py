"""Retrieval in several hops: what a hop finds leads to the next question, until nothing new or a budget of characters is reached."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators.store import shared_place

# Fixed values
MOST_HOPS = 5
BUDGET = 50_000  # characters of shown hits beyond which no further hop is made
SHOWN = 600  # characters of a hit that count


def multi_hop(
    questions: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    follow_up: Callable[[DataFrame], DataFrame],
    most_hops: int = MOST_HOPS,
    budget: int = BUDGET,
) -> DataFrame:
    """(query_id, point_id, hop, score, rank): each hit of a question once, as the first hop that found it gave it.

    ``questions``: query_id, text, class; all get the first hop, only complex ones further hops. ``search`` takes (query_id, text)
    to (query_id, point_id, score, rank, text); ``follow_up`` takes the hits that are new in a hop (query_id, point_id, score,
    rank, text) to the next questions (query_id, text); where it gives none, or no hit is new, a question is done. Hits of all
    hops count for the budget, repeated ones too. Each hop is written to the shared folder, so a hop's plan does not hold the
    hops before and a lost executor costs no search again."""
    spark = questions.sparkSession
    place = shared_place(spark, "hops")
    kinds = questions.select("query_id", "class")
    asked, hop = questions.select("query_id", "text"), 0
    while True:
        search(asked).select("query_id", "point_id", "score", "rank", "text").write.parquet(f"{place}/hits/hop={hop}")
        steps = spark.read.option("basePath", f"{place}/hits").parquet(f"{place}/hits")
        if hop + 1 == most_hops:
            break
        used = steps.groupBy("query_id").agg(F.sum(F.least(F.length("text"), F.lit(SHOWN))).alias("used"))
        live = used.filter(F.col("used") <= budget).join(kinds.filter("class = 'complex'"), "query_id", "left_semi").select("query_id")
        known = steps.filter(F.col("hop") < hop).select("query_id", "point_id")
        new = steps.filter(F.col("hop") == hop).join(live, "query_id", "left_semi").join(known, ["query_id", "point_id"], "left_anti")
        follow_up(new.drop("hop")).select("query_id", "text").write.parquet(f"{place}/asked/hop={hop + 1}")
        asked, hop = spark.read.parquet(f"{place}/asked/hop={hop + 1}"), hop + 1
        if asked.isEmpty():
            break
    found = steps.groupBy("query_id", "point_id").agg(F.min_by(F.struct("hop", "score", "rank"), "hop").alias("_f"))
    return found.select("query_id", "point_id", "_f.*")
