"""Queries over the stored index of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import search as S
from corpuskiln.operators.dense import DenseIndex
from corpuskiln.operators.store import shared_place
from corpuskiln.plans.search_queries import _KNN, _queries
from corpuskiln.registry import query, table

CELL_ROWS = 100


def _index(spark, sf):
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vec"), "label")
    return DenseIndex.build(points, shared_place(spark, "dense"), cell_rows=CELL_ROWS)


def _ranked_sql(rows: str, top: int) -> str:
    return f"SELECT query_id, point_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT * REPLACE (round(score, 9) AS score) FROM ({rows}))) WHERE rank <= {top}"


@query("dense_index_topk", _ranked_sql(_KNN, 10))
def dense_index_topk(spark, sf):
    """The exact search of the index: the stated query set against all vectors, but for each query itself."""
    hits = _index(spark, sf).search(_queries(spark, sf), 11).filter("query_id <> point_id").drop("rank")
    return S.ranked(hits, "query_id", 10)


@query("dense_index_filtered", _ranked_sql(_KNN + " AND e.label % 2 = 0", 5))
def dense_index_filtered(spark, sf):
    """The exact search among the rows that a filter on a stored column leaves."""
    hits = _index(spark, sf).search(_queries(spark, sf), 6, where=[F.col("label") % 2 == 0]).filter("query_id <> point_id").drop("rank")
    return S.ranked(hits, "query_id", 5)


@query("dense_index_recall", "SELECT sum(least(10, n)) AS n_pairs, true AS recall_reached FROM (SELECT count(*) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)")
def dense_index_recall(spark, sf):
    """Is a recall of 0.95 reached by the probes that the index settles on? The best 10 of each query of the stated set are compared."""
    _, found, n = _index(spark, sf).tuned(_queries(spark, sf), 10)
    return spark.range(1).select(F.lit(n).cast("long").alias("n_pairs"), F.lit(found >= 0.95 * n).alias("recall_reached"))
