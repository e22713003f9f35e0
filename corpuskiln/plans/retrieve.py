"""The whole retrieval as one plan over a table of questions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.operators import search as S
from corpuskiln.operators.sparse import SparseIndex
from corpuskiln.operators.store import shared_place


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for a sentence encoder: hashed word counts, by Arrow batches."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            return np.bincount([zlib.crc32(w.encode()) % dim for w in re.findall(r"[^\W_]+", (t or "").lower())], minlength=dim).astype(float)

        return texts.map(one)

    return encode(text)


def overlap_score(question: Column, text: Column) -> Column:
    """Deterministic stand-in for a cross encoder: logit of the share of the question's words that the text holds."""
    words = F.array_distinct(F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    share = F.size(F.array_intersect(words, F.split(F.lower(text), r"[^\p{L}\p{N}]+"))) / F.greatest(F.size(words), F.lit(1))
    return F.log((share + 0.01) / (1.01 - share))


def expander(generate: Callable[[str, int], list[str]], hypothesis: Callable[[str], str] | None = None, n: int = 3, n_complex: int = 5) -> Callable[[DataFrame], DataFrame]:
    """An expander of questions (query_id, question, class) to variants (query_id, variant, question), as a table function.

    Variant 0 is the question, or the hypothetical passage that ``hypothesis`` writes for it; ``generate`` gives ``n``
    others, ``n_complex`` for complex questions. Where a model fails, the question itself stands in and further variants are left
    out, so no question is lost. Both are called once a question, in the task that holds it."""

    class Variants:
        def eval(self, query_id: int, question: str, wanted: int):
            first = question
            if hypothesis is not None:
                try:
                    first = hypothesis(question) or question
                except Exception:  # a model's failure must not lose the question
                    first = question
            yield query_id, 0, first
            try:
                others = [v.strip() for v in generate(question, wanted) if v and v.strip()][:wanted]
            except Exception:
                others = []
            for i, v in enumerate(others, 1):
                yield query_id, i, v

    def expand(questions: DataFrame) -> DataFrame:
        function = F.udtf(Variants, returnType="query_id long, variant int, question string")
        wanted = F.when(F.col("class") == "complex", n_complex).otherwise(n)
        asked = questions.select(F.col("query_id").cast("long").alias("_q"), F.col("question").alias("_text"), wanted.alias("_n"))
        return asked.lateralJoin(function(F.col("_q").outer(), F.col("_text").outer(), F.col("_n").outer())).select("query_id", "variant", "question")

    return expand


def reworded(question: str, n: int) -> list[str]:
    """Deterministic stand-in for a model that rewords: the question's words begun at another one."""
    w = question.split()
    return [" ".join(w[i:] + w[:i]) for i in range(1, min(n, len(w) - 1) + 1)]


# The source types that a question's topic leads to.
ROUTES = {
    "tax": ["tax_interpretation"],
    "judgment": ["judgment_nsa", "judgment_sn", "judgment_tk", "judgment_common", "judgment_kio"],
    "legislation": ["legislation"],
}


@dataclass
class Retriever:
    """Question table (query_id, question) and corpus (point_id, act_id, text, title, filter columns) to ranked hits, as one plan.

    Encoder, scorer and expander are plugged in. Trivial questions leave before any join; ``filters`` are applied before
    the legs; with a ``source_type`` column in the corpus and ``route`` a question of one clear topic is only searched for
    among its source types. Each variant of a question is searched on its own (legs, limits and fusion by question and
    variant), and a point keeps its best score, so equal variants change nothing. With ``rerank`` questions with more candidates
    than ``top_k`` are ranked by the scorer; the gate judges reranked hits by that score, and where reranking is off by a score of
    its own; where it is on but there are too few candidates it is left out. Hits of corpora with ``chunk_type`` and
    ``parent_text`` become their parents, once each; those of corpora with ``chunk_index`` get the texts of their neighbours."""

    top_k: int = 10
    multiple: int = 6
    complex_multiple: int = 12
    rrf_k: int = 60
    rerank: bool = False
    gate: bool = False
    route: bool = True
    expand_context: bool = True
    encode: Callable[[Column], Column] = hashed_vector
    score: Callable[[Column, Column], Column] = overlap_score
    expand: Callable[[DataFrame], DataFrame] | None = None  # (query_id, question, class) -> (query_id, variant, question)
    variants: int = 16  # more than any question has
    filters: list[Column] = field(default_factory=list)

    def search(self, questions: DataFrame, corpus: DataFrame) -> DataFrame:
        for f in self.filters:
            corpus = corpus.filter(f)
        hits, corpus = self.candidates(questions, corpus)
        shown = hits.join(corpus.drop("_kind"), "point_id")
        title = F.col("title") if "title" in corpus.columns else F.lit("")
        shown = self._context(shown, corpus)
        return shown.select("query_id", "rank", "point_id", F.round("score", 6).alias("score"), X.citation(title, F.lit(""), F.lit(""), F.lit(""), F.col("act_id")).alias("citation"), X.ellipsis(F.col("text"), 500).alias("preview"))

    def candidates(self, questions: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, point_id, score, rank) of the hits, and the corpus with the topic of each point."""
        routed = self.route and "source_type" in corpus.columns
        kind = F.coalesce(*(F.when(F.col("source_type").isin(v), k) for k, v in ROUTES.items()), F.lit("other")) if routed else F.lit("other")
        corpus = corpus.withColumn("_kind", kind)
        asked = questions.withColumn("class", X.complexity(F.col("question"))).filter("class <> 'trivial'")
        asked = asked.withColumn("_topic", X.topic(F.col("question")) if routed else F.lit(None).cast("string"))
        asked = asked.withColumn("limit_k", F.when(F.col("class") == "complex", self.top_k * self.complex_multiple).otherwise(self.top_k * self.multiple))
        most = self.top_k * self.complex_multiple
        variants = asked.select("query_id", F.lit(0).alias("variant"), "question") if self.expand is None else self.expand(asked.select("query_id", "question", "class"))
        own = asked.select("query_id", "_topic", "limit_k")
        variants = variants.join(own, "query_id").withColumn("key", F.col("query_id") * self.variants + F.col("variant"))  # one number for question and variant
        legs = [self._dense(variants, corpus, most, routed), self._sparse(variants, corpus, most, routed)]
        limits = variants.select(F.col("key").alias("query_id"), "limit_k")
        within = [leg.join(limits, "query_id").filter("rank <= limit_k") for leg in legs]
        fused = S.ranked(S.fuse(within, self.rrf_k), "query_id", most).join(limits, "query_id").filter("rank <= limit_k")
        fused = fused.select(F.expr(f"query_id div {self.variants}").alias("query_id"), "point_id", "score")
        best = S.best_per_key(fused, ["query_id", "point_id"])
        if not (self.rerank or self.gate):
            return S.ranked(best, "query_id", self.top_k), corpus
        pool = best.withColumnRenamed("score", "fused").join(corpus.select("point_id", "text"), "point_id").join(questions.select("query_id", "question"), "query_id")
        second = F.round(self.score(F.col("question"), F.col("text")), 4)
        if self.rerank:
            pool = S.second_ranking(pool, "query_id", self.top_k, F.col("fused"), second)
            hits = S.ranked(pool.select("query_id", "point_id", "score", "reranked"), "query_id", self.top_k)
            if self.gate:
                hits = S.gate(hits.filter("reranked")).drop("status").unionByName(hits.filter("not reranked"))
            return hits.drop("reranked"), corpus
        hits = S.ranked(pool.withColumn("score", F.col("fused")).select("query_id", "point_id", "score", second.alias("judged")), "query_id", self.top_k)
        judged = S.gate(hits.withColumnRenamed("score", "fused").withColumnRenamed("judged", "score"))
        return judged.select("query_id", "point_id", F.col("fused").alias("score"), "rank"), corpus

    def _dense(self, variants: DataFrame, corpus: DataFrame, most: int, routed: bool) -> DataFrame:
        """By vectors; each topic's points meet only the questions that may have them, so no point is read for two topics."""
        out = None
        for kind in [*ROUTES, "other"] if routed else ["other"]:
            asked = variants.filter(F.col("_topic").isNull() | (F.col("_topic") == kind)).filter("question is not null")
            points = corpus.filter((F.col("_kind") == kind) & F.col("text").isNotNull())
            hits = S.similar_pairs(asked.select(F.col("key").alias("query_id"), self.encode(F.col("question")).alias("vec")), points.select("point_id", self.encode(F.col("text")).alias("vec")), top=most)
            out = hits if out is None else out.unionByName(hits)
        return S.ranked(out.drop("rank"), "query_id", most)

    def _sparse(self, variants: DataFrame, corpus: DataFrame, most: int, routed: bool) -> DataFrame:
        """By words, over a stored index of the whole corpus; each topic's points meet only the questions that may have them."""
        index = SparseIndex.build(corpus.select("point_id", "text", "_kind"), shared_place(corpus.sparkSession, "sparse"))
        out = None
        for kind in [*ROUTES, "other"] if routed else ["other"]:
            asked = variants.filter(F.col("_topic").isNull() | (F.col("_topic") == kind)).select(F.col("key").alias("query_id"), F.col("question").alias("text"))
            hits = index.search(asked, most, where=F.col("_kind") == kind, digits=9).drop("rank")
            out = hits if out is None else out.unionByName(hits)
        return S.ranked(out, "query_id", most)

    def _context(self, hits: DataFrame, corpus: DataFrame) -> DataFrame:
        """Parents in place of children; neighbours of hits of questions without any child."""
        if {"chunk_type", "parent_text"} <= set(corpus.columns):
            child = (F.col("chunk_type") == "child") & (F.col("parent_text") != "")
            hits = S.expandable(hits, "query_id", "chunk_type")
            lifted = S.lift_to_parent(hits.filter(child), "query_id", "act_id", "parent_text").select(hits.columns)
            hits = lifted.unionByName(hits.filter(~F.coalesce(child, F.lit(False))))
        else:
            hits = hits.withColumn("expand", F.lit(True))
        if not self.expand_context or "chunk_index" not in corpus.columns:
            return hits
        wide = S.neighbours(hits, corpus, "act_id", "chunk_index", "text")
        some = lambda c: F.when(F.col("expand") & (F.col(c) != ""), F.col(c))
        return wide.withColumn("text", F.concat_ws("\n\n", some("before"), F.col("text"), some("after")))
