"""Training sets and evaluation over conversations, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import dataset as D
from corpuskiln.registry import query, table


@query("history_last6", "SELECT conv_id, turn, role, left(text, 2000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 AND role IN ('user', 'assistant')")
def history_last6(spark, sf):
    return D.recent_turns(table(spark, sf, "conversations"), 6)


@query("chat_jsonl", "SELECT conv_id, string_agg('### ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS prompt, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def chat_jsonl(spark, sf):
    return D.chat_prompts(table(spark, sf, "conversations"))


@query("chat_records")
def chat_records(spark, sf):
    return D.chat_records(table(spark, sf, "conversations"))


@query("dataset_split", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.85) THEN 'train' WHEN r <= floor(n * 0.85) + floor(n * 0.10) THEN 'val' ELSE 'test' END AS split FROM o")
def dataset_split(spark, sf):
    return D.exact_split(table(spark, sf, "documents").select("doc_id"), "doc_id", {"train": 0.85, "val": 0.10, "test": 0.05}, 42)


@query("citation_refs", "WITH t AS (SELECT conv_id, turn, '[' || (turn + 1) || '] ' || role AS text FROM conversations), s AS (SELECT conv_id, list(role ORDER BY turn) AS sources FROM conversations GROUP BY 1) SELECT conv_id, turn, n, sources[n] AS source FROM (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x::INTEGER)) AS n FROM t) JOIN s USING (conv_id)")
def citation_refs(spark, sf):
    c = table(spark, sf, "conversations")
    answers = c.select("conv_id", "turn", F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), "role").alias("text"))
    sources = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("sources"))
    return D.resolve_citations(answers, sources, "conv_id", "text", "sources").select("conv_id", "turn", "n", "source")


@query("winloss", "SELECT count(*) FILTER (quality > toxic) AS wins, count(*) FILTER (quality < toxic) AS losses, count(*) FILTER (quality = toxic) AS ties, round(avg(quality), 4) AS avg_a, round(avg(toxic), 4) AS avg_b FROM labels")
def winloss(spark, sf):
    return D.win_loss(table(spark, sf, "labels"), "quality", "toxic")


@query("keyword_rate", "SELECT doc_id, round(len(list_filter(['the', 'und', 'que', 'les'], lambda k: contains(lower(text), k))) / 4.0::DOUBLE, 4) AS rate FROM documents")
def keyword_rate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(D.hit_rate(F.col("text"), F.array(*map(F.lit, ("the", "und", "que", "les")))), 4).alias("rate"))


@query("training_chunks", "SELECT doc_id, source FROM documents WHERE length(text) >= 100 AND source IN ('src1', 'src2', 'src3')")
def training_chunks(spark, sf):
    return table(spark, sf, "documents").filter((F.length("text") >= 100) & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source")


@query("question_pairs", "SELECT doc_id, 'Co wynika z: ' || left(text, 60) || '?' AS question, left(text, 200) AS answer FROM documents")
def question_pairs(spark, sf):
    return D.local_pairs(table(spark, sf, "documents"), "doc_id", "text")


@query("feedback_report", "SELECT doc_id, to_json({doc_id: doc_id, quality: quality, toxic: toxic}) AS line FROM labels")
def feedback_report(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.to_json(F.struct("doc_id", "quality", "toxic")).alias("line"))
