"""Upkeep of an index, retrieval in hops, sketches and enrichment over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import analytics as A
from corpuskiln.operators import sketches as K
from corpuskiln.operators.sparse import SparseIndex, words
from corpuskiln.operators.store import shared_place
from corpuskiln.operators.versions import IndexVersions
from corpuskiln.plans.enrich import context_prefixes, with_prefix
from corpuskiln.plans.hops import multi_hop
from corpuskiln.plans.search_queries import _TERMS
from corpuskiln.registry import query, table


@query(
    "index_versions",
    "SELECT doc_id AS point_id, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END AS text_hash, CASE WHEN doc_id % 3 = 0 THEN source || ' 2' ELSE source END AS source FROM documents",
)
def index_versions(spark, sf):
    """All documents, then a third of them changed beside unchanged ones, then a batch that runs again; three versions and their merging."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("point_id"), F.md5("text").alias("text_hash"), "source")
    third = F.col("doc_id") % 3 == 0
    changed = docs.select(F.col("doc_id").alias("point_id"), F.when(third, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("text_hash"), F.when(third, F.concat("source", F.lit(" 2"))).otherwise(F.col("source")).alias("source"))
    index = IndexVersions(spark, shared_place(spark, "versions"))
    for epoch, batch in enumerate([rows, changed]):
        index.upsert(batch, "documents", epoch)
    index.upsert(rows, "documents", 1)  # committed already
    index.compact()
    return index.rows()


TOP, WORDS, HOPS, BUDGET, LONG = 5, 12, 3, 4500, 200
_HITS = """(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT query_id, point_id,
round(sum(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al)) * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM {asked} JOIN d USING (term) JOIN df USING (term) JOIN len USING (point_id), st GROUP BY 1, 2) QUALIFY rank <= 5)"""
_NEXT = f"""(SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: w <> '')[1:{WORDS}]) AS term
FROM (SELECT query_id, arg_min(point_id, rank) AS doc_id FROM {{new}} WHERE query_id IN (SELECT query_id FROM {{all}} JOIN documents ON doc_id = point_id GROUP BY 1 HAVING sum(least(length(text), 600)) <= {BUDGET})
AND query_id IN (SELECT item_id FROM benchmark WHERE length(text) > {LONG}) GROUP BY 1) JOIN documents USING (doc_id))"""


@query(
    "multi_hop",
    f"""WITH d AS MATERIALIZED ({_TERMS.format(id="doc_id", key="point_id", table="documents")}), len AS MATERIALIZED (SELECT point_id, sum(tf) AS len FROM d GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS al FROM len),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM d GROUP BY 1), q0 AS MATERIALIZED (SELECT DISTINCT query_id, term FROM ({_TERMS.format(id="item_id", key="query_id", table="benchmark")})),
h0 AS MATERIALIZED (SELECT 0 AS hop, * FROM {_HITS.format(asked="q0")}), q1 AS MATERIALIZED (SELECT * FROM {_NEXT.format(new="h0", all="h0")}), h1 AS MATERIALIZED (SELECT 1 AS hop, * FROM {_HITS.format(asked="q1")}),
a1 AS MATERIALIZED (FROM h0 UNION ALL FROM h1), n1 AS MATERIALIZED (FROM h1 WHERE (query_id, point_id) NOT IN (SELECT (query_id, point_id) FROM h0)),
q2 AS MATERIALIZED (SELECT * FROM {_NEXT.format(new="n1", all="a1")}), h2 AS MATERIALIZED (SELECT 2 AS hop, * FROM {_HITS.format(asked="q2")})
SELECT query_id, point_id, min(hop)::INTEGER AS hop, arg_min(score, hop) AS score, arg_min(rank, hop)::INTEGER AS rank FROM (FROM a1 UNION ALL FROM h2) GROUP BY 1, 2""",
)
def multi_hop_query(spark, sf):
    """Benchmark passages as questions, long ones as complex; the next question is the beginning of the best new hit."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "text")
    index = SparseIndex.build(docs, shared_place(spark, "sparse"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    questions = items.withColumn("class", F.when(F.length("text") > LONG, "complex").otherwise("simple"))

    def follow_up(new):
        best = new.groupBy("query_id").agg(F.min_by("text", "rank").alias("text"))
        return best.select("query_id", F.array_join(F.slice(words(F.col("text")), 1, WORDS), " ").alias("text"))

    return multi_hop(questions, lambda asked: index.search(asked, TOP).join(docs, "point_id"), follow_up, HOPS, BUDGET)


@query(
    "sketch_counts",
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, true AS users_near, true AS median_near, true AS bins_near FROM events GROUP BY event_type",
)
def sketch_counts(spark, sf):
    """Stored daily sketches, merged: do they give distinct users, median and a histogram of the values within their error bounds of the exact figures?"""
    events, place = table(spark, sf, "events"), shared_place(spark, "sketches")
    K.by_day(events, "ts", ["event_type"], "user_id", F.col("value")).write.partitionBy("day").parquet(place)
    whole = K.merged(spark.read.parquet(place), ["event_type"])
    edges = [-1e300, 10.0, 20.0, 40.0, 80.0, 1e300]
    bins = K.histogram(whole.select("event_type", "n", "items", "values"), "values", "n", edges)
    exact_bins = events.select("event_type", F.explode(F.array(*(F.struct(F.lit(b).alias("up_to"), ((F.col("value") > a) & (F.col("value") <= b)).cast("int").alias("in")) for a, b in zip(edges[:-1], edges[1:], strict=True)))).alias("b"))
    exact_bins = exact_bins.groupBy("event_type", "b.up_to").agg(F.sum("b.in").alias("exact_n"))
    bins = bins.join(exact_bins, ["event_type", "up_to"]).groupBy("event_type").agg(F.bool_and(F.abs(F.col("approx_n") - F.col("exact_n")) <= 0.05 * F.col("n") + 1).alias("bins_near"))
    asked = whole.select("event_type", K.distinct_count("items").alias("about"), K.quantile("values", 0.5).alias("middle"))
    exact = events.join(asked, "event_type").groupBy("event_type", "about", "middle").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") <= F.col("middle")).alias("below"))
    near = exact.select("event_type", "n", "n_users", (F.abs(F.col("about") - F.col("n_users")) <= 0.08 * F.col("n_users") + 1).alias("users_near"), (F.abs(F.col("below") - F.col("n") / 2) <= 0.04 * F.col("n") + 1).alias("median_near"))
    return near.join(bins, "event_type")


_LOGS = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('[{\"type\": \"', event_type, '\"}, {\"type\": \"\"}, {\"type\": null}, 7]') WHEN 2 THEN concat('[{\"type\": \"', event_type) WHEN 3 THEN concat('[', props, ', {\"type\": \"', event_type, '\"}]') END"


@query(
    "log_element_types",
    f"""SELECT type, count(*) AS n FROM (SELECT json_extract_string(e, '$.type') AS type FROM (SELECT unnest(CASE WHEN json_valid(logs) AND starts_with(logs, '[') THEN json_extract(logs, '$[*]') ELSE [] END) AS e
FROM (SELECT {_LOGS} AS logs FROM events ORDER BY ts DESC, event_id DESC LIMIT 200))) WHERE type <> '' GROUP BY 1""",
)
def log_element_types(spark, sf):
    """Types in the JSON lists of the newest 200 logs; some are malformed, no lists, null or hold elements of other kinds."""
    logs = table(spark, sf, "events").select("ts", "event_id", F.expr(_LOGS).alias("logs"))
    return A.json_elements(logs, "logs", [F.desc("ts"), F.desc("event_id")], 200, "type")


def _described(title: str, text: str) -> str:
    """Deterministic stand-in for a model: what the title and the length say; fails for texts that are too short to describe."""
    if len(text) < 40:
        raise ValueError("too short")
    return f"A text from {title}. It has {len(text)} characters. It goes on."


@query(
    "context_prefixes",
    "SELECT doc_id AS point_id, prefix, prefix = '' AS failed, md5(CASE WHEN prefix = '' THEN text ELSE prefix || chr(10) || chr(10) || text END) AS embed_md5 FROM (SELECT *, CASE WHEN length(text) < 40 THEN '' ELSE 'A text from ' || source || '. It has ' || length(text) || ' characters.' END AS prefix FROM documents)",
)
def context_prefixes_query(spark, sf):
    """A run over the documents with labels, then one that resumes with what is left or failed; the texts with their prefixes."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), F.col("source").alias("title"), "text")
    place = shared_place(spark, "prefixes")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("point_id"))
    context_prefixes(chunks.join(labels, "point_id", "left_semi"), None, _described).write.parquet(f"{place}/run=0")
    done = spark.read.parquet(f"{place}/run=0")
    context_prefixes(chunks, done, _described).write.parquet(f"{place}/run=1")
    made = done.filter("not failed").unionByName(spark.read.parquet(f"{place}/run=1"))
    shown = with_prefix(chunks, made).select("point_id", F.md5("embed_text").alias("embed_md5"))
    return made.join(shown, "point_id").select("point_id", "prefix", "failed", "embed_md5")
