"""Queries on what goes to models and clients: filters of requests, prompts, badges, small JSON, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.functions import display as D
from corpuskiln.operators import search as S
from corpuskiln.registry import query, table

_ACTS = """(SELECT doc_id, ['WDU', 'KIS', 'SUPREME', 'WMP', 'COMMON'][(doc_id % 5 + 1)::INTEGER] AS publisher, (2000 + doc_id % 25)::VARCHAR AS year,
2000 + doc_id % 25 AS valid_from_year, doc_id % 4 = 0 AS is_repealed FROM documents)"""


def _acts(spark, sf):
    """Documents with a payload made from their ids."""
    d = table(spark, sf, "documents")
    publisher = F.element_at(F.array(*map(F.lit, ("WDU", "KIS", "SUPREME", "WMP", "COMMON"))), (F.col("doc_id") % 5 + 1).cast("int"))
    year = 2000 + F.col("doc_id") % 25
    return d.select("doc_id", publisher.alias("publisher"), year.cast("string").alias("year"), year.alias("valid_from_year"), (F.col("doc_id") % 4 == 0).alias("is_repealed"))


_REQUESTS = {
    "law in force": {"source_type": "legislation", "exclude_repealed": True, "as_of_year": 2015},
    "judgments": {"source_type": "judgment_sn", "exclude_repealed": True},
    "one year": {"year": 2010},
    "years": {"year_from": 2005, "year_to": 2012, "publisher": "KIS"},
    "all in force": {"exclude_repealed": True},
    "unknown type": {"source_type": "press"},
}


@query(
    "corpus_filters",
    f"""SELECT 'law in force' AS request, doc_id FROM {_ACTS} WHERE publisher IN ('WDU', 'WMP') AND NOT is_repealed AND valid_from_year <= 2015
    UNION ALL SELECT 'judgments', doc_id FROM {_ACTS} WHERE publisher = 'SUPREME' UNION ALL SELECT 'one year', doc_id FROM {_ACTS} WHERE year = '2010'
    UNION ALL SELECT 'years', doc_id FROM {_ACTS} WHERE publisher = 'KIS' AND year BETWEEN '2005' AND '2012'
    UNION ALL SELECT 'all in force', doc_id FROM {_ACTS} WHERE NOT is_repealed UNION ALL SELECT 'unknown type', doc_id FROM {_ACTS}""",
)
def corpus_filters(spark, sf):
    """Several requests in one scan: each row carries the names of the requests that it satisfies."""
    acts = _acts(spark, sf)
    named = []
    for name, request in _REQUESTS.items():
        passes = F.lit(True)
        for f in S.corpus_filters(**request):
            passes = passes & f
        named.append(F.when(passes, F.lit(name)))
    return acts.select(F.explode(F.array_compact(F.array(*named))).alias("request"), "doc_id")


@query(
    "request_bounds",
    "SELECT conv_id, turn, coalesce(length(text) BETWEEN 5 AND 2000 AND turn BETWEEN 1 AND 20, false) AS valid FROM conversations",
)
def request_bounds(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", D.valid_request(F.col("text"), F.col("turn")).alias("valid"))


@query(
    "ask_prompt",
    """SELECT conv_id, turn, md5(CASE WHEN before IS NULL THEN 'PYTANIE: ' || text || chr(10) || chr(10) || 'ODPOWIEDŹ:' ELSE
    'Na podstawie poniższych przepisów prawnych odpowiedz na pytanie. Cytuj źródła używając numerów w nawiasach kwadratowych, np. [1], [2], zgodnie z numeracją w sekcji PRZEPISY poniżej.'
    || chr(10) || chr(10) || 'PRZEPISY:' || chr(10) || before || chr(10) || chr(10) || 'PYTANIE: ' || text || chr(10) || chr(10) || 'ODPOWIEDŹ (powołuj się na [numer] przy każdym twierdzeniu):' END) AS prompt_hash
    FROM (SELECT conv_id, turn, text, nullif(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)""",
)
def ask_prompt(spark, sf):
    """Every turn as a question with the turn before as its context."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.md5(D.prompt(F.col("text"), F.col("before"))).alias("prompt_hash"))


@query(
    "embed_texts",
    """SELECT doc_id, md5('[query]: ' || text) AS as_query, md5(CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END) AS as_chunk,
    md5(CASE WHEN lang IS NOT NULL THEN 'Tytuł dokumentu: ' || lang || chr(10) || chr(10) ELSE '' END || 'Fragment tekstu:' || chr(10) || substr(coalesce(text, ''), 1, 800)) AS context_message,
    '[1] ' || coalesce(lang, source) || ' (' || (2000 + doc_id % 25) || ')' || CASE WHEN doc_id % 3 = 0 THEN ' poz. ' || doc_id ELSE '' END AS header FROM documents""",
)
def embed_texts(spark, sf):
    d = table(spark, sf, "documents")
    text, doc = F.col("text"), F.col("doc_id")
    header = D.source_header(F.col("lang"), F.col("source"), 2000 + doc % 25, F.when(doc % 3 == 0, doc.cast("string")))
    as_chunk = D.embed_text(text, F.when(doc % 2 == 0, F.col("source")))
    return d.select(
        "doc_id", F.md5(D.query_text(text)).alias("as_query"), F.md5(as_chunk).alias("as_chunk"), F.md5(D.context_message(F.col("lang"), text)).alias("context_message"), header.alias("header")
    )


@query(
    "regulation_prefix",
    """SELECT o_custkey, CASE WHEN len(c) > 0 THEN 'Podstawy prawne: ' || array_to_string(c[1:10], '; ') || chr(10) || chr(10) ELSE '' END AS prefix FROM (SELECT o_custkey,
    list_filter(list(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || ' ' || o_orderkey END ORDER BY o_orderkey), lambda x: x <> '') AS c FROM orders GROUP BY o_custkey)""",
)
def regulation_prefix(spark, sf):
    """Only the ten citations that are shown are gathered for a key."""
    from corpuskiln.operators.analytics import top_n

    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    cited = o.filter("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("c"))
    first = top_n(cited, "o_custkey", [F.asc("o_orderkey")], 10)
    lists = first.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("l"))
    return o.select("o_custkey").distinct().join(lists, "o_custkey", "left").select("o_custkey", D.regulations_prefix(F.col("l")).alias("prefix"))


@query(
    "score_badges",
    """SELECT event_id, pct, CASE WHEN pct >= 70 THEN 'high' WHEN pct >= 45 THEN 'middle' ELSE 'low' END AS score_band,
    CASE WHEN pct >= 90 THEN 'red' WHEN pct >= 80 THEN 'orange' ELSE 'yellow' END AS alert_band FROM (SELECT event_id,
    floor(CASE WHEN s > 1 OR s < 0 THEN 1 / (1 + exp(-s)) ELSE s END * 100 + 0.5)::INTEGER AS pct FROM (SELECT event_id, value / 40 - 0.2 AS s FROM events))""",
)
def score_badges(spark, sf):
    e = table(spark, sf, "events").select("event_id", D.score_percent(F.col("value") / 40 - 0.2).alias("pct"))
    pct = F.col("pct")
    return e.select("event_id", "pct", D.band(pct, {"high": 70, "middle": 45}, "low").alias("score_band"), D.band(pct, {"red": 90, "orange": 80}, "yellow").alias("alert_band"))


@query(
    "relative_times",
    """SELECT event_id, CASE WHEN m < 1 THEN 'przed chwilą' WHEN m < 60 THEN m || ' min temu' WHEN m // 60 < 24 THEN (m // 60) || ' godz. temu' ELSE strftime(ts, '%d.%m') END AS label
    FROM (SELECT event_id, ts, floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000)::BIGINT AS m FROM events)""",
)
def relative_times(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", D.relative_time(F.col("ts"), now).alias("label"))


@query(
    "small_json",
    """SELECT event_id, (event_id % 4)::INTEGER AS n_sources, CASE WHEN event_id % 2 = 0 THEN event_type END AS question, props AS payload FROM events""",
)
def small_json(spark, sf):
    """Lengths of JSON lists, pairs salvaged from a chatty answer, and payloads out of event-stream frames."""
    e = table(spark, sf, "events")
    listed = F.to_json(F.slice(F.array(*map(F.lit, (1, 2, 3))), 1, (F.col("event_id") % 4).cast("int")))
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('Oto: [{"question": "'), "event_type", F.lit('", "answer": "a"}, {"question": "q"}] Koniec.'))).otherwise("[oops")
    received = F.concat(F.lit(": ping\n"), D.stream_frame(F.col("props")), F.lit("event: end\n"))
    return e.select(
        "event_id",
        D.json_list_size(listed).cast("int").alias("n_sources"),
        F.get(D.salvage_pairs(answer), F.lit(0))["question"].alias("question"),
        F.get(D.stream_payloads(received), F.lit(0)).alias("payload"),
    )


@query(
    "template_fields",
    """SELECT c_custkey, trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END) <> '' AS complete,
    'Nazwa: ' || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END || chr(10) || 'Segment: ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '(nie podano)' END AS filled FROM customer""",
)
def template_fields(spark, sf):
    field = lambda key, label, required: F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(required).alias("required"))
    fields = F.array(field("name", "Nazwa", True), field("segment", "Segment", False))
    name = F.create_map(F.lit("name"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")))
    values = F.when(F.col("c_custkey") % 2 == 0, F.map_concat(name, F.create_map(F.lit("segment"), "c_mktsegment"))).otherwise(name)
    return table(spark, sf, "customer").select("c_custkey", D.required_filled(fields, values).alias("complete"), D.filled_fields(fields, values).alias("filled"))


@query(
    "second_ranking",
    """WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS point_id, count(*) OVER (PARTITION BY o_custkey) > 12 AS reranked, o_totalprice, o_orderkey % 1000 AS ce,
    bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS child FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN ce ELSE o_totalprice END DESC, point_id) AS rank FROM c)
    SELECT query_id, point_id, rank::INTEGER AS rank, reranked, NOT child AS expand FROM r WHERE rank <= 12""",
)
def second_ranking(spark, sf):
    """Customers as queries with their orders as candidates."""
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "child").alias("kind")
    pool = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("point_id"), "o_totalprice", kind)
    scored = S.second_ranking(S.expandable(pool, "query_id", "kind"), "query_id", 12, F.col("o_totalprice"), (F.col("point_id") % 1000).cast("double"))
    return S.ranked(scored, "query_id", 12).select("query_id", "point_id", "rank", "reranked", "expand")


@query(
    "with_private",
    """WITH p AS (SELECT o_custkey AS query_id, o_orderkey AS point_id, o_totalprice AS score, 'public' AS source FROM orders WHERE o_orderkey % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 6),
    v AS (SELECT o_custkey AS query_id, o_orderkey AS point_id, o_totalprice AS score, 'private' AS source FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = o_custkey % 3
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5)
    SELECT query_id, point_id, source, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, point_id) AS rank FROM (FROM p UNION ALL FROM v)) WHERE rank <= 8""",
)
def with_private(spark, sf):
    """Public and own private hits of each asking user; private rows belong to the user whose id has their remainder."""
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("point_id"), F.col("o_totalprice").alias("score"))
    public = S.ranked(hits.filter("point_id % 2 = 0"), "query_id", 6)
    return S.with_private(public, hits.filter("point_id % 2 = 1"), F.col("point_id") % 3 == F.col("query_id") % 3, "query_id").select("query_id", "point_id", "source", "rank")


@query(
    "agent_gathered",
    "SELECT l_orderkey AS query_id, l_suppkey AS point_id, min(l_linenumber) AS step FROM lineitem GROUP BY 1, 2",
)
def agent_gathered(spark, sf):
    """Lines of an order as an agent's steps: each source once, at the step that found it first."""
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("point_id"), F.col("l_linenumber").alias("step"))
    return S.gathered(steps, "query_id", ["point_id"], "step")


@query(
    "severity_first",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id)::INTEGER AS place FROM events",
)
def severity_first(spark, sf):
    """Serious rows before the others, in their order otherwise."""
    from corpuskiln.operators.analytics import in_order

    return in_order(table(spark, sf, "events"), "user_id", [F.when(F.col("event_type") == "error", 0).otherwise(1), F.col("event_id")], "place").select("user_id", "event_id", "place")


@query(
    "winner_per_question",
    """SELECT doc_id, CASE WHEN b IS NULL THEN NULL WHEN a > b THEN 'ours' WHEN b > a THEN 'theirs' ELSE 'tie' END AS winner
    FROM (SELECT doc_id, quality AS a, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS b FROM labels)""",
)
def winner_per_question(spark, sf):
    from corpuskiln.operators.analytics import winner

    theirs = F.when(F.col("doc_id") % 5 != 0, F.col("toxic"))
    return table(spark, sf, "labels").select("doc_id", winner(F.col("quality"), theirs, "ours", "theirs").alias("winner"))


@query("file_counts", "SELECT 'documents.parquet' AS file, count(*) AS n FROM documents")
def file_counts(spark, sf):
    from corpuskiln.sources.readers import counts_by_file

    return counts_by_file(table(spark, sf, "documents"), r"([^/]+\.parquet)")


@query(
    "judgment_parts",
    """WITH d AS (SELECT doc_id, source, text, [struct_pack(k := 'thesis', t := CASE WHEN doc_id % 3 = 0 THEN left(text, 200) ELSE '' END),
    struct_pack(k := 'ruling', t := CASE WHEN doc_id % 4 = 0 THEN substr(text, 20, 30) ELSE '' END), struct_pack(k := 'justification', t := CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END)] AS s FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, k, trim('[' || source || '] ' || trim(t, ' '), ' ') AS t FROM (SELECT doc_id, source, unnest(s, recursive := true) FROM d) WHERE trim(t, ' ') <> ''),
    q AS (SELECT * FROM p WHERE k = 'justification' OR length(t) >= 50)
    SELECT doc_id, k AS section, md5(t) AS text_hash FROM q UNION ALL SELECT doc_id, 'full', md5(trim('[' || source || '] ' || text, ' ')) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM q)""",
)
def judgment_parts(spark, sf):
    """Sections cut from documents by rule, put together as a judgment's are."""
    from corpuskiln.sources.readers import judgment_parts as parts

    doc = F.col("doc_id")
    cut = table(spark, sf, "documents").filter("text is not null").select(
        "doc_id",
        F.concat(F.lit("["), "source", F.lit("] ")).alias("prefix"),
        F.when(doc % 3 == 0, F.substring("text", 1, 200)).alias("thesis"),
        F.when(doc % 4 == 0, F.substring("text", 20, 30)).alias("ruling"),
        F.lit(None).cast("string").alias("preamble"),
        F.when(doc % 2 == 0, F.col("text")).alias("justification"),
        F.col("text").alias("full"),
    )
    return parts(cut, "doc_id", "prefix").select("doc_id", "section", F.md5("text").alias("text_hash"))
