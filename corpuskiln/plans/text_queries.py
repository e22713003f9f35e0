"""Text queries: payloads, cleaning, chunks, identifiers, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.functions import chunk as C
from corpuskiln.functions import text as X
from corpuskiln.operators.state import last_write
from corpuskiln.registry import query, table
from corpuskiln.sources.readers import judgment_columns


@query("doc_payload", "SELECT doc_id, source, CASE WHEN source = 'src1' THEN 'legislation' WHEN source = 'src2' THEN 'judgment_sn' ELSE 'unknown' END AS source_type, lower(trim(CASE WHEN doc_id % 5 = 0 THEN ' UCHYLONY ' ELSE lang END)) IN ('uchylony', 'nieobowiązujący') AS is_repealed, md5(text) AS text_hash, greatest(1, length(text) // 4)::BIGINT AS approx_tokens, coalesce(try_cast(left((1990 + doc_id % 40)::VARCHAR || '-x', 4) AS INTEGER), 0) AS year FROM documents")
def doc_payload(spark, sf):
    d = table(spark, sf, "documents").withColumn("publisher", F.when(F.col("source") == "src1", "WDU").when(F.col("source") == "src2", "SUPREME").otherwise("?"))
    status = F.when(F.col("doc_id") % 5 == 0, F.lit(" UCHYLONY ")).otherwise(F.col("lang"))
    year = F.concat((1990 + F.col("doc_id") % 40).cast("string"), F.lit("-x"))
    return d.select("doc_id", "source", X.source_type(F.col("publisher"), F.col("source"), "unknown").alias("source_type"), X.is_repealed(status).alias("is_repealed"), X.text_hash(F.col("text")).alias("text_hash"), X.approx_tokens(F.col("text")).alias("approx_tokens"), X.year_of(year).alias("year"))


@query("doc_clean_ws", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(text, '-\s*\d+\s*-', '', 'g'), '_{5,}', '', 'g')), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9))) AS clean_hash FROM documents")
def doc_clean_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("clean_hash"))


@query("html_strip", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_hash FROM pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.html_to_words(F.col("html"))).alias("text_hash"))


@query("html_lines")
def html_lines(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_to_lines(F.col("html")).alias("text"))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("h"))


@query("paragraph_explode", "SELECT doc_id, idx::INTEGER - 1 AS chunk_index, n::INTEGER AS total_chunks, p AS chunk FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS idx, len(ps) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 50) AS ps FROM documents))")
def paragraph_explode(spark, sf):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= C.LEAST)
    return C.explode_chunks(table(spark, sf, "documents").withColumn("ps", parts), "ps", "doc_id").select("doc_id", "chunk_index", "total_chunks", "chunk")


@query("chunk_overlap")
def chunk_overlap(spark, sf):
    d = table(spark, sf, "documents").withColumn("cs", C.chunks(F.col("text"), paragraph="\n"))
    return C.explode_chunks(d, "cs", "doc_id", "source")


@query("child_chunks")
def child_chunks(spark, sf):
    return C.child_chunks(chunk_overlap(spark, sf), "doc_id", paragraph="\n").select("doc_id", "parent_chunk_id", "child_index", "total_children", "child_text")


@query("word_chunks", r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 64 - 1, 0) + 1, 448)) AS pos FROM w WHERE len(ws) > 0) SELECT doc_id, (pos // 448)::INTEGER AS chunk_index, md5(array_to_string(ws[pos + 1:pos + 512], ' ')) AS h FROM s")
def word_chunks(spark, sf):
    d = table(spark, sf, "documents").withColumn("cs", C.word_chunks(F.col("text")))
    return C.explode_chunks(d, "cs", "doc_id").select("doc_id", "chunk_index", F.md5("chunk").alias("h"))


@query("dedup_exact", "SELECT doc_id, md5(text) AS text_hash FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def dedup_exact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_hash")  # partial minima, so copies cost nothing


@query("uuid5_ids", "WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '__chunk' || doc_id)) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INTEGER % 4 + 1)::BIGINT, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h")
def uuid5_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.point_id(F.col("source"), F.col("doc_id")).alias("point_id"))


@query("citation_string", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'act_id=' || source ELSE lang || ' (' || (2000 + doc_id % 20) || ')' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' poz. ' || doc_id END END AS cite FROM documents")
def citation_string(spark, sf):
    d = table(spark, sf, "documents")
    none = F.col("doc_id") % 4 == 0
    title, year = F.when(~none, F.col("lang")), F.when(~none, (2000 + F.col("doc_id") % 20).cast("string"))
    pos = F.when(~none & (F.col("doc_id") % 3 != 0), F.col("doc_id").cast("string"))
    return d.select("doc_id", X.citation(title, year, pos, F.lit(""), F.col("source")).alias("cite"))


@query("link_build", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://isap.sejm.gov.pl/isap.nsf/DocDetails.xsp?id=WDU' || (2000 + doc_id % 20) || lpad(doc_id::VARCHAR, 7, '0') ELSE 'https://isap.sejm.gov.pl/isap.nsf/search.xsp?q=' || source END AS link FROM documents")
def link_build(spark, sf):
    eli = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("WDU/"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("/54/"), F.col("doc_id").cast("string"))).otherwise(F.lit("?"))
    return table(spark, sf, "documents").select("doc_id", X.external_link(eli, F.col("source")).alias("link"))


@query("eli_normalise", "SELECT doc_id, 'WDU/' || (2000 + doc_id % 20) || '/54/' || (doc_id % 9999) AS eli FROM documents")
def eli_normalise(spark, sf):
    code = F.format_string("WDU%d%03d%04d", 2000 + F.col("doc_id") % 20, F.lit(54), F.col("doc_id") % 9999)
    return table(spark, sf, "documents").select("doc_id", X.normalise_eli(code).alias("eli"))


@query("cache_keys", "SELECT item_id, md5(lower(trim(text)) || '|' || 'tax' || '|' || '5') AS k FROM benchmark")
def cache_keys(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.cache_key(F.col("text"), F.lit("tax"), F.lit("5")).alias("k"))


@query("slugs", r"SELECT page_id, regexp_replace(lower(url), '[^a-z0-9._-]', '_', 'g') AS file, regexp_replace(regexp_replace(left(url, 40), '[^0-9A-Za-z ]', '', 'g'), ' +', '_', 'g') AS slug FROM pages")
def slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.safe_filename(F.col("url")).alias("file"), X.slug(F.col("url")).alias("slug"))


@query("complexity_route", r"SELECT doc_id, CASE WHEN len(string_split_regex(trim(text), '\s+')) <= 4 AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(the|la)([^\p{L}\p{N}_]|$)') THEN 'trivial' WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(tion|und der)([^\p{L}\p{N}_]|$)') THEN 'complex' ELSE 'simple' END AS class FROM documents")
def complexity_route(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.complexity(F.col("text"), ["the\\b", "la\\b"], ["the", "la"], ["tion", "und der"], ["zzzz"]).alias("class"))


@query("source_route", r"WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x IN ('the', 'of'))) AS leg, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x IN ('und', 'der'))) AS jud, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x IN ('que', 'la'))) AS tax FROM documents) SELECT doc_id, CASE WHEN tax >= 2 AND jud = 0 THEN 'tax' WHEN jud >= 2 AND leg = 0 THEN 'judgment' WHEN leg >= 2 AND jud = 0 THEN 'legislation' END AS topic FROM c")
def source_route(spark, sf):
    words = {"legislation": ["the", "of"], "judgment": ["und", "der"], "tax": ["que", "la"]}
    return table(spark, sf, "documents").select("doc_id", X.topic(F.col("text"), words).alias("topic"))


@query("ellipsis_500", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS preview FROM documents")
def ellipsis_500(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.ellipsis(F.col("text"), 500).alias("preview"))


@query("latest_version", "SELECT text_hash, doc_id FROM (SELECT md5(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def latest_version(spark, sf):
    return last_write(table(spark, sf, "documents").select(F.md5("text").alias("text_hash"), "doc_id"), ["text_hash"], [F.desc("doc_id")])


_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+\z', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_WS}+'), lambda w: w <> '')"


@query(
    "sentence_chunks",
    rf"""WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_WS}+|\n\n+', '\1' || chr(30), 'g'), chr(30)) AS ss FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, ss, list_transform(ss, lambda x: len({_words("x")})) AS n FROM s), c AS (SELECT doc_id, ss, list_transform(range(1, len(n) + 1), lambda k: list_sum(n[1:k])) AS c FROM n),
r(doc_id, ss, c, a, b, k, carried, chunk) AS (
SELECT doc_id, ss, c, 1::BIGINT, e, 0, '', array_to_string(ss[1:e], ' ') FROM (SELECT *, 1 + len(list_filter(range(2, len(ss) + 1), lambda j: c[j] <= 512)) AS e FROM c)
UNION ALL SELECT doc_id, ss, c, b + 1, e, k + 1, w, w || ' ' || array_to_string(ss[b + 1:e], ' ') FROM (SELECT doc_id, ss, c, b, k, array_to_string(ws, ' ') AS w, b + 1 + len(list_filter(range(b + 2, len(ss) + 1), lambda j: len(ws) + c[j] - c[b] <= 512)) AS e
FROM (SELECT *, {_words("chunk")}[-64:] AS ws FROM r WHERE b < len(ss))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS chunk_index, md5(t) AS h FROM (SELECT doc_id, k, {_strip("chunk")} AS t FROM r) WHERE t <> ''""",
)
def sentence_chunks(spark, sf):
    """Chunks of private documents, by sentences with carried words."""
    d = table(spark, sf, "documents").withColumn("cs", C.sentence_chunks(F.col("text")))
    return C.explode_chunks(d, "cs", "doc_id").select("doc_id", "chunk_index", F.md5("chunk").alias("h"))


@query(
    "act_articles",
    rf"""WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
q AS (SELECT *, list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i = 1 THEN {_strip("ls[1]")} WHEN {_strip("ls[i]")} = '' THEN '' ELSE 'art. 5b' || chr(10) || chr(10) || regexp_replace(ls[i], '{_WS}+\z', '') END), lambda x: x <> '') AS ps FROM p)
SELECT doc_id, unnest(CASE WHEN len(ls) < 3 OR len(ps) < 2 THEN [md5(replace(text, chr(10), chr(10) || ' art. 5b ' || chr(10)))] ELSE list_transform(list_filter(ps, lambda x: length(x) >= 50), lambda x: md5(x)) END) AS h FROM q""",
)
def act_articles(spark, sf):
    """Documents as acts, each of whose lines but the first stands under a header of its own in lower case."""
    act = F.replace("text", F.lit("\n"), F.lit("\n art. 5b \n"))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.transform(C.articles(act), F.md5)).alias("h"))


@query(
    "judgment_sections",
    rf"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {_strip("x")}) AS ls FROM documents),
q AS (SELECT doc_id, 'preamble' AS section, ls[1] AS t FROM p UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'thesis' ELSE 'justification' END, array_to_string(list_filter(ls[2:], lambda x: x <> ''), chr(10) || chr(10)) FROM p)
SELECT doc_id, section, md5(t) AS h FROM q WHERE length(t) >= 50""",
)
def judgment_sections(spark, sf):
    """Documents as judgments, each of whose lines but the first stands under the same header, which is opened again and again."""
    header = F.when(F.col("doc_id") % 2 == 0, "\n\tTezy \n").otherwise("\nuzasadnienie\n")
    d = table(spark, sf, "documents").withColumn("t", F.replace("text", F.lit("\n"), header))
    return C.sections(d, "doc_id", "t").select("doc_id", "section", F.md5("section_text").alias("h"))


@query(
    "judgment_titles",
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS cn, CASE WHEN doc_id % 4 > 0 THEN (1990 + doc_id % 30) || '-05-01' END AS d, doc_id % 7 AS m FROM documents)
SELECT CASE WHEN m = 6 THEN 'saos_' || doc_id ELSE 'j' || doc_id END AS id, ['', 'Sąd Najwyższy', 'Sąd Administracyjny (NSA/WSA)', 'Trybunał Konstytucyjny', 'Sąd Powszechny', 'Krajowa Izba Odwoławcza', 'OTHER'][m + 1] || ' | ' || coalesce(cn, '') || ' | ' || coalesce(d, '') AS title,
coalesce(left(d, 4), '') AS year, ['', 'SUPREME', 'ADMINISTRATIVE', 'CONSTITUTIONAL_TRIBUNAL', 'COMMON', 'NATIONAL_APPEAL_CHAMBER', 'OTHER'][m + 1] AS publisher, coalesce(cn, '') AS pos, '' AS url FROM p""",
)
def judgment_titles(spark, sf):
    """Documents as judgments of all types of courts, one of them unknown, with missing types, cases, dates and ids."""
    m, i = F.col("doc_id") % 7, F.col("doc_id")
    kinds = F.array(*(F.lit(k) for k in [None, "SUPREME", "ADMINISTRATIVE", "CONSTITUTIONAL_TRIBUNAL", "COMMON", "NATIONAL_APPEAL_CHAMBER", "OTHER"]))
    rows = table(spark, sf, "documents").select(
        F.when(m != 6, F.concat(F.lit("j"), i)).alias("id"),
        i.cast("string").alias("saos_id"),
        F.get(kinds, m.cast("int")).alias("court_type"),
        F.when(i % 9 != 0, F.col("source")).alias("case_number"),
        F.when(i % 4 > 0, F.concat((1990 + i % 30).cast("string"), F.lit("-05-01"))).alias("judgment_date"),
        F.lit(None).cast("string").alias("source_url"),
    )
    return rows.select(*(c.alias(n) for n, c in judgment_columns().items()))
