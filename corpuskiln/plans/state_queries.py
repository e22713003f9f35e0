"""State, streaming-equivalent and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import state as S
from corpuskiln.registry import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_hash"), "source")


@query("incremental_antijoin", "SELECT doc_id, md5(text) AS text_hash FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 <> 0 AND md5(o.text) = md5(documents.text) AND o.doc_id = documents.doc_id)")
def incremental_antijoin(spark, sf):
    d = _docs(spark, sf)
    return S.unseen(d, d.filter("doc_id % 3 <> 0"), ["doc_id", "text_hash"]).select("doc_id", "text_hash")


@query("upsert_merge", "SELECT doc_id, md5(text) AS text_hash, 'old' AS version FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, md5(text || '!'), 'new' FROM documents WHERE doc_id % 4 = 0")
def upsert_merge(spark, sf):
    d = table(spark, sf, "documents")
    base = d.select("doc_id", F.md5("text").alias("text_hash"), F.lit("old").alias("version"))
    return S.merge_by_key(base, d.filter("doc_id % 4 = 0").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("text_hash"), F.lit("new").alias("version")), ["doc_id"])


@query("resume_antijoin", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    return S.unseen(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("feedback_join", "SELECT l.doc_id, d.source, d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)")
def feedback_join(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "source", "lang", "quality", "toxic")


@query("feedback_upsert", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def feedback_upsert(spark, sf):
    return S.last_write(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("retention_keep_n", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def retention_keep_n(spark, sf):
    return S.retain_newest(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "ts")


@query("status_by_log", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS since FROM events GROUP BY user_id")
def status_by_log(spark, sf):
    return S.current_status(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


@query("state_transition", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'answered' WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '2%' THEN 'closed' ELSE o_orderstatus END AS new_state FROM orders")
def state_transition(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("event"))
    return S.transition(o, "o_orderstatus", "event", {("O", "1"): "answered", ("F", "2"): "closed"}).drop("event")


@query("soft_delete_active", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0")
def soft_delete_active(spark, sf):
    rows = table(spark, sf, "customer").withColumn("revoked_at", F.when(F.col("c_custkey") % 7 == 0, F.lit("2024-01-01").cast("timestamp_ntz")))
    return rows.filter("revoked_at is null").select("c_custkey", "c_mktsegment")


@query("micro_batch_overlap", "SELECT event_id, user_id, event_type FROM events")
def micro_batch_overlap(spark, sf):
    """Eight-day slices every seven days: the day that two slices share is taken once."""
    e = table(spark, sf, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    both = e.withColumn("slice", F.explode(F.when((day % 7 == 6), F.array(F.floor(day / 7), F.floor(day / 7) + 1)).otherwise(F.array(F.floor(day / 7)))))
    return S.last_write(both, ["event_id"], [F.asc("slice")]).select("event_id", "user_id", "event_type")


@query("rate_limit_offered", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS offered FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events)")
def rate_limit_offered(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return S.offered_load(e, "user_id", F.col("s"), 3600, "event_id")


@query("rate_limit_admit")
def rate_limit_admit(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    return S.admit(e, "user_id", "t", 3, 6 * 3600.0, "event_id")


@query("subs_users_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def subs_users_join(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("subscribers_per_act", "WITH first AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT c_custkey, o_orderkey, c_name FROM first JOIN customer ON o_custkey = c_custkey WHERE c_name IS NOT NULL")
def subscribers_per_act(spark, sf):
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return first.join(table(spark, sf, "customer").filter("c_name is not null"), "c_custkey").select("c_custkey", "o_orderkey", "c_name").dropDuplicates(["c_custkey", "o_orderkey"])


@query("fk_lookup_nullable", "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def fk_lookup_nullable(spark, sf):
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    return table(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query("semi_join_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_join_exists(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("membership_flag", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS subscribed FROM customer")
def membership_flag(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("s")).distinct()
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit(False)).alias("subscribed"))


@query("consecutive_diff", "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
def consecutive_diff(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


@query("asof_year_filter", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) <= 1995 AND year(o_orderdate) BETWEEN 1993 AND 1996")
def asof_year_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderdate")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1993-01-01", "1996-01-01"))  # whole years as a range, so that the scan prunes
    return o.filter((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).select("o_orderkey", "year")


@query("contains_or_search", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(lower(p_type), 'small')")
def contains_or_search(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(F.col("p_name").contains("ring") | F.lower("p_type").contains("small")).select("p_partkey", "p_name")


@query("label_overlap", "SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['de', 'src3', 'src7'])")
def label_overlap(spark, sf):
    return table(spark, sf, "documents").filter(F.arrays_overlap(F.array("lang", "source"), F.array(*map(F.lit, ("de", "src3", "src7"))))).select("doc_id")


@query("domain_allowed", "SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h FROM pages)")
def domain_allowed(spark, sf):
    from corpuskiln.functions.text import host_allowed

    return table(spark, sf, "pages").select("page_id", host_allowed(F.col("url"), F.lit("example.com, other.test")).alias("allowed"))
