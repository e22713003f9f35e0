"""Queries on user tables: owner-checked changes, subscriptions, shares, digests, history, caching."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import account as A
from corpuskiln.operators import state as S
from corpuskiln.registry import query, table


def _events(spark, sf):
    return table(spark, sf, "events")


def _now(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "owner_delete",
    "SELECT event_id, user_id FROM events WHERE NOT (event_id % 10 = 3 AND event_id % 20 = 3)",
)
def owner_delete(spark, sf):
    """Every tenth row is to go, half of them asked for by another user, which changes nothing."""
    e = _events(spark, sf).select("event_id", "user_id")
    asker = F.when(F.col("event_id") % 20 == 3, F.col("user_id")).otherwise(F.col("user_id") + 1)
    return A.delete_owned(e, e.filter("event_id % 10 = 3").select("event_id", asker.alias("user_id")), "event_id", "user_id")


@query(
    "mark_read",
    "SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN ts WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS read_at FROM events",
)
def mark_read(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("read_at"))
    return A.mark_read(e, e.filter("event_id % 6 = 0"), "event_id", "user_id", "read_at", _now("2024-02-01 00:00:00")).select("event_id", "user_id", "read_at")


@query(
    "tier_update",
    """SELECT user_id, CASE WHEN status IN ('active', 'trialing') THEN tier ELSE 'free' END AS tier, period_end AS expires_unix FROM (
    SELECT user_id, CASE event_type WHEN 'purchase' THEN 'active' WHEN 'signup' THEN 'trialing' ELSE 'canceled' END AS status,
    CASE WHEN value >= 30 THEN 'kancelaria' ELSE 'pro' END AS tier, 1704067200 + 86400 * (event_id % 30) AS period_end FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""",
)
def tier_update(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "active").when(F.col("event_type") == "signup", "trialing").otherwise("canceled")
    tier = F.when(F.col("value") >= 30, "kancelaria").otherwise("pro")
    e = _events(spark, sf).select("user_id", "ts", "event_id", status.alias("status"), tier.alias("tier"), (1704067200 + 86400 * (F.col("event_id") % 30)).alias("period_end"))
    return A.tiers_after(e, "user_id", ["ts", "event_id"]).select("user_id", "tier", F.unix_seconds("expires_at").alias("expires_unix"))


@query(
    "settings_patch",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment,
    CASE WHEN c_custkey % 5 = 0 THEN false ELSE c_acctbal > 0 END AS newsletter FROM customer""",
)
def settings_patch(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("newsletter"))
    patch = c.filter("c_custkey % 3 = 0 or c_custkey % 5 = 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "PATCHED").alias("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, F.lit(False)).alias("newsletter")
    )
    return A.patched(c, patch, "c_custkey")


@query(
    "share_alive",
    """SELECT o_orderkey, expires_at FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE
    o_orderdate + to_days(greatest(1, least(365, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 500 END, 30)))::INTEGER) END AS expires_at FROM orders)
    WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '1996-06-01 00:00:00'""",
)
def share_alive(spark, sf):
    days = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 500)
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, A.expiry(F.col("o_orderdate"), days)).alias("expires_at"))
    return o.filter(A.alive(F.col("expires_at"), _now("1996-06-01 00:00:00")))


@query(
    "weekly_digest",
    """SELECT user_id, alert_id, rank::INTEGER AS rank FROM (SELECT user_id, event_id AS alert_id,
    row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
    WHERE event_id % 3 <> 0 AND ts >= TIMESTAMP '2024-01-23 12:00:00' AND user_id % 5 <> 0 AND user_id % 4 <> 0 AND user_id % 3 <> 1) WHERE rank <= 10""",
)
def weekly_digest(spark, sf):
    e = _events(spark, sf)
    last = F.when(F.col("user_id") % 3 == 1, _now("2024-01-29 00:00:00")).when(F.col("user_id") % 3 == 2, _now("2024-01-10 00:00:00"))
    mail = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("u"), "user_id"))
    users = e.select("user_id").distinct().select("user_id", (F.col("user_id") % 5 != 0).alias("enabled"), mail.alias("email"), last.alias("last_sent_at"))
    read = F.when(F.col("event_id") % 3 == 0, F.col("ts"))
    alerts = e.select(F.col("event_id").alias("alert_id"), "user_id", F.col("value").alias("similarity"), read.alias("read_at"), F.col("ts").alias("created_at"))
    return A.digests(users, alerts, _now("2024-01-30 12:00:00")).select("user_id", "alert_id", "rank")


@query(
    "history_search",
    """SELECT event_id, ts::DATE = DATE '2024-01-30' AS today, ts >= TIMESTAMP '2024-01-23 12:00:00' AS week, ts::DATE >= DATE '2024-01-01' AND ts::DATE < DATE '2024-02-01' AS month
    FROM events WHERE contains(lower(event_type), 'click') OR contains(lower(props), '"k": 7')""",
)
def history_search(spark, sf):
    now = _now("2024-01-30 12:00:00")
    e = _events(spark, sf)
    left = e.filter(A.mentions(" CLICK ", "event_type", "props") | A.mentions('"K": 7', "event_type", "props"))
    return left.select("event_id", *(A.in_period(F.col("ts"), now, p).alias(p) for p in ("today", "week", "month")))


@query(
    "change_records",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'changed' END AS kind, md5(doc_id || '|' || md5(coalesce(text, ''))) AS change_id,
    trim(substr(coalesce(text, ''), 1, 200), ' ') AS summary FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""",
)
def change_records(spark, sf):
    from corpuskiln.functions import display as D

    d = table(spark, sf, "documents").select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))
    old = d.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("text_hash")).alias("text_hash"))
    return A.changes(d, old, "doc_id", "text_hash").select("doc_id", "kind", "change_id", D.summary_stand_in(F.col("text")).alias("summary"))


@query("cache_hits")
def cache_hits(spark, sf):
    """Answers kept for a day from when they were made: a hit does not prolong them. A sequential rule, so without SQL."""
    e = _events(spark, sf).withColumn("key", F.concat_ws("|", "user_id", "event_type")).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    made = S.admit(e, "key", "t", 1, 86400.000001, "event_id")
    return made.select("key", "event_id", (~F.col("admitted")).alias("hit"))


@query(
    "year_range_scan",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1996 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""",
)
def year_range_scan(spark, sf):
    """Newest first within a range of years, up to the asked number of items (a top-k report)."""
    o = table(spark, sf, "orders").filter((F.col("o_orderdate") >= _now("1993-01-01 00:00:00")) & (F.col("o_orderdate") < _now("1997-01-01 00:00:00")))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


@query("ask_cache")
def ask_cache(spark, sf):
    """Every event as a question to a cache of all its inputs: which request answers it. A sequential rule, so without SQL."""
    from corpuskiln.functions import text as X
    from corpuskiln.operators import cache as C

    e = _events(spark, sf).withColumn("question", F.concat(F.lit("What did user "), "user_id", F.lit(" do by "), "event_type", F.lit("?")))
    key = X.cache_key(F.col("question"), F.lit("events"), F.lit("5"))
    return C.through_cache(e, key, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.col("event_id"), X.cacheable(F.col("question"), C.FRESH_WORDS))


@query(
    "event_labels",
    """SELECT event_id, strftime(ts, '%d') || ' ' || ['stycznia', 'lutego', 'marca', 'kwietnia', 'maja', 'czerwca', 'lipca', 'sierpnia', 'września', 'października', 'listopada', 'grudnia'][month(ts)]
    || ' ' || strftime(ts, '%Y') AS day, strftime(ts, '%d.%m.%Y, %H:%M') AS moment, sha256(props) AS token FROM events""",
)
def event_labels(spark, sf):
    """Dates as Polish readers see them, and the stored form of a secret text."""
    from corpuskiln.functions import display as D

    ts = F.col("ts").cast("timestamp")
    return _events(spark, sf).select("event_id", D.long_date_pl(ts).alias("day"), D.date_time_pl(ts).alias("moment"), D.token_hash(F.col("props")).alias("token"))
