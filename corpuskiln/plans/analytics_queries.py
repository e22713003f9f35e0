"""Analytics queries over the event, document and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.operators import analytics as A
from corpuskiln.registry import query, table

AS_OF = "2024-01-31"


@query("source_stats", "SELECT source, count(*) AS n, (SELECT count(*) FROM documents) AS total, round(count(*) * 100 / (SELECT count(*) FROM documents)::DOUBLE, 2) AS pct FROM documents GROUP BY source")
def source_stats(spark, sf):
    return A.counts_with_share(table(spark, sf, "documents"), "source")


@query("source_rollup", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def source_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("source_pivot", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) AS n FROM documents GROUP BY source")
def source_pivot(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(*(F.count_if(F.col("lang") == x).alias(x) for x in ("de", "en", "es", "fr")), F.count("*").alias("n"))


@query("length_stats", "SELECT lang, count(*) AS n, min(length(text))::BIGINT AS min_len, median(length(text))::DOUBLE AS median_len, round(avg(length(text)), 4) AS mean_len, max(length(text))::BIGINT AS max_len, count(*) FILTER (length(text) = 0) AS n_empty FROM documents GROUP BY lang")
def length_stats(spark, sf):
    return A.length_stats(table(spark, sf, "documents"), "text", "lang")


@query("token_hist", "SELECT least(greatest(1, length(text) // 4) // 64, 49)::BIGINT AS bucket, count(*) AS n FROM documents GROUP BY 1")
def token_hist(spark, sf):
    from corpuskiln.functions.text import approx_tokens

    return A.histogram(table(spark, sf, "documents"), approx_tokens(F.col("text")), 64, 50)


@query("token_summary", "SELECT round(avg(t), 4) AS mean_tokens, median(t)::DOUBLE AS median_tokens, count(*) FILTER (t > 512) AS n_over_512 FROM (SELECT greatest(1, length(text) // 4) AS t FROM documents)")
def token_summary(spark, sf):
    from corpuskiln.functions.text import approx_tokens

    t = table(spark, sf, "documents").select(approx_tokens(F.col("text")).alias("t"))
    return t.agg(F.round(F.avg("t"), 4).alias("mean_tokens"), F.median("t").alias("median_tokens"), F.count_if(F.col("t") > 512).alias("n_over_512"))


@query("category_top10", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def category_top10(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("year_histogram", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1")
def year_histogram(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("daily_usage", "SELECT *, least(n, 5) AS admitted, greatest(n - 5, 0) AS rejected, round(least(n, 5) * 100 / 5.0::DOUBLE, 2) AS pct_used, least(n, 5) * 100 >= 400 AS near_limit FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def daily_usage(spark, sf):
    return A.daily_quota(A.counts_by_day(table(spark, sf, "events"), "ts", "user_id"), 5)


@query("usage_calendar", "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT strftime(c, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS c) LEFT JOIN d ON d.day = strftime(c, '%Y-%m-%d')")
def usage_calendar(spark, sf):
    return A.calendar_fill(A.counts_by_day(table(spark, sf, "events"), "ts"), AS_OF, 30)


@query("activity_30_7", "SELECT user_id, count(*) AS n_total, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND ts < TIMESTAMP '2024-01-31') AS n_30d, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-31') AS n_7d FROM events GROUP BY user_id")
def activity_30_7(spark, sf):
    return A.windowed_activity(table(spark, sf, "events"), F.col("ts"), AS_OF, "user_id")


@query("alert_counts", "SELECT user_id, count(*) AS n_alerts, count(*) FILTER (value > 50) AS n_unread FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id")
def alert_counts(spark, sf):
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(first), "event_type").groupBy("user_id").agg(F.count("*").alias("n_alerts"), F.count_if(F.col("value") > 50).alias("n_unread"))


@query("latest_per_user", "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_user(spark, sf):
    return A.top_n(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id", "event_type", "ts")


@query("topn_per_user", "SELECT user_id, event_id, round(value, 6) AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def topn_per_user(spark, sf):
    return A.top_n(table(spark, sf, "events"), "user_id", [F.desc("value"), F.asc("event_id")], 10).select("user_id", "event_id", F.round("value", 6).alias("value"), "rank")


@query("keyset_page", "SELECT event_id, ts, user_id FROM events WHERE (ts, event_id) < (SELECT (ts, event_id) FROM events WHERE event_id = 500) ORDER BY ts DESC, event_id DESC LIMIT 21")
def keyset_page(spark, sf):
    from corpuskiln.operators.paging import keyset_page as page

    e = table(spark, sf, "events")
    cursor = e.filter("event_id = 500").select(F.col("ts").alias("c_ts"), F.col("event_id").alias("c_id"))
    return page(e, cursor, 20).select("event_id", "ts", "user_id")


@query("offset_page", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100 OFFSET 200")
def offset_page(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id").orderBy("event_id").offset(200).limit(100)


@query("json_props_counts", "SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') <> '' GROUP BY 1")
def json_props_counts(spark, sf):
    return A.json_counts(table(spark, sf, "events"), "props", "k string", "k")


@query("quota_check", "SELECT e.user_id, e.tier, e.n, t.tier_limit, coalesce(e.n > t.tier_limit, false) AS over FROM (SELECT user_id, user_id % 3 AS tier, count(*) AS n FROM events GROUP BY user_id) e JOIN (VALUES (0, 5), (1, 50), (2, NULL)) t(tier, tier_limit) ON e.tier = t.tier")
def quota_check(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("tier", F.col("user_id") % 3)
    tiers = spark.createDataFrame([(0, 5), (1, 50), (2, None)], "tier long, tier_limit int")
    return A.quota_use(counts, tiers, "tier").select("user_id", "tier", "n", "tier_limit", "over")


@query("usage_bars", "SELECT event_type, n, greatest(round(n * 100 / max(n) OVER ()::DOUBLE, 2), 4) AS bar FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def usage_bars(spark, sf):
    return A.max_normalised(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), "n")


@query("cache_hit_rate", "SELECT count(*) FILTER (value >= 50) AS hits, count(*) FILTER (value < 50) AS misses, round(count(*) FILTER (value >= 50) / greatest(1, count(*))::DOUBLE, 6) AS hit_rate FROM events")
def cache_hit_rate(spark, sf):
    hit = F.col("value") >= 50
    return table(spark, sf, "events").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.lit(1), F.col("hits") + F.col("misses")), 6))


@query("list_by_type", "SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id, event_type")
def list_by_type(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("session_windows", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s) SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, sid")
def session_windows(spark, sf):
    w = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("started"), "n")
