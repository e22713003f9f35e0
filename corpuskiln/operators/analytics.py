"""Usage analytics as grouped aggregates, windows and calendar joins. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_with_share(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, and their rounded percentage of all rows (the window runs over the few grouped rows)."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("pct", F.round(F.col("n") * 100 / F.col("total"), 2))


def counts_by_day(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Tumbling one-day counts in UTC."""
    return df.groupBy(*keys, F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def daily_quota(daily: DataFrame, limit: int) -> DataFrame:
    """Admitted and rejected counts of a day, percentage used and the near-limit flag (80 %)."""
    used = F.least("n", F.lit(limit))
    return daily.select("*", used.alias("admitted"), F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"), F.round(used * 100 / limit, 2).alias("pct_used"), (used * 100 >= 80 * limit).alias("near_limit"))


def calendar_fill(daily: DataFrame, last_day: str, days: int) -> DataFrame:
    """The last ``days`` days up to ``last_day``, with 0 where nothing happened."""
    spark = daily.sparkSession
    calendar = spark.range(days).select(F.date_format(F.date_sub(F.lit(last_day).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    return calendar.join(daily.groupBy("day").agg(F.sum("n").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def windowed_activity(df: DataFrame, ts: Column, as_of: str, *keys: str) -> DataFrame:
    """Conditional counts of the last 30 and 7 days from one scan."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if((ts >= end - F.expr("interval 30 days")) & (ts < end)).alias("n_30d"), F.count_if((ts >= end - F.expr("interval 7 days")) & (ts < end)).alias("n_7d"))


def top_n(df: DataFrame, key: str | list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key; plans to WindowGroupLimit, so each task sends at most ``n`` rows of a key."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def json_counts(df: DataFrame, column: str, schema: str, pick: str) -> DataFrame:
    """Counts of a field inside JSON texts; malformed texts and empty values are skipped."""
    parsed = df.select(F.from_json(column, schema).alias("j"))
    return parsed.select(F.col(f"j.{pick}").cast("string").alias("value")).filter("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def json_elements(df: DataFrame, column: str, order: list[Column], newest: int, field: str) -> DataFrame:
    """Counts of a field of the elements of JSON lists in the ``newest`` rows; malformed texts, other values than lists and
    elements without the field, or with an empty one, are skipped."""
    rows = df.orderBy(*order).limit(newest).select(F.try_parse_json(column).alias("v"))
    lists = rows.filter(F.schema_of_variant("v").startswith("ARRAY")).select("v")
    elements = lists.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.try_variant_get("value", f"$.{field}", "string").alias(field))
    return elements.filter(F.col(field) != "").groupBy(field).agg(F.count("*").alias("n"))


def quota_use(counts: DataFrame, tiers: DataFrame, tier: str) -> DataFrame:
    """Counts against the limit of their tier (null limit: none). ``tiers`` is a dimension of a few rows."""
    return counts.join(F.broadcast(tiers), tier).withColumn("over", F.coalesce(F.col("n") > F.col("tier_limit"), F.lit(False)))


def max_normalised(df: DataFrame, value: str, least: int = 4) -> DataFrame:
    """Value as a percentage of the greatest, with a least bar height."""
    top = F.max(value).over(Window.partitionBy())
    return df.withColumn("bar", F.greatest(F.round(F.col(value) * 100 / F.greatest(top, F.lit(1)), 2), F.lit(float(least))))


def length_stats(df: DataFrame, column: str, *keys: str) -> DataFrame:
    size = F.length(column)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(size).cast("long").alias("min_len"), F.median(size).alias("median_len"), F.round(F.avg(size), 4).alias("mean_len"), F.max(size).cast("long").alias("max_len"), F.count_if(size == 0).alias("n_empty"))


def histogram(df: DataFrame, value: Column, width: int, bins: int) -> DataFrame:
    """Rows per bucket of ``width``; the last bucket takes the rest."""
    return df.groupBy(F.least(F.floor(value / width), F.lit(bins - 1)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def in_order(df: DataFrame, key: str, order: list[Column], place: str) -> DataFrame:
    """All rows of each key with their place in the given order."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def winner(a: Column, b: Column, first: str, second: str) -> Column:
    """Who has the higher score: null where the second has none."""
    return F.when(b.isNull(), F.lit(None)).when(a > b, first).when(b > a, second).otherwise("tie")
