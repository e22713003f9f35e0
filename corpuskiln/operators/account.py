"""Tables of users: owner-checked changes, subscriptions, settings, shares, digests, history. Results replace the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delete_owned(rows: DataFrame, requests: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows without those that their own owner asks to delete; a request for another's row changes nothing."""
    return rows.join(requests.select(key, owner).distinct(), [key, owner], "left_anti")


def mark_read(rows: DataFrame, requests: DataFrame, key: str, owner: str, column: str, now: Column) -> DataFrame:
    """Sets the time of reading where the owner asks for it and none is set yet."""
    asked = requests.select(key, owner).distinct().withColumn("_asked", F.lit(True))
    return rows.join(asked, [key, owner], "left").withColumn(column, F.coalesce(column, F.when(F.col("_asked"), now))).drop("_asked")


def tiers_after(changes: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Tier of each user after the newest change (status, tier, period_end in Unix seconds): free unless active or on trial."""
    last = changes.filter(F.col(user).isNotNull()).groupBy(user).agg(F.max_by(F.struct("status", "tier", "period_end"), F.struct(*order)).alias("c"))
    active = F.col("c.status").isin("active", "trialing")
    return last.select(user, F.when(active, F.col("c.tier")).otherwise("free").alias("tier"), F.timestamp_seconds("c.period_end").alias("expires_at"))


def patched(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Settings of ``rows`` with every setting that a patch (one a key) names; null leaves a setting as it is."""
    new = [c for c in patches.columns if c != key]
    named = patches.select(key, *(F.col(c).alias(f"_{c}") for c in new))
    return rows.join(named, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in new}).drop(*(f"_{c}" for c in new))


def expiry(created: Column, days: Column, usual: int = 30) -> Column:
    """End of a share: 1 to 365 days after it was made."""
    return created + F.make_dt_interval(F.greatest(F.lit(1), F.least(F.lit(365), F.coalesce(days, F.lit(usual)))).cast("int"))


def alive(expires: Column, now: Column) -> Column:
    return expires.isNull() | (expires >= now)


def digests(users: DataFrame, alerts: DataFrame, now: Column, most: int = 10) -> DataFrame:
    """Alerts of the weekly mail: users (user_id, enabled, email, last_sent_at) who want it and got none for six days; their
    unread alerts (alert_id, user_id, similarity, read_at, created_at) of seven days, the most similar first."""
    due = users.filter("enabled and email is not null").filter(F.col("last_sent_at").isNull() | (F.col("last_sent_at") < now - F.expr("interval 6 days")))
    fresh = alerts.filter("read_at is null").filter(F.col("created_at") >= now - F.expr("interval 7 days"))
    w = Window.partitionBy("user_id").orderBy(F.desc("similarity"), "alert_id")
    return fresh.join(due.select("user_id"), "user_id", "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def in_period(ts: Column, now: Column, period: str) -> Column:
    """History of ``today``, of seven days (``week``), of the calendar ``month``, or ``all``."""
    return {
        "today": ts.cast("date") == now.cast("date"),
        "week": ts >= now - F.expr("interval 7 days"),
        "month": F.trunc(ts.cast("date"), "month") == F.trunc(now.cast("date"), "month"),
        "all": F.lit(True),
    }[period]


def mentions(needle: str, *columns: str) -> Column:
    """Does any of the columns hold the text, whatever the case? An empty text is in all."""
    q = needle.strip().lower()
    out = F.lit(q == "")
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return out


def changes(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """New and changed rows with an id of the change and its kind; rows of an unchanged digest go."""
    before = old.select(key, F.col(digest).alias("_before")).dropDuplicates([key]).withColumn("_known", F.lit(True))
    both = new.join(before, key, "left").filter(~F.col("_before").eqNullSafe(F.col(digest)) | F.col("_known").isNull())
    kind = F.when(F.col("_known"), "changed").otherwise("new")
    return both.withColumn("kind", kind).withColumn("change_id", F.md5(F.concat_ws("|", key, digest))).drop("_before", "_known")
