"""Mergeable sketches, stored by day: distinct counts (HyperLogLog) and quantiles (KLL) of any period from a few rows a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12  # 4096 registers: a standard error of about 1.6 %
KLL_K = 200  # a rank error of about 1.65 %


def by_day(df: DataFrame, ts: str, keys: list[str], item: str, value: Column) -> DataFrame:
    """One row for each key and day: rows, sketch of distinct items, sketch of values. Partial aggregates merge before the exchange."""
    day = F.date_format(ts, "yyyy-MM-dd").alias("day")
    return df.groupBy(*keys, day).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, F.lit(LG_K)).alias("items"), F.kll_sketch_agg_double(value.cast("double"), F.lit(KLL_K)).alias("values"))


def merged(days: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of all days of each key as one."""
    return days.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def distinct_count(items: str) -> Column:
    return F.hll_sketch_estimate(items)


def quantile(values: str, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(rank))


def share_up_to(values: str, edge: float) -> Column:
    """Share of the values that are at most ``edge``."""
    return F.kll_sketch_get_rank_double(values, F.lit(edge))


def histogram(df: DataFrame, values: str, n: str, edges: list[float]) -> DataFrame:
    """Rows between neighbouring edges (up to and with the upper one), one row for each edge but the first."""
    ranks = [share_up_to(values, e) for e in edges]
    bins = F.array(*(F.struct(F.lit(e).alias("up_to"), F.round((b - a) * F.col(n)).cast("long").alias("approx_n")) for e, a, b in zip(edges[1:], ranks[:-1], ranks[1:], strict=True)))
    kept = [c for c in df.columns if c not in ("items", values)]
    return df.withColumn("_bin", F.explode(bins)).select(*kept, "_bin.*")
