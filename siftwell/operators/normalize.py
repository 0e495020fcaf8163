"""Normalisers of scores and costs. Score tables are long: item_id, pos, system, metric, value (and grouping columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scaled(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, 0.0).otherwise(F.try_divide(x - lo, hi - lo))


def _with_stats(df: DataFrame, keys: list[str], stats: list[Column]) -> DataFrame:
    """Joins the statistics of each group to its rows. The statistics are combined before the shuffle; there is one row for each group."""
    if not keys:
        return df.crossJoin(df.agg(*stats))
    return df.join(df.groupBy(*keys).agg(*stats), keys, "left")


def minmax(scores: DataFrame, by: tuple[str, ...] = (), top: float = 1.0) -> DataFrame:
    """Scales each metric to [0, top]; a constant metric becomes 0, nulls stay."""
    both = _with_stats(scores, [*by, "metric"], [F.min("value").alias("lo_"), F.max("value").alias("hi_")])
    return both.withColumn("value", F.when(F.col("value").isNotNull(), top * _scaled(F.col("value"), F.col("lo_"), F.col("hi_")))).drop("lo_", "hi_")


def median_binarize(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """1 if a value reaches the median of its metric, else 0."""
    both = _with_stats(scores, [*by, "metric"], [F.median("value").alias("mid_")])
    return both.withColumn("value", F.when(F.col("value").isNotNull(), (F.col("value") >= F.col("mid_")).cast("double"))).drop("mid_")


def human_scale(scores: DataFrame, metric: str = "human", by: tuple[str, ...] = ()) -> DataFrame:
    """Brings human scores to 0..100: error penalties (all at most 0), shares (all in [0, 1]), or as they are; clamped."""
    own = scores.where(F.col("metric") == metric)
    both = _with_stats(own, list(by), [F.max("value").alias("hi_"), F.min("value").alias("lo_")])
    x = F.col("value")
    raw = F.when(F.col("hi_") <= 0, 100 + 4 * x).when((F.col("lo_") >= 0) & (F.col("hi_") <= 1), 100 * x).otherwise(x)
    done = both.withColumn("value", F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))).drop("hi_", "lo_")
    return scores.where(F.col("metric") != metric).unionByName(done)


def cost_normalize(items: DataFrame, by: tuple[str, ...] = (), cost: str = "cost") -> DataFrame:
    """Standardises costs, shifts them to mean 1, then rescales so that the least is 0 and the mean 1; equal costs become null."""
    both = _with_stats(items, list(by), [F.avg(cost).alias("m_"), F.stddev_pop(cost).alias("s_"), F.min(cost).alias("lo_")])
    z, low = (F.try_divide(F.col(c) - F.col("m_"), F.col("s_")) + 1 for c in (cost, "lo_"))
    return both.withColumn(cost, F.try_divide(z - low, 1 - low)).drop("m_", "s_", "lo_")


def standardize(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    both = _with_stats(df, list(by), [F.avg(column).alias("m_"), F.stddev_pop(column).alias("s_")])
    return both.withColumn(column, F.when(F.col("s_") == 0, 0.0).otherwise(F.try_divide(F.col(column) - F.col("m_"), F.col("s_")))).drop("m_", "s_")


def quantile_scale(scores: DataFrame, low: float = 0.01, high: float = 0.99, by: tuple[str, ...] = ()) -> DataFrame:
    """Clips each metric to two quantiles, then scales it to [0, 1]."""
    both = _with_stats(scores, [*by, "metric"], [F.percentile("value", low).alias("lo_"), F.percentile("value", high).alias("hi_")])
    x = F.greatest(F.col("lo_"), F.least(F.col("hi_"), F.col("value")))
    return both.withColumn("value", F.when(F.col("value").isNotNull(), _scaled(x, F.col("lo_"), F.col("hi_")))).drop("lo_", "hi_")


def add_metric(scores: DataFrame, name: str, parts: list[str], how: str = "sum") -> DataFrame:
    """Appends a metric: the sum or the product of others; an item and system lacking one gets none."""
    picked = scores.where(F.col("metric").isin(parts))
    keys = [c for c in scores.columns if c not in ("metric", "value")]
    value = F.sum("value") if how == "sum" else F.product("value")
    made = picked.groupBy(*keys).agg(value.alias("value"), F.count("value").alias("n_")).where(F.col("n_") == len(parts))
    return scores.unionByName(made.withColumn("metric", F.lit(name)).select(scores.columns))


def dense_items(scores: DataFrame, top_systems: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Keeps the items that have all of the most frequent systems, and of those the systems that every kept item has."""
    pairs = scores.select(*by, "item_id", "system").distinct()
    most = pairs.groupBy(*by, "system").count()
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "system")
    top = most.withColumn("rn_", F.row_number().over(order)).where(F.col("rn_") <= top_systems).select(*by, "system")
    wanted = top.groupBy(*by).agg(F.count(F.lit(1)).alias("k_")) if by else top.agg(F.count(F.lit(1)).alias("k_"))
    having = pairs.join(top, [*by, "system"], "left_semi").groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("n_"))
    items = (having.join(wanted, list(by)) if by else having.crossJoin(wanted)).where("n_ = k_").select(*by, "item_id")
    kept = pairs.join(items, [*by, "item_id"], "left_semi")
    total = items.groupBy(*by).agg(F.count(F.lit(1)).alias("t_")) if by else items.agg(F.count(F.lit(1)).alias("t_"))
    counted = kept.groupBy(*by, "system").agg(F.count(F.lit(1)).alias("n_"))
    systems = (counted.join(total, list(by)) if by else counted.crossJoin(total)).where("n_ = t_").select(*by, "system")
    return scores.join(items, [*by, "item_id"], "left_semi").join(systems, [*by, "system"], "left_semi")


def only_systems(scores: DataFrame, systems: list[str], keep: bool = True) -> DataFrame:
    """Splits by system: those named, or all others."""
    named = F.col("system").isin(systems)
    return scores.where(named if keep else ~named)
