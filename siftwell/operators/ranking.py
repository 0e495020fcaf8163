"""A total order over all rows, or over those of each group, without one task that holds them all."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below this estimated size one sorted task is cheaper than the passes of the distributed order.
ONE_TASK_BYTES = 64 << 20
_DOUBLES = ("double", "float", "int", "smallint", "tinyint")


def planned_buckets(df: DataFrame) -> int:
    """1 if the optimiser expects the tables that df reads to be small, else the number of shuffle partitions. Nothing is run.

    The tables count, not the result: what the optimiser expects of a join is the product of its sides.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except (AttributeError, PySparkException):
        return 1
    return 1 if size < ONE_TASK_BYTES else max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, first: str, rest: list[str | Column], descending: bool, n: int) -> DataFrame:
    """Adds bucket_: rows of smaller buckets come before rows of larger ones in the order by first, then rest[0]."""
    types = dict(df.dtypes)
    value, shares = F.col(first).cast("double"), [i / n for i in range(1, n)]
    # values that differ must not meet as one double
    exact = F.lit(types[first] in _DOUBLES) | (F.lit(types[first] == "bigint") & (F.abs(value) < float(1 << 53)))
    second = F.col(rest[0]).cast("double") if rest and isinstance(rest[0], str) and types[rest[0]] in (*_DOUBLES, "bigint") else None
    quantiles = lambda c: F.coalesce(F.percentile_approx(c, shares, 1000), F.array().cast("array<double>"))
    cuts = df.agg(quantiles(value).alias("cuts_"), quantiles(F.lit(0.0) if second is None else second).alias("then_"))  # one row
    place = 2 * F.size(F.filter("cuts_", lambda c: (c > value) if descending else (c < value)))
    filled = F.size(F.filter("cuts_", lambda c: c == value))
    split = exact & (filled > 1) if second is not None else F.lit(False)
    pieces = F.when(F.col(first).isNull(), n if second is not None else 1).when(split, filled).otherwise(1)
    then = F.lit(0) if second is None else F.coalesce(F.size(F.filter("then_", lambda c: c < second)) * F.when(second.isNotNull(), 1), F.lit(0))
    # nulls come last in descending order and first otherwise
    major = F.when(F.col(first).isNull(), 2 * n if descending else -1).otherwise(place + split.cast("int"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bucket_", major.cast("long") * n + F.floor(then * pieces / n)).drop("cuts_", "then_")


def in_order(df: DataFrame, first: str, rest: list[str | Column], descending: bool = True, rank: str = "rank", running: str | None = None, total: str = "running", buckets: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank (from 1, within each group of by) by first (numeric), then rest; and the running sum of a column.

    With more than one bucket, approximate quantiles of first over all rows cut the rows into buckets, each bucket of a
    group is ranked by itself, and the counts (and sums) of the group's buckets before it are added. A bucket of a group has no more
    rows than a bucket of all rows, so a group that holds most rows is spread like the table. A value of first
    that fills several quantiles is cut again by the quantiles of the second key, if that is a number, and so are nulls.
    The quantiles only balance the buckets: the ranks are exact.
    """
    n = planned_buckets(df) if buckets is None else buckets
    order = [F.desc(first) if descending else F.asc(first), *rest]
    if n <= 1:
        w = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumn(rank, F.row_number().over(w))
        return out if running is None else out.withColumn(total, F.sum(running).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = bucketed(df, first, rest, descending, n)
    before = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "bucket_").agg(F.count(F.lit(1)).alias("rows_"), *([F.sum(running).alias("sum_")] if running else []))
    offsets = sums.select(*[F.col(c).alias(f"{c}_of_") for c in by], F.col("bucket_").alias("bucket_of_"), F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("rows_before_"), *([F.sum("sum_").over(before).alias("sum_before_")] if running else []))
    same = F.col("bucket_") == F.col("bucket_of_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    w = Window.partitionBy(*by, "bucket_").orderBy(*order)
    # without groups there are at most five rows for each bucket asked for; groups may be many
    out = cut.join(offsets if by else F.broadcast(offsets), same).withColumn(rank, F.row_number().over(w) + F.col("rows_before_"))
    if running:
        here, earlier = F.sum(running).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("sum_before_")
        out = out.withColumn(total, F.coalesce(here + earlier, here, earlier))  # null before the first value
    return out.drop("bucket_", "bucket_of_", "rows_before_", "sum_before_", *[f"{c}_of_" for c in by])
