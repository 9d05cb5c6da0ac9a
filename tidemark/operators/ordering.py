"""Places and ranks in a total order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import cut


def ranged(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df written in ranges of (by, order), so many if parts says so, with __part, the number of each row's range."""
    return cut(df.repartitionByRange(*([parts] if parts else []), *by, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def ahead(parts: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """by, __part, __ahead: the weight of all of a group's ranges before each. A group has no more rows here than there are ranges."""
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*by, "__part").agg(weight.alias("__sum"))
    return sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__ahead"))


def places(df: DataFrame, *order: str) -> DataFrame:
    """df with place, a row's number from 1 in the order given over all rows; rows of equal order have their places among themselves."""
    rows = ranged(df, [], list(order))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.join(ahead(rows, [], F.count("*")), "__part").withColumn("place", (F.col("__ahead") + within).cast("long")).drop("__part", "__ahead")


def nearest_ranks(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Per group the least value whose share of values at or below it is at least each share, and the maximum (max); nulls do not count.

    Equal values are counted before the shuffle, ranges of values are summed apart, so a group of any size is spread.
    """
    if not by:
        return nearest_ranks(df.select(value, F.lit(0).alias("__all")), value, shares, "__all").drop("__all")
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    rows = ranged(counted, by, [value])
    within = Window.partitionBy(*by, "__part").orderBy(value)
    total = rows.groupBy(*by).agg(F.sum("__n").alias("__total"))
    upto = rows.withColumn("__upto", F.sum("__n").over(within)).join(ahead(rows, by, F.sum("__n")), [*by, "__part"])
    upto = upto.join(total, by)
    reached = F.col("__ahead") + F.col("__upto")
    return upto.groupBy(*by).agg(*[F.min(F.when(reached >= F.lit(q) * F.col("__total"), F.col(value))).alias(n) for n, q in shares.items()], F.max(value).alias("max"))
