"""Ranks over a whole table and places in groups of any size, by ranges: no window without a partition, no group's rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.operators.relational import cut_lineage


def tie_ranks(df: DataFrame, value: str, **more: Column) -> DataFrame:
    """value, n (rows that have it), rank (from 1, the mean of the ties' places) and further aggregates, for each value that is not null.

    Equal values are counted first (a hot one costs a row for each task), then dealt by ranges; a range adds what all smaller ones hold.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()])
    dealt = cut_lineage(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum("n").alias("_in_range"))  # as many rows as ranges
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_before"))
    here = F.sum("n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = dealt.withColumn("_here", F.coalesce(here, F.lit(0))).join(F.broadcast(before), "_range")
    return ranked.select(value, "n", (F.col("_before") + F.col("_here") + (F.col("n") + 1) / 2).alias("rank"), *more)


def with_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the rank of its value; null values have none."""
    return df.join(tie_ranks(df, value).select(value, F.col("rank").alias(name)), value, "left")


def with_places(df: DataFrame, group: str, name: str, *order: Column) -> DataFrame:
    """df with the place of each row in its group, from 1, in an order that tells its rows apart. Rows are dealt by ranges of both, so a group may hold any share of them."""
    dealt = cut_lineage(df.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_in_range"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    # One group at most goes on in each range.
    before = totals.select(F.col(group).alias("_of"), F.col("_range").alias("_in"), F.sum("_in_range").over(earlier).alias("_before")).where("_before IS NOT NULL")
    here = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    joined = dealt.withColumn("_here", here).join(F.broadcast(before), (F.col(group) == F.col("_of")) & (F.col("_range") == F.col("_in")), "left")
    return joined.select(*df.columns, (F.col("_here") + F.coalesce("_before", F.lit(0))).alias(name))
