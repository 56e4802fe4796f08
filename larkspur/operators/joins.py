"""Joins that Spark's equi-joins do not state directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str]) -> DataFrame:
    """left with columns ``take`` of the row of right that has the same ``by`` and the latest ``on`` not after left's.

    Both sides are united and sorted once within ``by``; no pairs are made. Rows without a partner have nulls. Of right
    rows with one ``on`` the one with the greatest ``take`` counts. Columns may have any names.
    """
    mine, theirs = F.struct("*").alias("l"), F.struct(*take).alias("r")
    key = [F.col(b).alias(f"k{i}") for i, b in enumerate(by)]
    both = right.select(*key, F.col(on).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(left.select(mine).schema["l"].dataType).alias("l"), theirs)
    both = both.unionByName(left.select(*key, F.col(on).alias("t"), F.lit(1).alias("side"), mine, F.lit(None).cast(right.select(theirs).schema["r"].dataType).alias("r")))
    order = Window.partitionBy(*(f"k{i}" for i in range(len(by)))).orderBy("t", "side", "r")
    found = F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("r", found).where("side = 1").select("l.*", "r.*")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with right.low <= left.point < right.high, by an equi-join on buckets of a width.

    A right row is repeated for each bucket that it spans, so the width should be about that of the ranges; rows whose
    range is empty or null meet nothing. The sides' columns must have different names.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    some = right.where(F.col(low) < F.col(high))
    spans = some.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    met = left.withColumn("_bucket", bucket(point)).join(spans, "_bucket").drop("_bucket")
    return met.where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high)))
