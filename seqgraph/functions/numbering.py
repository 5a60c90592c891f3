"""Row numbers, running sums and running maxima, without one task that sees all rows or all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.storage import materialise

#: Bits that monotonically_increasing_id() gives to a row's place in its partition.
PLACE_BITS = 33


def scan(df: DataFrame, keys: list[str], order: list[str], how: str, value: Column, name: str) -> DataFrame:
    """df with name: the sum or max of value over the rows of the same keys before it in order (null if none).

    Rows are dealt by ranges of keys and order, so a key with many rows spreads over many ranges. Inside a range a
    window does the work; from range to range only one row for each key and range is carried. Ties in order are
    broken alike in one run only; order should be unique within keys.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__value", value).repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")  # both passes must see the same ranges
    inside = W.partitionBy("__range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranges = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = ranged.groupBy("__range", *keys).agg(agg("__value").alias("__own"))
    carried = carried.withColumn("__before", agg("__own").over(ranges)).select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = ranged.withColumn("__local", agg("__value").over(inside)).join(carried, same)
    both = F.greatest("__before", "__local") if how == "max" else F.when(F.col("__before").isNull(), F.col("__local")).otherwise(F.col("__before") + F.coalesce("__local", F.lit(0)))
    return met.withColumn(name, both).select(*df.columns, name)


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over all rows before in order, 0 for the first."""
    return scan(df, [], order, "sum", value.cast("long"), name).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, 2... in order. Ranges are sorted and counted where they are written, so rows are shuffled once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed(df.repartitionByRange(n, *order).sortWithinPartitions(*order), name)


def placed(df: DataFrame, name: str) -> DataFrame:
    """df with name: 0, 1, 2... in the order of its partitions, and of the rows in each. Rows are made once and not shuffled."""
    # Of each row its range and its place there, in one number.
    ranged = materialise(df.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    counts = ranged.groupBy(F.shiftright("__place", PLACE_BITS).alias("__range")).agg(F.count(F.lit(1)).alias("__own"))
    before = F.sum("__own").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    # A row for each range.
    carried = counts.select("__range", F.coalesce(before, F.lit(0)).cast("long").alias("__before"))
    met = ranged.join(F.broadcast(carried), F.shiftright("__place", PLACE_BITS) == F.col("__range"))
    return met.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1)).select(*df.columns, name)
