"""Half-open intervals [vd0, vd1) and points vd, each within keys.

Scans run over ranges of keys and starts, so one key may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import scan


def coalesce(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching intervals as one."""
    own = intervals.where("vd1 > vd0").groupBy(*keys, "vd0").agg(F.max("vd1").alias("vd1"))
    reach = scan(own, keys, ["vd0"], "max", F.col("vd1"), "__reach")
    opens = (F.col("__reach").isNull() | (F.col("vd0") > F.col("__reach"))).cast("long")
    # An interval's run is numbered by the openings up to it: those before, and its own.
    runs = scan(reach.withColumn("__opens", opens), keys, ["vd0"], "sum", F.col("__opens"), "__run")
    runs = runs.withColumn("__run", F.coalesce("__run", F.lit(0)) + F.col("__opens"))
    return runs.groupBy(*keys, "__run").agg(F.min("vd0").alias("vd0"), F.max("vd1").alias("vd1")).drop("__run")


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "vd0", "vd1"]
    return coalesce(a.select(*columns).unionByName(b.select(*columns)), keys)


def outside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "vd") -> DataFrame:
    """Points that lie in none of the intervals: an anti range join in one scan.

    An interval holds a point that it starts at or before and ends behind; the largest end so far decides.
    """
    held = intervals.where("vd1 > vd0").select(*keys, F.col("vd0").alias("__at"), F.lit(0).alias("__kind"), F.col("vd1").alias("__end"))
    rows = points.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__row"))
    both = held.unionByName(rows, allowMissingColumns=True)
    seen = scan(both, keys, ["__at", "__kind"], "max", F.col("__end"), "__last")
    return seen.where((F.col("__kind") == 1) & (F.col("__last").isNull() | (F.col("__at") >= F.col("__last")))).select("__row.*")
