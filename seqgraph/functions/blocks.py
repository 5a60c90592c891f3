"""Pairs of rows by pairs of blocks: what is many on both sides meets as few rows, and is told apart only at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(df: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """keys, name: the other columns of df's rows with the same keys, as arrays of about most structs each."""
    rest = [c for c in df.columns if c not in keys]
    # Dealt by all columns first: rows are made once for the counts and the blocks, which read the same shuffle.
    df = df.repartition(_tasks(df), *df.columns)
    dealt = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__blocks")).where("__blocks > 1")
    placed = df.join(dealt, keys, "left").withColumn("__block", F.pmod(F.xxhash64(*df.columns), F.coalesce("__blocks", F.lit(1))))
    return placed.groupBy(*keys, "__block").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("__block")


def told(pairs: DataFrame, *names: str) -> DataFrame:
    """A row for each way to take one struct of each array of names, their fields in place of the arrays.

    Pairs of blocks are dealt evenly over as many tasks as shuffles have, whatever keys they met by, so tasks differ by
    a few pairs of blocks. A task holds what one pair of blocks gives, the product of their sizes.
    """
    met = pairs.repartition(_tasks(pairs))
    for name in names:
        met = met.select(*[c for c in met.columns if c != name], F.inline(name))
    return met
