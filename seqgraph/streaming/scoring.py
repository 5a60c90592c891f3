"""Scoring reads as they arrive. Each read's score depends on the read alone, so the stream needs no state;
run totals over event time do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.align import Flat, score_reads


def scored(reads: DataFrame, graph: Flat) -> DataFrame:
    """Streaming reads (read_idx, seq) to read_idx, score."""
    return score_reads(reads, graph)


def scores_by_window(scores: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Counts and sums of scores by event-time window; rows later than late are dropped by the watermark."""
    return scores.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max("score").alias("worst"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet files, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
