"""The batch operators that also run on streams: the temporal split, and running catalogue counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from duolist.config import PrepConfig
from duolist.operators.cohorts import add_temporal_split


def running_positive_counts(ratings: DataFrame, config: PrepConfig, late: str = "7 days") -> DataFrame:
    """(movieId, trainPositiveCount) of a stream of ratings, a user's repeats within the allowed lateness counted once."""
    split = add_temporal_split(ratings, config).where("split = 'train' and is_positive").withColumn("at", F.timestamp_seconds("timestamp"))
    once = split.withWatermark("at", late).dropDuplicatesWithinWatermark(["userId", "movieId"])
    return once.groupBy("movieId").agg(F.count(F.lit(1)).alias("trainPositiveCount"))


def split_to_parquet(ratings: DataFrame, config: PrepConfig, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream of ratings to files by split, so that later scans read only the splits they need."""
    return add_temporal_split(ratings, config).writeStream.format("parquet").partitionBy("split").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
