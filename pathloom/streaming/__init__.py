"""Replies that arrive as files, scored as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx

REPLIES = "pair_id bigint, label int, reply string, answered_at timestamp"


def read_replies(spark: SparkSession, path: str, schema: str = REPLIES) -> DataFrame:
    """Stream of reply files with the prediction read from each reply."""
    return spark.readStream.schema(schema).parquet(path).withColumn("prediction", tx.extract_label(F.col("reply")))


def outcome_counts(replies: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of (label, prediction) by time window; replies later than ``late`` are too late for their window.

    The state is at most four counts and the unreadable ones for each open window.
    """
    known = replies.filter("label is not null").withWatermark("answered_at", late)
    return known.groupBy(F.window("answered_at", window), "label", "prediction").agg(F.count("*").alias("n"))


def write_predictions(replies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the predictions of all files that are there, each file once also over restarts."""
    return (
        replies.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
