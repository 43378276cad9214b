"""Round metrics of replies that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fedlens.operators.metrics import weighted_mean

ROUND_LENGTH = "1 day"
TIMEOUT = "1 hour"  # fixed value: a round waits 3,600 seconds for its clients


def round_means(replies: DataFrame, length: str = ROUND_LENGTH, timeout: str = TIMEOUT) -> DataFrame:
    """Example-weighted loss per round window and reply kind; later replies do not count."""
    return (
        replies.withWatermark("ts", timeout)
        .groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(weighted_mean("train_loss").alias("train_loss"), F.sum("num_examples").alias("num_examples"))
        .select(F.col("w.start").alias("round_start"), "event_type", "train_loss", "num_examples")
    )


def start_round_log(means: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends every round once it is closed."""
    writer = means.writeStream.outputMode("append").format("parquet").option("path", target)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
