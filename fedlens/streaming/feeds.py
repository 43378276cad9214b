"""Reply feeds read from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.sources.tables import table


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; ``ts`` gets a zone, which watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    # as a pattern the path may be a single file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def replies_from(events: DataFrame) -> DataFrame:
    """Each event is the reply of a client to a round: its examples and its loss."""
    return events.select(
        "event_id", "ts", "event_type",
        F.pmod("user_id", F.lit(150)).alias("run_id"),
        F.col("user_id").alias("client_id"),
        F.dayofmonth("ts").alias("round"),
        (F.pmod("user_id", F.lit(50)) + 1).alias("num_examples"),
        (F.col("value") / 101).alias("train_loss"),
        (F.col("value") / 503).alias("accuracy"),
    )
