"""Rounds that close by rule: when all clients have replied, or when the timeout is over.

Both rules speak of event time: a reply is late if it was sent after its round's deadline, whenever its file is read. Every
micro-batch keeps the first reply in time of each client and the number of late ones, in a folder of its own that a replay
writes over; minima and sums over the batches give the same rounds for any order and any number of files. No watermark is
needed, so nothing is dropped because another file came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fedlens.operators.metrics import weighted_mean

KEYS = ["round_start", "client_id"]
FIRST = "round_start timestamp, client_id long, ts timestamp, event_id long, num_examples long, train_loss double"
LATE = "round_start timestamp, client_id long, ts timestamp, event_id long, deadline timestamp"
SEEN = "until timestamp"


def with_deadline(replies: DataFrame, length: str, timeout: str) -> DataFrame:
    """Adds the start of a reply's round and the time at which the round stops waiting."""
    start = F.window("ts", length)["start"]
    return replies.withColumn("round_start", start).withColumn("deadline", start + F.expr(f"INTERVAL {timeout}"))


def _first(replies: DataFrame) -> DataFrame:
    reply = F.struct("ts", "event_id", "num_examples", "train_loss")
    return replies.groupBy(*KEYS).agg(F.min(reply).alias("_r")).select(*KEYS, "_r.*")


def start_closing(
    replies: DataFrame, target: str, checkpoint: str, length: str = "1 day", timeout: str = "1 hour", available_now: bool = True
) -> StreamingQuery:
    """Keeps what each micro-batch adds: first replies in time, late replies, and how far event time has come."""
    timed = with_deadline(replies, length, timeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        in_time = F.col("ts") <= F.col("deadline")
        parts = {
            "first": _first(batch.where(in_time)).select([c.split()[0] for c in FIRST.split(", ")]),
            "late": batch.where(~in_time).select([c.split()[0] for c in LATE.split(", ")]),
            "seen": batch.agg(F.max("ts").alias("until")),
        }
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")
        batch.unpersist()

    writer = timed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _read(spark: SparkSession, target: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{target}/{name}")


def closed_rounds(spark: SparkSession, target: str, expected: int | Column, timeout: str = "1 hour") -> DataFrame:
    """One row per round: how it closed (``complete``, ``timeout`` or still ``open``), when, and its weighted loss.

    ``expected`` is the number of clients a round waits for. A complete round closes with its last first reply.
    """
    until = _read(spark, target, "seen", SEEN).agg(F.max("until")).scalar()
    first = _first(_read(spark, target, "first", FIRST))
    rounds = first.groupBy("round_start").agg(
        F.count("*").alias("n_clients"), F.max("ts").alias("last_reply"), weighted_mean("train_loss").alias("train_loss"),
        F.sum("num_examples").alias("num_examples"),
    )
    deadline = F.col("round_start") + F.expr(f"INTERVAL {timeout}")
    complete, over = F.col("n_clients") >= expected, until > deadline
    return rounds.select(
        "round_start",
        F.when(complete, F.lit("complete")).when(over, F.lit("timeout")).otherwise(F.lit("open")).alias("closed_by"),
        F.when(complete, F.col("last_reply")).when(over, deadline).alias("closed_at"),
        "n_clients", "num_examples", "train_loss",
    )


def late_replies(spark: SparkSession, target: str) -> DataFrame:
    """Replies that came after their round's deadline and count nowhere."""
    return _read(spark, target, "late", LATE)
