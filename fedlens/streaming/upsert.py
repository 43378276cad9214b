"""Keyed tables fed by a stream.

Every micro-batch is reduced to its latest row per key and written to a directory of its own,
named by the batch id and overwritten on replay, so a batch that runs twice leaves one copy.
Readers take the latest row per key over all batches; ``compact`` folds them into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` of every key, by a partial maximum."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def start_upsert(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
    output_mode: str = "append", available_now: bool = True,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(
    spark: SparkSession, target: str, schema: StructType, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    return latest(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(target), keys, order)


def compact(
    spark: SparkSession, target: str, folded: str, schema: StructType, keys: Sequence[str], order: Sequence[str]
) -> None:
    """Writes the current rows as the first batch of a new table."""
    read_latest(spark, target, schema, keys, order).write.parquet(f"{folded}/batch=0")
