"""Token ids as Parquet list columns, for selective reads.

Rows are in ascending document order over the files. ``ids`` is a list column with dictionary or delta encoding, the row
groups and pages have stated sizes, and the page index lets a reader skip pages by ``doc_id``; metadata columns are read
without touching ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.llm.common import END_ID, ChunkEncoder, batches_of, crc, in_groups, rows_of, stored

STORED = "doc_id long, file long, start_in_file long, n_tokens long, ids array<int>"
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids with the end id, in ascending ``doc_id``; text is moved before it is encoded, so it is encoded once.

    A null text is empty. A null ``doc_id`` comes first; rows with the same id follow each other in the order of their
    texts.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), *((x, pa.int64()) for x in ("file", "start_in_file", "n_tokens")), ("ids", pa.list_(pa.int32()))]
    )
    end = END_ID.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, file = ChunkEncoder(tokenizer, words=True), TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            start = 0
            for group in in_groups(rows_of(batches)):
                for (doc_id, _), found in zip(group, encoder.many([text for _, text in group])):
                    ids = np.frombuffer(found + end, "<i4")
                    yield doc_id, file, start, len(ids), ids
                    start += len(ids)

        yield from batches_of(rows(), schema, weight=lambda r: r[3])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(encode, STORED)


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 1000,
) -> None:
    """Writes the ids of every document to ``path``, which is replaced, so a repeated run leaves one copy."""
    options = {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
        **ENCODINGS[encoding],
    }
    encoded(docs, tokenizer).write.mode("overwrite").options(**options).parquet(path)


def read_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """Documents from ``first`` to ``last`` with ``start``, the number of ids of all documents before.

    ``start`` adds the totals of the files before; it reads metadata only. Without ``ids`` the token column is not read. The
    totals, a row a file, are written first, so their size is known and ids are not shuffled to meet them.
    """
    files = spark.read.schema(STORED).parquet(path)
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(W.orderBy("file")) - F.col("total")).alias("before"))
    before = stored(spark, before, "id-file-starts")
    chosen = files
    if first is not None:
        chosen = chosen.where(F.col("doc_id") >= first)
    if last is not None:
        chosen = chosen.where(F.col("doc_id") <= last)
    columns = ["doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens"]
    return chosen.join(before, "file").select(*columns, *(["ids"] if ids else []))


def digests(ids: DataFrame) -> DataFrame:
    """Number and CRC-32 of the ids that the files hold."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy()
            parts = [data[a:b].astype("<u4") for a, b in zip(ends[:-1], ends[1:])]
            counts = pa.array([len(p) for p in parts], pa.int64())
            sums = pa.array([crc(p.tobytes()) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), counts, sums], schema=schema)

    return ids.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
