"""Packing of token sequences into windows by minimum bin slack.

Every document is cut at multiples of the window, so whole windows need no search and ids never move: only the lengths of
the last pieces do. Equal lengths are interchangeable, so the search runs on counts of lengths, at most one entry per
length below the window, whatever the corpus holds. Each step fixes the longest length left, finds by a bitset of
reachable sums the fill closest to the window, reads the multiset back from the bitsets of the steps before, and repeats
that multiset as often as the counts allow. Every step uses up one length, so the plan has at most one pattern per length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.llm.common import END_ID, ChunkEncoder, batches_of, crc, in_groups, rows_of, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
RANK_ROWS = 1000


def padding(total: int, window: int) -> int:
    """Padding of a sequence: up to the window, none at a power of two."""
    return 0 if total & (total - 1) == 0 else window - total


def least_slack(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset with the longest length that leaves the least padding; of equals the fullest."""
    first = max(counts)
    room = window - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        if reach >> room & 1:
            break
        most = min(counts[length] - (length == first), room // length)
        steps.append((length, most, reach))
        power = 1
        while most:
            take = min(power, most)
            reach |= reach << length * take & mask
            most, power = most - take, power * 2
    if reach >> room & 1:
        left = room
    else:
        sums = [i for i in range(room + 1) if reach >> i & 1]
        left = min(sums, key=lambda s: (padding(first + s, window), -s))
    found = {first: 1}
    for length, most, before in reversed(steps):
        used = next(k for k in range(min(most, left // length), -1, -1) if before >> (left - k * length) & 1)
        if used:
            found[length] = found.get(length, 0) + used
            left -= used * length
    return found


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is repeated; together they hold every counted piece once."""
    counts, plan = dict(counts), []
    while counts:
        pattern = {window: 1} if window in counts else least_slack(counts, window)
        times = min(counts[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        plan.append((pattern, times))
    return plan


def encoded_pieces(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """Pieces of every document: ids of the whole text, the end id, cut at multiples of ``window``.

    A null text is empty, so it has the end id alone. Repeated rows are packed as often as they occur.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens"))])
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(tokenizer, words=False)

        def pieces() -> Iterator[tuple]:
            for group in in_groups(rows_of(batches)):
                for (doc_id, _), ids in zip(group, encode.many([text for _, text in group])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        part = ids[4 * start : 4 * (start + window)]
                        yield doc_id, start, len(part) // 4, crc(part), total

        yield from batches_of(pieces(), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def ranked(pieces: DataFrame, n_rows: int) -> DataFrame:
    """``at``: the place of a piece among those of its length.

    One length may hold a third of all pieces, so they are numbered in hashed buckets of about RANK_ROWS and the buckets
    are laid end to end.
    """
    buckets = max(1, n_rows // RANK_ROWS)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (
        keyed.withColumn("own", F.row_number().over(own) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("at", F.col("own") + F.col("before"))
        .drop("bucket", "own", "before")
    )


def placements(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """The plan as arrays sorted by length and first rank: key, first rank, sequence, pieces a sequence, offset."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    rows.sort()
    return tuple(np.array(c, "int64") for c in zip(*rows)) if rows else tuple(np.zeros(0, "int64") for _ in range(5))


def place(pieces: DataFrame, plan: list[tuple[dict[int, int], int]]) -> DataFrame:
    """``sequence_id`` and ``offset`` of ranked pieces. The plan is sent with the tasks; its size is bounded by the window."""
    length, first, sequence, each, offset = placements(plan)
    key = length << 44 | first

    def put(frames):
        for pdf in frames:
            i = np.searchsorted(key, pdf["length"].to_numpy() << 44 | pdf["at"].to_numpy(), side="right") - 1
            nth = pdf["at"].to_numpy() - first[i]
            pdf["sequence_id"] = sequence[i] + nth // each[i]
            pdf["offset"] = offset[i] + nth % each[i] * pdf["length"].to_numpy()
            yield pdf.drop(columns="at")

    columns = PIECES + ", sequence_id long, offset long"
    order = [x.split()[0] for x in PIECES.split(", ")] + ["at"]
    return pieces.select(order).mapInPandas(put, columns)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = 2048) -> DataFrame:
    """Row per piece: where it lies in its document and in which sequence, at which offset.

    An empty table gives no rows; a document that is null, empty or shorter than the window is one piece. Columns other than
    ``doc_id`` and ``text`` are not read, so clashing names do not matter.
    """
    pieces = stored(spark, encoded_pieces(docs, tokenizer, window), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return place(ranked(pieces, sum(counts.values())), plan_windows(counts, window))
