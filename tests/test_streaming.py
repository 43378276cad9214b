import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fedlens.streaming import client_state as C
from fedlens.streaming import closing as E
from fedlens.streaming import rounds as R
from fedlens.streaming import upsert as U

SCHEMA = "event_id bigint, ts timestamp, event_type string, run_id bigint, client_id bigint, round int, num_examples bigint, train_loss double"
KEYS, ORDER = ("run_id", "round"), ("ts", "event_id")
DAY = dt.datetime(2024, 1, 1)


def reply(i, hours, run_id, rnd, loss, n=10):
    return (i, DAY + dt.timedelta(hours=hours), "k", run_id, run_id, rnd, n, loss)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches as files of rising age and returns them as a stream, one file per batch."""
    folder, made = str(tmp_path / "feed"), []

    def build(*batches):
        for batch in batches:
            target = f"{folder}/{len(made)}.parquet"
            spark.createDataFrame(batch, SCHEMA).toPandas().assign(ts=lambda d: d["ts"].astype("datetime64[us]")).to_parquet(
                _made(folder, target), index=False
            )
            os.utime(target, (1_700_000_000 + 10 * len(made),) * 2)
            made.append(target)
        return spark.readStream.schema(SCHEMA.replace("timestamp", "timestamp_ntz")).option("maxFilesPerTrigger", 1).parquet(folder).withColumn(
            "ts", F.col("ts").cast("timestamp")
        )

    return build


def _made(folder, target):
    os.makedirs(folder, exist_ok=True)
    return target


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_upsert_over_batches_equals_batch_result(spark, feed, tmp_path):
    batches = [
        [reply(1, 1, 1, 1, 0.9), reply(2, 2, 1, 2, 0.8), reply(3, 3, 2, 1, 0.7)],
        [reply(4, 4, 1, 1, 0.1), reply(5, 5, 1, 1, 0.2)],
        [reply(6, 6, 3, 1, 0.5), reply(7, 1, 2, 1, 9.9)],  # event 7 is older than what it would replace
    ]
    stream = feed(*batches)
    target = str(tmp_path / "log")
    drain(U.start_upsert(stream, target, str(tmp_path / "cp"), KEYS, ORDER))
    assert len([d for d in os.listdir(target) if d.startswith("batch=")]) == 3
    got = U.read_latest(spark, target, stream.schema, KEYS, ORDER)
    flat = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert rows(got.select("run_id", "round", "event_id")) == rows(U.latest(flat, KEYS, ORDER).select("run_id", "round", "event_id"))
    assert rows(got.select("run_id", "round", "event_id")) == [(1, 1, 5), (1, 2, 2), (2, 1, 3), (3, 1, 6)]
    # a batch written again does not add rows, and folding keeps the result
    before = rows(got)
    spark.read.schema(stream.schema).parquet(f"{target}/batch=1").repartition(1).write.parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("overwrite").parquet(f"{target}/batch=1")
    assert rows(U.read_latest(spark, target, stream.schema, KEYS, ORDER)) == before
    U.compact(spark, target, str(tmp_path / "folded"), stream.schema, KEYS, ORDER)
    assert rows(U.read_latest(spark, str(tmp_path / "folded"), stream.schema, KEYS, ORDER)) == before


def test_late_replies_do_not_count(spark, feed, tmp_path):
    stream = feed(
        [reply(1, 1, 1, 1, 1.0), reply(2, 2, 1, 1, 3.0, 30)],
        [reply(3, 30, 1, 2, 5.0)],  # moves the watermark past the first day
        [reply(8, 30.5, 1, 2, 6.0)],  # the day is closed here; late rows are told by the mark before
        [reply(4, 3, 1, 1, 100.0), reply(5, 31, 1, 2, 7.0)],  # event 4 is late
        [reply(6, 80, 1, 4, 1.0)],
    )
    means = R.round_means(stream)
    drain(R.start_round_log(means, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = rows(spark.read.schema(means.schema).parquet(str(tmp_path / "out")).select(F.date_format("round_start", "dd"), "train_loss", "num_examples"))
    assert got == [("01", 2.5, 40), ("02", 6.0, 30)]


def test_client_state_keeps_the_newest_reply(spark, feed, tmp_path):
    stream = feed([reply(1, 1, 1, 1, 1.0), reply(2, 2, 2, 1, 2.0)], [reply(3, 30, 1, 2, 3.0)])
    state = C.latest_per_client(stream)
    target = str(tmp_path / "state")
    drain(U.start_upsert(state, target, str(tmp_path / "cp"), C.KEYS, C.ORDER, "update"))
    got = U.read_latest(spark, target, state.schema, C.KEYS, C.ORDER)
    assert rows(got.select("client_id", "train_loss", "n_replies")) == [(1, 3.0, 2), (2, 2.0, 1)]


REPLIES = [
    [reply(1, 1, 1, 1, 1.0, 10), reply(2, 2, 2, 1, 3.0, 30)],  # day 1 is complete at hour 2
    [reply(3, 3, 1, 1, 9.0, 99), reply(4, 11, 2, 1, 9.0, 99)],  # a second reply, and one after the deadline
    [reply(5, 25, 1, 2, 5.0, 10)],  # day 2 waits for client 2 in vain
    [reply(6, 40, 2, 2, 5.0, 10), reply(7, 49, 1, 3, 2.0, 20)],  # late; day 3 is open
]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_rounds_close_alike_for_any_file_order(spark, feed, tmp_path, order):
    target = str(tmp_path / "closing")
    drain(E.start_closing(feed(*[REPLIES[i] for i in order]), target, str(tmp_path / "cp"), timeout="10 hours"))
    got = rows(E.closed_rounds(spark, target, 2, "10 hours").select(
        F.date_format("round_start", "dd"), "closed_by", F.date_format("closed_at", "dd HH"), "n_clients", "num_examples", "train_loss"
    ))
    assert got == [
        ("01", "complete", "01 02", 2, 40, 2.5), ("02", "timeout", "02 10", 1, 10, 5.0), ("03", "open", None, 1, 20, 2.0),
    ]
    assert rows(E.late_replies(spark, target).select("event_id")) == [(4,), (6,)]
