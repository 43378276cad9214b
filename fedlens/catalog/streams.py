"""Streaming queries, run to the end of the input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedlens.session import workspace
from fedlens.streaming import client_state as C
from fedlens.streaming import closing as E
from fedlens.streaming import rounds as R
from fedlens.streaming import upsert as U
from fedlens.streaming.feeds import event_feed, replies_from

LOG_KEYS, LOG_ORDER = ("run_id", "round"), ("ts", "event_id")


def _drain(query):
    query.awaitTermination()


def stream_upsert(spark, sf):
    """Rounds of every run as they are sent; a re-sent round replaces the earlier one."""
    feed = replies_from(event_feed(spark, sf)).select("run_id", "round", "ts", "event_id", "accuracy", "event_type")
    target = workspace(spark, "stream-log")
    _drain(U.start_upsert(feed, target, workspace(spark, "stream-log-checkpoint"), LOG_KEYS, LOG_ORDER))
    rows = U.read_latest(spark, target, feed.schema, LOG_KEYS, LOG_ORDER)
    return rows.select("run_id", "round", F.round("accuracy", 6).alias("accuracy"), "event_type", "event_id")


def stream_round_metrics(spark, sf):
    means = R.round_means(replies_from(event_feed(spark, sf)))
    target = workspace(spark, "stream-rounds")
    _drain(R.start_round_log(means, target, workspace(spark, "stream-rounds-checkpoint")))
    rows = spark.read.schema(means.schema).parquet(target)
    return rows.select(
        F.date_format("round_start", "yyyy-MM-dd").alias("round_start"), "event_type",
        F.round("train_loss", 6).alias("train_loss"), "num_examples",
    )


def stream_client_state(spark, sf):
    state = C.latest_per_client(replies_from(event_feed(spark, sf)))
    target = workspace(spark, "stream-state")
    _drain(U.start_upsert(state, target, workspace(spark, "stream-state-checkpoint"), C.KEYS, C.ORDER, "update"))
    rows = U.read_latest(spark, target, state.schema, C.KEYS, C.ORDER)
    return rows.select("client_id", "round", F.round("train_loss", 6).alias("train_loss"), "event_id", "n_replies")


WAITS, ROSTER = "12 hours", 6


def stream_round_close(spark, sf):
    """Daily rounds of six groups of clients that close when all have replied, or at noon."""
    feed = replies_from(event_feed(spark, sf)).withColumn("client_id", F.pmod("client_id", F.lit(ROSTER)))
    target = workspace(spark, "stream-closing")
    _drain(E.start_closing(feed, target, workspace(spark, "stream-closing-checkpoint"), timeout=WAITS))
    late = E.late_replies(spark, target).groupBy("round_start").agg(F.count("*").alias("n_late"))
    rounds = E.closed_rounds(spark, target, ROSTER, WAITS).join(late, "round_start", "full_outer")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rounds.select(
        text("round_start").alias("round_start"), "closed_by", text("closed_at").alias("closed_at"), "n_clients",
        "num_examples", F.round("train_loss", 6).alias("train_loss"), F.coalesce("n_late", F.lit(0)).alias("n_late"),
    )


QUERIES = {f.__name__: f for f in (stream_upsert, stream_round_metrics, stream_client_state, stream_round_close)}

SQL = {
    "stream_upsert": """WITH ranked AS (SELECT user_id % 150 AS run_id, day(ts)::INT AS round, value / 503 AS accuracy, event_type,
          event_id, row_number() OVER (PARTITION BY user_id % 150, day(ts) ORDER BY ts DESC, event_id DESC) AS r FROM events)
        SELECT run_id, round, round(accuracy, 6) AS accuracy, event_type, event_id FROM ranked WHERE r = 1""",
    # rounds still open at the end of the input are not emitted
    "stream_round_metrics": """WITH r AS (SELECT date_trunc('day', ts)::TIMESTAMP AS s, event_type, user_id % 50 + 1 AS n, value / 101 AS loss FROM events)
        SELECT strftime(s, '%Y-%m-%d') AS round_start, event_type, round(sum(n * loss) / sum(n), 6) AS train_loss,
          sum(n)::BIGINT AS num_examples FROM r
        WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY s, event_type""",
    "stream_round_close": """WITH r AS (SELECT date_trunc('day', ts)::TIMESTAMP AS s, ts, event_id, user_id % 6 AS client_id,
          user_id % 50 + 1 AS n, value / 101 AS loss FROM events),
        firsts AS (SELECT * FROM r WHERE ts <= s + INTERVAL 12 HOUR QUALIFY row_number() OVER (PARTITION BY s, client_id ORDER BY ts, event_id) = 1),
        rounds AS (SELECT s, count(*) AS k, max(ts) AS last_reply, round(sum(n * loss) / sum(n), 6) AS loss, sum(n)::BIGINT AS n FROM firsts GROUP BY s),
        late AS (SELECT s, count(*) AS m FROM r WHERE ts > s + INTERVAL 12 HOUR GROUP BY s),
        judged AS (SELECT coalesce(rounds.s, late.s) AS s, k, loss, n, m, last_reply,
          CASE WHEN k >= 6 THEN 'complete' WHEN (SELECT max(ts) FROM events) > rounds.s + INTERVAL 12 HOUR THEN 'timeout'
            WHEN k IS NOT NULL THEN 'open' END AS closed_by FROM rounds FULL JOIN late ON late.s = rounds.s)
        SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS round_start, closed_by,
          strftime(CASE closed_by WHEN 'complete' THEN last_reply WHEN 'timeout' THEN s + INTERVAL 12 HOUR END, '%Y-%m-%d %H:%M:%S') AS closed_at,
          k AS n_clients, n AS num_examples, loss AS train_loss, coalesce(m, 0) AS n_late FROM judged""",
    "stream_client_state": """WITH ranked AS (SELECT user_id AS client_id, day(ts)::INT AS round, value / 101 AS train_loss, event_id,
          count(*) OVER (PARTITION BY user_id) AS n_replies,
          row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
        SELECT client_id, round, round(train_loss, 6) AS train_loss, event_id, n_replies FROM ranked WHERE r = 1""",
}
