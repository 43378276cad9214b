"""Assigning samples to clients and splits, and choosing clients per round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.functions.hashing import draw, pick, uniform
from fedlens.operators.ranking import rank_by_draw
from fedlens.session import cut_lineage

SHARE_BUCKETS = 1024  # pieces of [0, 1) by which rows find the slice of a share table they fall into


def assign_iid(df: DataFrame, n_clients: int, seed: int, id_col: str = "sample_id", tag: str = "part") -> DataFrame:
    """Uniform clients, equal in expectation; a projection, no shuffle."""
    return df.withColumn("client_id", pick(n_clients, seed, tag, id_col))


def assign_iid_balanced(df: DataFrame, n_clients: int, seed: int, id_col: str = "sample_id") -> DataFrame:
    """Uniform clients whose sizes differ by one row at most."""
    ranked = rank_by_draw(df, draw(seed, "part", id_col), id_col)
    client = F.pmod(F.col("rank") - 1, F.lit(n_clients)).cast("int")
    return ranked.withColumn("client_id", client).select(*df.columns, "client_id")


def dirichlet_shares(n_classes: int, n_clients: int, alpha: float, seed: int) -> np.ndarray:
    """Share of each class held by each client: one Dirichlet draw per class."""
    return np.random.default_rng(seed).dirichlet([alpha] * n_clients, size=n_classes)


def share_intervals(shares: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(label, client, lo, hi): the slice of [0, 1) each client takes of each class."""
    rows = []
    for label, row in enumerate(shares):
        edges = np.concatenate([[0.0], np.cumsum(row)])
        edges[-1] = 1.0
        rows += [
            (label, client, float(lo), float(hi))
            for client, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
            if hi > lo
        ]
    return rows


def share_table(weights: DataFrame) -> DataFrame:
    """(label, client_id, weight) -> each client's slice [lo, hi) of its class, in order of the clients.

    Prefix sums run per class over the clients; neither shares nor slices pass through the driver.
    """
    clients = W.partitionBy("label").orderBy("client_id")
    until = F.sum("weight").over(clients.rowsBetween(W.unboundedPreceding, 0))
    total, last = F.sum("weight").over(W.partitionBy("label")), F.max("client_id").over(W.partitionBy("label"))
    summed = weights.where("weight > 0").select("label", "client_id", "weight", until.alias("_until"), total.alias("_total"), last.alias("_last"))
    return summed.select(
        F.col("label").cast("int").alias("label"), F.col("client_id").cast("int").alias("client_id"),
        ((F.col("_until") - F.col("weight")) / F.col("_total")).alias("lo"),
        F.when(F.col("client_id") == F.col("_last"), F.lit(1.0)).otherwise(F.col("_until") / F.col("_total")).alias("hi"),
    )


def dirichlet_table(spark: SparkSession, n_classes: int, n_clients: int, alpha: float, seed: int) -> DataFrame:
    """``share_table`` of one Dirichlet draw per class: gamma draws, each keyed by seed, class and client.

    A client's draw hangs on nothing else, so a retried task gives it again.
    """

    @F.arrow_udf("double")
    def gamma(label: pa.Array, client: pa.Array) -> pa.Array:
        keys = zip(label.to_pylist(), client.to_pylist())
        return pa.array([np.random.default_rng([seed, *key]).standard_gamma(alpha) for key in keys], pa.float64())

    cells = spark.range(n_classes * n_clients)
    keyed = cells.select(F.expr(f"cast(id div {n_clients} as int)").alias("label"), (F.col("id") % n_clients).cast("int").alias("client_id"))
    return share_table(keyed.withColumn("weight", gamma("label", "client_id")))


def place_dirichlet(
    df: DataFrame, shares: np.ndarray | DataFrame, seed: int, id_col: str = "sample_id", label_col: str = "label"
) -> DataFrame:
    """Label-skewed clients: each row falls into one interval of its class; labels without shares get no client.

    ``shares`` is a matrix (class, client) or a table of slices as ``share_table`` makes it.

    Intervals are cut at bucket edges so the lookup is an equi-join on (label, bucket). The
    interval table has classes x (clients + buckets) rows of known size; Catalyst broadcasts it
    while it is below the broadcast threshold and otherwise shuffles on (label, bucket), which
    spreads a dominant class over all its buckets.
    """
    spark = df.sparkSession
    if isinstance(shares, DataFrame):
        buckets = SHARE_BUCKETS
        slices = cut_lineage(spark, shares, "shares").toDF("_label", "client_id", "_lo", "_hi")  # of known size when joined
    else:
        buckets = max(64, shares.shape[1])
        slices = spark.createDataFrame(share_intervals(shares), "_label int, client_id int, _lo double, _hi double")
    intervals = (
        slices.withColumn(
            "_bucket",
            F.explode(
                F.sequence(
                    F.floor(F.col("_lo") * buckets).cast("int"),
                    F.least(F.floor(F.col("_hi") * buckets).cast("int"), F.lit(buckets - 1)),
                )
            ),
        )
    )
    placed = df.withColumn("_u", uniform(seed, "dirichlet", id_col)).withColumn(
        "_row_bucket", F.floor(F.col("_u") * buckets).cast("int")
    )
    return placed.join(
        intervals,
        (F.col(label_col) == F.col("_label"))
        & (F.col("_row_bucket") == F.col("_bucket"))
        & (F.col("_u") >= F.col("_lo"))
        & (F.col("_u") < F.col("_hi")),
        "left",
    ).select(*df.columns, "client_id")


def assign_dirichlet(
    df: DataFrame, shares: np.ndarray | DataFrame, seed: int, id_col: str = "sample_id", label_col: str = "label"
) -> DataFrame:
    """The rows that have a client; the others are in ``dirichlet_rejects``."""
    return place_dirichlet(df, shares, seed, id_col, label_col).where(F.col("client_id").isNotNull())


def dirichlet_rejects(
    df: DataFrame, shares: np.ndarray | DataFrame, seed: int, id_col: str = "sample_id", label_col: str = "label"
) -> DataFrame:
    """The rows that no client gets: their label is null or has no shares."""
    return place_dirichlet(df, shares, seed, id_col, label_col).where(F.col("client_id").isNull()).select(df.columns)


def split_train_val(df: DataFrame, val_share: float, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Adds ``split``; the validation share holds in expectation."""
    val = uniform(seed, "split", id_col) < F.lit(val_share)
    return df.withColumn("split", F.when(val, F.lit("val")).otherwise(F.lit("train")))


def split_train_val_exact(df: DataFrame, val_share: float, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Adds ``split`` with ceil(share x rows) validation rows in every client."""
    ranked = rank_by_draw(df, draw(seed, "split", id_col), id_col, ["client_id"])
    val = F.col("rank") <= F.ceil(F.col("group_size") * F.lit(val_share))
    return ranked.withColumn("split", F.when(val, F.lit("val")).otherwise(F.lit("train"))).select(*df.columns, "split")


def sample_clients(clients: DataFrame, fraction: float, total_nodes: int, seed: int) -> DataFrame:
    """Clients taking part in each round: at least one, else the whole part of the fraction."""
    wanted = max(1, int(total_nodes * fraction))
    ranked = rank_by_draw(clients, draw(seed, "round", "round", "client_id"), "client_id", ["round"], bits=6)
    return ranked.where(F.col("rank") <= wanted).select(*clients.columns, "rank")


def label_distribution(df: DataFrame, n_classes: int) -> DataFrame:
    """Rows per client and label, one column per label."""
    columns = [F.count_if(F.col("label") == label).alias(f"label_{label}") for label in range(n_classes)]
    return df.groupBy("client_id").agg(*columns)
