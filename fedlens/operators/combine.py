"""Combining client parameter vectors into the next global model.

Long model rows are ``round, client_id, layer, pos, v, n``; blocked rows carry
``layer, block, vals`` instead of ``layer, pos, v``. Server state is ``layer, pos, x`` plus the
moments a rule needs, so each rule is one aggregation and one equi-join. A coordinate for which
a round brings no mean keeps its value and its moments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.functions.arrays import squared_norm, subtract
from fedlens.functions.hashing import gaussian
from fedlens.operators.ranking import values_at

COORD = ("layer", "pos")
BLOCK_SIZE = 4096


# --- layout ---------------------------------------------------------------------------------

def to_blocks(model: DataFrame, keys: Sequence[str] = (), block_size: int = BLOCK_SIZE) -> DataFrame:
    """Long rows -> blocks of at most ``block_size`` values in position order."""
    packed = model.groupBy(*keys, "layer", F.floor(F.col("pos") / block_size).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_items")
    )
    return packed.select(*keys, "layer", "block", F.col("_items.v").alias("vals"))


def to_long(blocks: DataFrame, keys: Sequence[str] = (), block_size: int = BLOCK_SIZE) -> DataFrame:
    return blocks.select(*keys, "layer", "block", F.posexplode("vals").alias("_i", "v")).select(
        *keys, "layer", (F.col("block") * block_size + F.col("_i")).alias("pos"), "v"
    )


def replied(updates: DataFrame) -> DataFrame:
    """Rows of replies that did not fail; without the mark ``has_error`` all of them."""
    return updates.where(~F.coalesce("has_error", F.lit(False))) if "has_error" in updates.columns else updates


# --- means ----------------------------------------------------------------------------------

def fedavg(updates: DataFrame, keys: Sequence[str] = COORD) -> DataFrame:
    """Mean weighted by examples; partial sums combine before the shuffle."""
    n = F.col("n")
    return replied(updates).groupBy(*keys).agg((F.sum(n * F.col("v")) / F.sum(n)).alias("v"))


def shared_body(updates: DataFrame, private_prefix: str = "fc2.") -> DataFrame:
    """Rows of the layers that leave the client; the private layer stays behind."""
    return updates.where(~F.col("layer").startswith(private_prefix))


def carry_forward(current: DataFrame, new: DataFrame) -> DataFrame:
    """The new model, and the current value wherever the round produced none."""
    return current.join(new.withColumnRenamed("v", "_new"), list(COORD), "left").select(
        *COORD, F.coalesce("_new", "v").alias("v")
    )


# --- stateful server rules ------------------------------------------------------------------

def _with_mean(state: DataFrame, mean: DataFrame) -> DataFrame:
    """State with the round's mean as ``a``, null for coordinates that the round did not bring."""
    return state.join(mean.select(*COORD, F.col("v").alias("a")), list(COORD), "left")


def _stepped(name: str, value: Column) -> Column:
    """The new value; a coordinate without a mean keeps its old one."""
    return F.when(F.col("a").isNull(), F.col(name)).otherwise(value).alias(name)


def server_state(model: DataFrame, moments: Sequence[str]) -> DataFrame:
    """Start of a stateful rule: the model as ``x`` and zero moments."""
    return model.select(*COORD, F.col("v").alias("x"), *[F.lit(0.0).alias(m) for m in moments])


def avgm_step(state: DataFrame, mean: DataFrame, lr: float, beta: float) -> DataFrame:
    """m <- beta m + (x - mean); x <- x - lr m."""
    m = F.lit(beta) * F.col("m") + (F.col("x") - F.col("a"))
    return (
        _with_mean(state, mean)
        .select(*COORD, "a", "x", _stepped("m", m))
        .select(*COORD, _stepped("x", F.col("x") - F.lit(lr) * F.col("m")), "m")
    )


def _adaptive_step(state: DataFrame, mean: DataFrame, second: Column, eta: float, beta_1: float, tau: float) -> DataFrame:
    return (
        _with_mean(state, mean)
        .withColumn("d", F.col("a") - F.col("x"))
        .select(*COORD, "a", "x", _stepped("m", F.lit(beta_1) * F.col("m") + F.lit(1 - beta_1) * F.col("d")), _stepped("v", second))
        .select(*COORD, _stepped("x", F.col("x") + F.lit(eta) * F.col("m") / (F.sqrt("v") + F.lit(tau))), "m", "v")
    )


def adam_step(state: DataFrame, mean: DataFrame, eta: float, beta_1: float, beta_2: float, tau: float) -> DataFrame:
    """Adaptive server step without bias correction; d = mean - x."""
    second = F.lit(beta_2) * F.col("v") + F.lit(1 - beta_2) * F.col("d") * F.col("d")
    return _adaptive_step(state, mean, second, eta, beta_1, tau)


def yogi_step(state: DataFrame, mean: DataFrame, eta: float, beta_1: float, beta_2: float, tau: float) -> DataFrame:
    """As ``adam_step`` with the additive second moment."""
    d2 = F.col("d") * F.col("d")
    second = F.col("v") - F.lit(1 - beta_2) * d2 * F.signum(F.col("v") - d2)
    return _adaptive_step(state, mean, second, eta, beta_1, tau)


# --- coordinate-wise robust rules -----------------------------------------------------------

def ranked_coordinates(updates: DataFrame, keys: Sequence[str] = COORD) -> DataFrame:
    """Client values of each coordinate with rank ``i`` and count ``k``.

    One sort per coordinate that can spill; no coordinate is held in memory as a list.
    """
    group = W.partitionBy(*keys)
    return replied(updates).withColumn("i", F.row_number().over(group.orderBy("v", "client_id"))).withColumn(
        "k", F.count("*").over(group)
    )


def coordinate_median(updates: DataFrame, keys: Sequence[str] = COORD) -> DataFrame:
    """Mean of the one or two middle values of each coordinate."""
    ranked = ranked_coordinates(updates, keys)
    middle = F.col("i").between(F.floor((F.col("k") + 1) / 2), F.ceil((F.col("k") + 1) / 2))
    return ranked.where(middle).groupBy(*keys).agg(F.avg("v").alias("v"))


def trimmed_mean(updates: DataFrame, beta: float, keys: Sequence[str] = COORD) -> DataFrame:
    """Mean after dropping floor(beta k) values from each end of each coordinate."""
    ranked = ranked_coordinates(updates, keys)
    cut = F.floor(F.lit(beta) * F.col("k"))
    return ranked.where((F.col("i") > cut) & (F.col("i") <= F.col("k") - cut)).groupBy(*keys).agg(F.avg("v").alias("v"))


# --- deltas, norms, privacy -----------------------------------------------------------------

def client_delta(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Client block minus global block; both sides are blocked rows."""
    return updates.join(current.withColumnRenamed("vals", "_x"), ["layer", "block"]).withColumn(
        "vals", subtract(F.col("vals"), F.col("_x"))
    ).drop("_x")


def update_norms(delta: DataFrame, keys: Sequence[str] = ("round", "client_id")) -> DataFrame:
    """L2 norm of each client's whole update; replies marked as failed do not count."""
    return replied(delta).groupBy(*keys).agg(F.sqrt(F.sum(squared_norm(F.col("vals")))).alias("norm"))


def norm_stats(norms: DataFrame, keys: Sequence[str] = ("round",)) -> DataFrame:
    """Least, greatest, median and 90th percentile (linear) of the norms; ranks are found by counts, not by a sort."""
    place = lambda share, k: F.lit(share) * (k - 1)
    wanted = {
        f"_{name}_{side}": (lambda k, share=share, edge=edge: edge(place(share, k)) + 1)
        for name, share in (("median", 0.5), ("p90", 0.9))
        for side, edge in (("lo", F.floor), ("hi", F.ceil))
    }
    ranked = values_at(norms, "norm", wanted | {"norm_min": lambda k: F.lit(1), "norm_max": lambda k: k}, keys)

    def between(name: str, share: float) -> Column:
        part = place(share, F.col("k")) - F.floor(place(share, F.col("k")))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + part * (high - low)).alias(f"norm_{name}")

    return ranked.select(*keys, "norm_min", "norm_max", between("median", 0.5), between("p90", 0.9))


def clip_updates(updates: DataFrame, current: DataFrame, clip: float) -> DataFrame:
    """Long client rows pulled towards the global model until the update norm is at most ``clip``."""
    delta = replied(updates).join(current.select(*COORD, F.col("v").alias("x")), list(COORD)).withColumn(
        "d", F.col("v") - F.col("x")
    )
    norms = delta.groupBy("round", "client_id").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm"))
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(clip), F.col("norm")), F.lit(1.0)))
    return delta.join(norms, ["round", "client_id"]).select(
        "round", "client_id", *COORD, (F.col("x") + scale * F.col("d")).alias("v"), "n"
    )


def add_noise(
    model: DataFrame, noise_multiplier: float, clip: float, n_sampled: int, seed: int, column: str = "v"
) -> DataFrame:
    """Gaussian noise of deviation noise_multiplier x clip / sampled clients on every parameter."""
    std = noise_multiplier * clip / n_sampled
    return model.withColumn(column, F.col(column) + F.lit(std) * gaussian(seed, "dp", "layer", "pos"))
