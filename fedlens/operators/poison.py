"""Attacks on client data and client updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedlens.functions.hashing import gaussian, uniform

# Every label except 9 and the target itself is relabelled as class 2.
FLIP_MAP = {0: 2, 1: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2}
# The backdoor trigger is a 3x3 patch of ones in the top-left corner.
TRIGGER_SIZE = 3
TRIGGER_VALUE = 1.0
# Fixed value: deviation of the noise a Byzantine client adds to every parameter.
BYZANTINE_STD = 0.5


def is_malicious(malicious_ids: Sequence[int], client: str = "client_id") -> Column:
    return F.col(client).isin(*malicious_ids) if malicious_ids else F.lit(False)


def flipped_label(attacked: Column, probability: float, seed: int, flip_map: Mapping[int, int] = FLIP_MAP) -> Column:
    """Label after flipping; ``attacked`` says which rows are under attack."""
    targets = F.create_map(*[F.lit(v) for pair in flip_map.items() for v in pair])
    hit = attacked & F.col("label").isin(*flip_map) & (uniform(seed, "flip", "sample_id") < F.lit(probability))
    return F.when(hit, F.element_at(targets, F.col("label"))).otherwise(F.col("label"))


def stamp_trigger(features: Column, width: int) -> Column:
    """The picture with the trigger patch set: the first rows rebuilt, the rest taken over whole."""
    patch = F.array_repeat(F.lit(TRIGGER_VALUE), TRIGGER_SIZE)
    top = [
        piece
        for row in range(TRIGGER_SIZE)
        for piece in (patch, F.slice(features, row * width + TRIGGER_SIZE + 1, width - TRIGGER_SIZE))
    ]
    rest = F.slice(features, TRIGGER_SIZE * width + 1, F.size(features) - TRIGGER_SIZE * width)
    return F.concat(*top, rest)


def inject_backdoor(df: DataFrame, attacked: Column, width: int, target: int, rate: float, seed: int) -> DataFrame:
    """Stamps and relabels the share ``rate`` of the attacked rows."""
    marked = df.withColumn("poisoned", attacked & (uniform(seed, "backdoor", "sample_id") < F.lit(rate)))
    return marked.withColumn(
        "features", F.when(F.col("poisoned"), stamp_trigger(F.col("features"), width)).otherwise(F.col("features"))
    ).withColumn("label", F.when(F.col("poisoned"), F.lit(target)).otherwise(F.col("label")))


ATTACKS = ("label_flipping", "backdoor", "byzantine")


def effective_attack(configured: Column, malicious_ids: Sequence[int]) -> Column:
    """The attack a client carries out: the configured one if it is malicious, else none."""
    return F.when(is_malicious(malicious_ids) & configured.isin(*ATTACKS), configured).otherwise(F.lit("none"))


def trains(effective: Column) -> Column:
    """Byzantine clients skip local training."""
    return effective != "byzantine"


def poison_samples(df: DataFrame, config: Mapping[str, Any], width: int) -> DataFrame:
    """Applies the configured data attack to the training rows of malicious clients."""
    seed = config.get("seed", 42)
    attack = config.get("attack_name") or "none"
    attacked = is_malicious(config.get("malicious-clients-ids") or [])
    if "split" in df.columns:
        attacked = attacked & (F.col("split") == "train")
    if attack == "label_flipping":
        return df.withColumn("label", flipped_label(attacked, config.get("attack_flip-fraction", 1.0), seed))
    if attack == "backdoor":
        return inject_backdoor(
            df, attacked, width, config.get("attack_target_class", 1), config.get("attack_injection_rate", 0.1), seed
        ).drop("poisoned")
    return df


def byzantine_updates(updates: DataFrame, current: DataFrame, malicious_ids: Sequence[int], seed: int) -> DataFrame:
    """Malicious clients answer with the current global model plus noise; others keep their update."""
    noisy = F.col("x") + F.lit(BYZANTINE_STD) * gaussian(seed, "byzantine", "client_id", "round", "layer", "pos")
    return (
        updates.join(current.select("layer", "pos", F.col("v").alias("x")), ["layer", "pos"])
        .withColumn("v", F.when(is_malicious(malicious_ids), noisy).otherwise(F.col("v")))
        .select(*updates.columns)
    )
