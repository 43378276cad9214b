"""Row transforms within training and evaluation.

A transform object has ``train(rows, config, r)``, applied to the training rows of a run before the fit of round ``r``, and
``judge(rows)``, applied to rows that are scored. Draws are keyed by seed, round and sample, so every round sees its own
crops, flips and poisoned rows, and a retried task sees them again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedlens.operators.features import crop_and_flip, crop_offsets, flip_drawn, normalize
from fedlens.operators.poison import poison_samples


@dataclass(frozen=True)
class AttackOnly:
    """Features as they are; only the configured attack is applied."""

    width: int

    def train(self, rows: DataFrame, config: Mapping[str, Any], r: int) -> DataFrame:
        return poison_samples(rows, {**config, "seed": config.get("seed", 42) + r}, self.width)

    def judge(self, rows: DataFrame) -> DataFrame:
        return rows


@dataclass(frozen=True)
class Pictures:
    """Random crop, random flip, attack, standardised pixels; scored rows are standardised only."""

    width: int
    padding: int = 4

    def train(self, rows: DataFrame, config: Mapping[str, Any], r: int) -> DataFrame:
        seed, columns = config.get("seed", 42) + r, rows.columns
        dy, dx = crop_offsets(seed, self.padding)
        moved = crop_and_flip(F.col("features"), self.width, self.padding, F.col("_dy"), F.col("_dx"), F.col("_flip"))
        cropped = rows.withColumns({"_dy": dy, "_dx": dx, "_flip": flip_drawn(seed)}).withColumn("features", moved).select(columns)
        return self.judge(AttackOnly(self.width).train(cropped, config, r))

    def judge(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("features", normalize(F.col("features")))
