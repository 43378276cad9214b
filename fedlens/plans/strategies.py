"""Combining rules by strategy name.

A rule takes the client updates of a round (``round, client_id, layer, pos, v, n``), the server
state (``layer, pos, x`` and moments) and the run configuration, and gives the next state. New
rules are added with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedlens.operators import combine as C
from fedlens.operators import krum as K

Combine = Callable[[DataFrame, DataFrame, Mapping[str, Any]], DataFrame]


@dataclass(frozen=True)
class Rule:
    combine: Combine
    moments: Sequence[str] = ()

    def start(self, model: DataFrame) -> DataFrame:
        return C.server_state(model, self.moments)


def _replace(mean: DataFrame, state: DataFrame) -> DataFrame:
    """Stateless rules: the combined vector is the model; coordinates nobody sent stay."""
    return C.carry_forward(model_of(state), mean).withColumnRenamed("v", "x")


def model_of(state: DataFrame, *keys: str) -> DataFrame:
    return state.select(*keys, "layer", "pos", F.col("x").alias("v"))


def _mean(updates, state, config):
    return _replace(C.fedavg(updates), state)


def _median(updates, state, config):
    return _replace(C.coordinate_median(updates), state)


def _trimmed(updates, state, config):
    return _replace(C.trimmed_mean(updates, config.get("beta", 0.2)), state)


def _krum(updates, state, config):
    blocks = C.to_blocks(updates, ["round", "client_id"])
    distances = K.tile_distances(blocks, config["total-nodes"], config["n_params"])
    # neighbours are counted among the clients that replied in this round
    scores = K.krum_scores(distances, config["replied"], config.get("num-malicious-nodes", 0))
    return _replace(K.multikrum(updates, K.krum_select(scores, config.get("num_nodes_to_select", 1))), state)


def _avgm(updates, state, config):
    return C.avgm_step(
        state, C.fedavg(updates), config.get("server_learning_rate", 1.0), config.get("server_momentum", 0.0)
    )


def _adaptive(step):
    def combine(updates, state, config):
        return step(
            state, C.fedavg(updates), config.get("eta", 0.1), config.get("beta_1", 0.9),
            config.get("beta_2", 0.999), config.get("tau", 0.001),
        )

    return combine


RULES: dict[str, Rule] = {
    "fedavg": Rule(_mean),
    "fedprox": Rule(_mean),
    "median": Rule(_median),
    "trimmed_avg": Rule(_trimmed),
    "multikrum": Rule(_krum),
    "fedavgm": Rule(_avgm, ("m",)),
    "fedadam": Rule(_adaptive(C.adam_step), ("m", "v")),
    "fedyogi": Rule(_adaptive(C.yogi_step), ("m", "v")),
}


def register(name: str, rule: Rule) -> None:
    RULES[name] = rule


def with_privacy(rule: Rule, clip: float, noise_multiplier: float, n_sampled: int) -> Rule:
    """Clips every update before the rule and adds noise to the model after it."""

    def combine(updates, state, config):
        clipped = C.clip_updates(updates, model_of(state), clip)
        new = rule.combine(clipped, state, config)
        seed = config.get("seed", 42) + config.get("round", 0)
        return C.add_noise(new, noise_multiplier, clip, n_sampled, seed, "x").select(*state.columns)

    return Rule(combine, rule.moments)


def rule_for(config: Mapping[str, Any]) -> Rule:
    rule = RULES[config["strategy-name"]]
    if config.get("use_dp"):
        sampled = max(1, int(config["total-nodes"] * config["fraction-train"]))
        rule = with_privacy(rule, config["dp_clipping_norm"], config["dp_noise_multiplier"], sampled)
    return rule
