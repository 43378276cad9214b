"""Scenario grid and run manifest."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Configuration shared by all runs.
BASE_CONFIG: dict[str, Any] = {
    "total-nodes": 10,
    "num-server-rounds": 40,
    "fraction-train": 1.0,
    "fraction-evaluate": 1.0,
    "client-timeout": 3600,
    "local-epochs": 1,
    "batch-size": 32,
    "lr": 0.01,
    "momentum": 0.9,
    "partitioner-name": "iid",
    "dirichlet-alpha": 0.0,
    "val-split-percentage": 0.2,
    "seed": 42,
    "strategy-name": "fedavg",
    "personalization": False,
    "proximal-mu": 0.0,
    "beta": 0.2,
    "num_nodes_to_select": 1,
    "num-malicious-nodes": 0,
    "eta": 0.1,
    "eta_l": 0.1,
    "beta_1": 0.9,
    "beta_2": 0.999,
    "tau": 0.001,
    "server_learning_rate": 1.0,
    "server_momentum": 0.0,
    "attack_target_class": 1,
    "attack_injection_rate": 0.1,
}
REPETITIONS = 15

# Parameters of each strategy in the grid, under its report name.
STRATEGY_PARAMS: dict[str, dict[str, Any]] = {
    "FedAvg": {"strategy-name": "fedprox", "proximal-mu": 0.0},
    "FedProx": {"strategy-name": "fedprox", "proximal-mu": 0.01},
    "FedAvgM": {"strategy-name": "fedavgm", "server_learning_rate": 1.0, "server_momentum": 0.7},
    "FedAdam": {"strategy-name": "fedadam", "eta": 0.1, "eta_l": 0.1, "beta_1": 0.7, "beta_2": 0.99, "tau": 0.01},
    "FedYogi": {"strategy-name": "fedyogi", "eta": 0.01, "eta_l": 0.0316, "beta_1": 0.7, "beta_2": 0.99, "tau": 0.001},
}
# Malicious clients by number of attackers, and the attacker counts that were run.
ATTACKER_IDS = {1: [3], 2: [3, 5], 3: [3, 5, 7]}
BACKDOOR_RUNS = [(None, 2), (0.1, 2), (0.5, 1)]
BYZANTINE_RUNS = [(None, 2), (0.1, 2), (0.5, 2)]
LABEL_FLIP_RUNS = [(None, 3), (0.1, 3), (None, 1), (0.1, 1), (0.5, 2)]


def _partition(alpha: float | None) -> dict[str, Any]:
    if alpha is None:
        return {"partitioner-name": "iid"}
    return {"partitioner-name": "dirichlet", "dirichlet-alpha": alpha}


def _tag(alpha: float | None, separator: str) -> str:
    return "IID" if alpha is None else "nonIID_a" + str(alpha).replace(".", separator)


def _robust_params(name: str, attackers: int, beta: float) -> dict[str, Any]:
    return {
        "FedAvg": {"strategy-name": "fedprox", "proximal-mu": 0.0},
        "FedTrimmedAvg": {"strategy-name": "trimmed_avg", "beta": beta},
        "FedMedian": {"strategy-name": "median"},
        "MultiKrum": {
            "strategy-name": "multikrum",
            "num-malicious-nodes": attackers,
            "num_nodes_to_select": BASE_CONFIG["total-nodes"] - attackers,
        },
    }[name]


def _attack_scenarios(prefix: str, runs, attack: dict[str, Any], beta_of) -> list[dict[str, Any]]:
    return [
        {
            "scenario_name": f"{prefix}_Attack_{name}_{_tag(alpha, '')}",
            **_robust_params(name, attackers, beta_of(attackers)),
            **_partition(alpha),
            "malicious-clients-ids": ATTACKER_IDS[attackers],
            **attack,
        }
        for alpha, attackers in runs
        for name in ("FedAvg", "FedTrimmedAvg", "FedMedian", "MultiKrum")
    ]


def scenario_definitions() -> list[dict[str, Any]]:
    """All scenarios of the grid as differences from ``BASE_CONFIG``."""
    participation = lambda share: {"fraction-train": share, "fraction-evaluate": share}
    suffix = lambda share: "_frac" + str(share).replace(".", "")
    plain = [
        {"scenario_name": f"{name}_{_tag(alpha, '_')}", **params, **_partition(alpha)}
        for alpha in (None, 0.1, 0.03, 0.5)
        for name, params in STRATEGY_PARAMS.items()
    ]
    private = [
        {
            "scenario_name": "FedAvg_IID_DP_noise03",
            **STRATEGY_PARAMS["FedAvg"],
            **_partition(None),
            "use_dp": True,
            "dp_noise_multiplier": 0.0,
            "dp_clipping_norm": 100000,
            **participation(0.5),
        }
    ]
    partial = [
        {
            "scenario_name": f"{name}_{_tag(alpha, '_')}{suffix(share)}",
            **STRATEGY_PARAMS[name],
            **_partition(alpha),
            **participation(share),
        }
        for alpha in (0.03, 0.1, 0.5)
        for share in (0.8, 0.7)
        for name in ("FedAvg", "FedAvgM", "FedAdam", "FedYogi")
    ]
    personal = [
        {
            "scenario_name": f"FedAvg_{_tag(alpha, '_')}_personalized{suffix(share) if share < 1 else ''}",
            **STRATEGY_PARAMS["FedAvg"],
            **_partition(alpha),
            "personalization": True,
            **(participation(share) if share < 1 else {}),
        }
        for alpha in (None, 0.5, 0.1, 0.03)
        for share in (1.0, 0.8, 0.7)
    ]
    backdoor = _attack_scenarios(
        "Backdoor", BACKDOOR_RUNS,
        {"attack_name": "backdoor", "attack_target_class": 1, "attack_injection_rate": 0.15}, lambda k: 0.2,
    )
    flips = _attack_scenarios(
        "LabelFlip", LABEL_FLIP_RUNS, {"attack_name": "label_flipping", "attack_flip-fraction": 1.0}, lambda k: k / 10
    )
    byzantine = _attack_scenarios("Byzantine", BYZANTINE_RUNS, {"attack_name": "byzantine"}, lambda k: 0.2)
    return plain + private + backdoor + flips + byzantine + personal + partial


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def scenarios_frame(spark: SparkSession, definitions: list[dict[str, Any]] | None = None) -> DataFrame:
    """Definitions as rows: scenario_name and the overrides as a text map.

    Only the first scenario of the grid is switched on, as in the published configuration.
    """
    definitions = scenario_definitions() if definitions is None else definitions
    rows = [
        (i, d["scenario_name"], {k: _text(v) for k, v in d.items()}, i == 0) for i, d in enumerate(definitions)
    ]
    return spark.createDataFrame(rows, "scenario_id int, scenario_name string, overrides map<string,string>, enabled boolean")


def overlay(base: Column, overrides: Column) -> Column:
    """Overrides, and the base entries they do not name."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(overrides, k)), overrides)


def run_manifest(
    scenarios: DataFrame, base: dict[str, Any] = BASE_CONFIG, repetitions: int = REPETITIONS
) -> DataFrame:
    """One row per scenario and repetition with its full configuration; the seed grows by one.

    Maps are merged once per scenario; a repetition only adds its seed.
    """
    shared = F.create_map(*[F.lit(_text(v)) for k, v in base.items() if k != "seed" for v in (k, v)])
    overrides = F.map_filter("overrides", lambda k, _: k != "seed")
    seed = (F.lit(base["seed"]) + F.col("repetition")).cast("int")
    return (
        scenarios.withColumn("overrides", overrides)
        .withColumn("config", overlay(shared, F.col("overrides")))
        .drop("overrides")
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
        .withColumn("seed", seed)
        .withColumn("config", F.map_concat("config", F.create_map(F.lit("seed"), F.col("seed").cast("string"))))
    )
