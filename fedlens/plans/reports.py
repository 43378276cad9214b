"""Report definitions as data: series (curves over rounds) and tables (one round)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from fedlens.plans.scenarios import scenario_definitions

TARGET_ROUND = 40

# Order of strategies in tables, metrics of each layout and table kind.
STRATEGY_ORDER = ("FedAvg", "FedProx", "FedAvgM", "FedAdam", "FedYogi", "FedMedian", "TrimmedAvg", "MultiKrum")
SERVER_METRICS = ("server_evaluation_accuracy", "server_evaluation_f1_score")
CLIENT_METRICS = ("client_evaluation_accuracy", "client_evaluation_f1_score")
ASR_METRIC = "client_evaluation_backdoor_asr"
LAYOUTS = {"standard": SERVER_METRICS + CLIENT_METRICS, "backdoor": CLIENT_METRICS + (ASR_METRIC,)}
TABLE_COLUMNS = {
    "server_accuracy": SERVER_METRICS[0],
    "server_f1_score": SERVER_METRICS[1],
    "client_accuracy": CLIENT_METRICS[0],
    "client_f1_score": CLIENT_METRICS[1],
    "client_asr": ASR_METRIC,
}
TABLE_KINDS = {
    "default": ("server_accuracy", "server_f1_score", "client_accuracy", "client_f1_score"),
    "backdoor": ("server_accuracy", "server_f1_score", "client_accuracy", "client_f1_score", "client_asr"),
    "personal": ("client_accuracy", "client_f1_score"),
}
NO_DATA = "*No data available for this configuration.*"


@dataclass(frozen=True)
class SeriesReport:
    name: str
    filters: dict[str, Any]
    series_key: str = "scenario_name"
    layout: str = "standard"
    baseline: str = "none"  # none, no_attack, no_attack_full, full_participation
    legend: dict[Any, str] = field(default_factory=dict)

    def baseline_filters(self) -> dict[str, Any] | None:
        """Filter of the clean FedAvg runs this report is compared with."""
        if self.baseline == "none":
            return None
        copied = ["partitioner-name", "dirichlet-alpha"]
        filters: dict[str, Any] = {"attack_name": "none", "strategy-name": "FedAvg", "personalization": False}
        if self.baseline == "no_attack":
            copied.append("fraction-train")
        else:
            filters["fraction-train"] = 1.0
        if self.baseline == "no_attack_full":
            filters["num_malicious_clients"] = 0
        return filters | {k: self.filters[k] for k in copied if k in self.filters}

    @property
    def baseline_name(self) -> str:
        return "FedAvg (Full Participation)" if self.baseline == "full_participation" else "FedAvg (No Attack)"

    @property
    def is_attack(self) -> bool:
        return self.baseline.startswith("no_attack")


@dataclass(frozen=True)
class TableReport:
    number: int
    title: str
    filters: dict[str, Any]
    kind: str = "default"
    index: str = "strategy-name"

    @property
    def heading(self) -> str:
        return f"### Table {self.number}: {self.title}"


CLEAN = {"attack_name": ["none", None, ""], "personalization": [False, None]}


def _part(alpha: float | None) -> dict[str, Any]:
    return {"partitioner-name": "iid"} if alpha is None else {"partitioner-name": "dirichlet", "dirichlet-alpha": alpha}


def _short(alpha: float | None) -> str:
    return "iid" if alpha is None else "noniid_a" + str(alpha).replace(".", "")


def _scenario(strategy: str, alpha: float | None, suffix: str = "") -> str:
    return f"{strategy}_{'IID' if alpha is None else 'nonIID_a' + str(alpha).replace('.', '_')}{suffix}"


STRATEGY_SETS = {
    "baseline": ("FedAvg", "FedProx", "FedAvgM"),
    "adaptive": ("FedAvg", "FedAdam", "FedYogi"),
    "all_vs_personalized": ("FedAvg", "FedProx", "FedAvgM", "FedAdam", "FedYogi"),
}


def _comparison(number: int, alpha: float | None, share: float, kind: str) -> SeriesReport:
    suffix = "" if share == 1.0 else "_frac" + str(share).replace(".", "")
    names = [_scenario(s, alpha, suffix) for s in STRATEGY_SETS[kind]]
    filters = {**_part(alpha), "fraction-train": share, **CLEAN}
    if kind == "all_vs_personalized":
        names.append(_scenario("FedAvg", alpha, "_personalized" + suffix))
        del filters["personalization"]
    return SeriesReport(
        name=f"fig_{number:02d}_{_short(alpha)}{suffix}_{kind}",
        filters={**filters, "scenario_name": names},
        baseline="none" if share == 1.0 else "full_participation",
    )


# Figure numbers by label skew (and participation), in the order of STRATEGY_SETS.
FULL_FIGURES = {None: (1, 2), 0.5: (3, 4), 0.1: (5, 6), 0.03: (9, 10)}
PERSONAL_FIGURES = {0.1: 11, 0.5: 12, 0.03: 14}
PARTIAL_FIGURES = {
    (0.1, 0.8): (15, 16, 17),
    (0.5, 0.8): (18, 19, 20),
    (0.03, 0.8): (23, 24, 30),
    (0.1, 0.7): (25, 26, 27),
    (0.5, 0.7): (28, 29, 30),
    (0.03, 0.7): (33, 34, 30),
}
ATTACK_FIGURES = {
    "backdoor": ("backdoor", {None: 35, 0.5: 36, 0.1: 37}),
    "byzantine": ("byzantine", {None: 38, 0.5: 39, 0.1: 40}),
    "label_flipping": ("labelflip", {None: 41, 0.5: 42, 0.1: 43}),
}


def series_reports() -> list[SeriesReport]:
    """The reports of the main analysis."""
    reports = [
        SeriesReport(
            "fig_00_fedavg_iid_vs_noniid",
            {
                "strategy-name": "FedAvg", "fraction-train": 1.0, **CLEAN,
                "scenario_name": [_scenario("FedAvg", a) for a in (None, 0.1, 0.5, 0.3, 0.03)],
            },
        )
    ]
    for alpha, numbers in FULL_FIGURES.items():
        reports += [_comparison(n, alpha, 1.0, kind) for n, kind in zip(numbers, STRATEGY_SETS)]
    reports += [_comparison(n, alpha, 1.0, "all_vs_personalized") for alpha, n in PERSONAL_FIGURES.items()]
    for (alpha, share), numbers in PARTIAL_FIGURES.items():
        reports += [_comparison(n, alpha, share, kind) for n, kind in zip(numbers, STRATEGY_SETS)]
    for attack, (short, numbers) in ATTACK_FIGURES.items():
        for alpha, number in numbers.items():
            reports.append(
                SeriesReport(
                    f"fig_{number}_attack_{short}_{_short(alpha)}_full",
                    {"attack_name": attack, **_part(alpha), "fraction-train": 1.0},
                    "strategy-name",
                    "backdoor" if attack == "backdoor" else "standard",
                    "no_attack",
                )
            )
    return reports


def attacker_reports() -> list[SeriesReport]:
    """Backdoor reports that tell runs with one and two attackers apart."""
    robust = ("FedAvg", "FedTrimmedAvg", "FedMedian", "MultiKrum")
    reports = []
    for alpha in (None, 0.1):
        tag = "IID" if alpha is None else "nonIID_a01"
        reports.append(
            SeriesReport(
                f"fig_attack_backdoor_{_short(alpha)}_2_malicious",
                {
                    "attack_name": "backdoor", **_part(alpha), "num_malicious_clients": 2,
                    "scenario_name": [f"Backdoor_Attack_{name}_{tag}" for name in robust],
                },
                "strategy-name", "backdoor", "no_attack_full",
            )
        )
    reports.append(
        SeriesReport(
            "fig_attack_backdoor_1_vs_2_clients",
            {
                "attack_name": "backdoor", **_part(0.1), "strategy-name": "FedAvg",
                "scenario_name": "Backdoor_Attack_FedAvg_nonIID_a01",
            },
            "num_malicious_clients", "backdoor", "none",
            {1: "1 Malicious Client", 2: "2 Malicious Clients"},
        )
    )
    return reports


def label_flip_reports() -> list[SeriesReport]:
    """Attacker counts times partitionings."""
    strategies = ["FedAvg", "FedMedian", "TrimmedAvg", "MultiKrum"]
    return [
        SeriesReport(
            f"fig_strategies_{'iid' if alpha is None else 'noniid_a' + str(alpha).replace('.', 'p')}_{k}_malicious",
            {**_part(alpha), "attack_name": "label_flipping", "num_malicious_clients": k, "strategy-name": strategies},
            "strategy-name", "standard", "no_attack_full",
        )
        for k in (1, 2, 3)
        for alpha in (None, 0.5, 0.1)
    ]


def overfit_scenarios() -> list[str]:
    """The personalised scenarios of the grid, whose training and validation losses are compared."""
    return [d["scenario_name"] for d in scenario_definitions() if d.get("personalization")]


def table_reports(target_round: int = TARGET_ROUND) -> list[TableReport]:
    """All tables. Their titles are output that readers compare by text."""
    at = f"at Round {target_round}"
    clean = {"personalization": False, "attack_name": "none"}
    tables: list[TableReport] = []

    def add(title: str, filters: dict[str, Any], kind: str = "default", index: str = "strategy-name") -> None:
        tables.append(TableReport(len(tables) + 1, title, filters, kind, index))

    for share in (1.0, 0.8, 0.7):
        participation = "Full Participation" if share == 1.0 else f"Partial Participation, fraction={share}"
        for alpha in (None, 0.5, 0.1, 0.03):
            where = "IID Scenarios (" if alpha is None else f"Non-IID Scenarios (α={alpha}, "
            add(f"Performance {at} in {where}{participation})", {**_part(alpha), "fraction-train": share, **clean})
    add(
        f"Performance of Federated Personalization (FedPer) {at}",
        {"personalization": True, "attack_name": "none"}, "personal", "scenario_name",
    )
    attacks = (
        ("Backdoor Attack", "backdoor", (1, 2), "backdoor"),
        ("Byzantine Attack", "byzantine", (None,), "default"),
        ("Label Flipping Attack", "label_flipping", (1, 2, 3), "default"),
    )
    for label, attack, counts, kind in attacks:
        for count in counts:
            for alpha in (None, 0.5, 0.1):
                where = "IID" if alpha is None else f"Non-IID α={alpha}"
                number = "" if count is None else f", {count} Malicious Client{'s' if count > 1 else ''}"
                chosen = {} if count is None else {"num_malicious_clients": count}
                add(f"Performance under {label} {at} ({where}{number})", {"attack_name": attack, **_part(alpha), **chosen}, kind)
    return tables
