"""Cleaning of run configurations and metric columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Report names of the strategies.
STRATEGY_NAMES = {
    "fedavgm": "FedAvgM",
    "fedadam": "FedAdam",
    "fedyogi": "FedYogi",
    "median": "FedMedian",
    "trimmed_avg": "TrimmedAvg",
    "multikrum": "MultiKrum",
}
IID_ALPHA = -1.0  # fixed value: alpha of runs without label skew


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_strategy(name: Column | str, mu: Column | str, relabel_clean: bool = False) -> Column:
    """Report name of a strategy; averaging and proximal runs differ only by mu.

    ``relabel_clean`` also re-reads names that already are report names, as the tables do.
    """
    name, mu = _col(name), _col(mu)
    proximal = name.isin("fedprox", "FedAvg", "FedProx") if relabel_clean else name == "fedprox"
    names = F.create_map(*[F.lit(v) for pair in STRATEGY_NAMES.items() for v in pair])
    return (
        F.when(proximal & (mu > 0), F.lit("FedProx"))
        .when(proximal & ((mu == 0) | mu.isNull()), F.lit("FedAvg"))
        .otherwise(F.coalesce(F.try_element_at(names, name), name))
    )


def number_or_null(value: Column | str) -> Column:
    """Text to double; text that is no number, and NaN, become null."""
    number = _col(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def count_or_zero(value: Column | str) -> Column:
    return F.coalesce(_col(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def text_or(value: Column | str, default: str) -> Column:
    """Text with null and '' read as ``default``."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit(default))


def alpha_or_marker(alpha: Column | str, partitioner: Column | str) -> Column:
    """Alpha; missing reads -1 for runs without label skew and null otherwise."""
    alpha = _col(alpha)
    return F.when(_col(partitioner) == "iid", F.coalesce(alpha, F.lit(IID_ALPHA))).otherwise(alpha)


def list_length(ids: Column | str) -> Column:
    """Length of a list; a missing list counts 0."""
    return F.coalesce(F.size(F.coalesce(_col(ids), F.array().cast("array<int>"))), F.lit(0))


def config_defaults(config: DataFrame) -> DataFrame:
    """Fills and types the configuration columns that reports rely on."""
    alpha = F.col("dirichlet_alpha").cast("double")
    return config.withColumns(
        {
            "attack_name": text_or("attack_name", "none"),
            "personalization": F.coalesce("personalization", F.lit(False)),
            "fraction_train": F.when(F.col("fraction_train").isNull(), F.lit(1.0)).otherwise(
                number_or_null("fraction_train")
            ),
            "dirichlet_alpha": alpha_or_marker(F.when(~F.isnan(alpha), alpha), "partitioner_name"),
            "strategy_name": F.coalesce("strategy_name", F.lit("unknown")),
            "proximal_mu": F.when(F.col("proximal_mu").isNull(), F.lit(0.0)).otherwise(number_or_null("proximal_mu")),
        }
    )


# Contract columns of a report frame with the value used when a log lacks them.
CONTRACT = {
    "personalization": ("boolean", False),
    "attack_name": ("string", "none"),
    "fraction_train": ("double", 1.0),
    "dirichlet_alpha": ("double", None),
    "proximal_mu": ("double", 0.0),
    "partitioner_name": ("string", "unknown"),
}


def with_contract(df: DataFrame, contract: Mapping[str, tuple] = CONTRACT) -> DataFrame:
    """Guarantees every contract column, typed and filled."""
    filled = {
        name: F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))
        if name in df.columns
        else F.lit(default).cast(kind)
        for name, (kind, default) in contract.items()
    }
    df = df.withColumns(filled)
    return df.withColumn("dirichlet_alpha", alpha_or_marker("dirichlet_alpha", "partitioner_name"))


def round_metrics(df: DataFrame) -> DataFrame:
    """Losses to 6 decimals, ratios to 4."""
    decimals = lambda c: 6 if c.endswith("loss") else 4
    named = [c for c in df.columns if c.endswith(("loss", "acc", "accuracy", "f1_score", "asr"))]
    return df.withColumns({c: F.round(c, decimals(c)) for c in named})
