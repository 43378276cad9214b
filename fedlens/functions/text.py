"""Report text: fixed-decimal numbers, mean and deviation cells, header names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_decimals(value: Column, decimals: int = 3) -> Column:
    """Fixed decimals without thousands separators, rounding the stored double."""
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals))


def mean_std_text(mean: Column, std: Column, decimals: int = 3) -> Column:
    """``mean ± std``; a missing mean reads ``N/A`` and a missing deviation reads zero."""
    text = F.concat(
        fixed_decimals(mean, decimals),
        F.lit(" ± "),
        fixed_decimals(F.coalesce(std, F.lit(0.0)), decimals),
    )
    return F.when(mean.isNull(), F.lit("N/A")).otherwise(text)


def title_words(name: Column) -> Column:
    """``strategy-name`` -> ``Strategy Name``."""
    return F.initcap(F.translate(name, "-_", "  "))


def clean_metric_name(name: Column, round_number: int) -> Column:
    """``round40_client_asr`` -> ``Client ASR``."""
    bare = F.regexp_replace(name, f"^round{round_number}_", "")
    return F.replace(title_words(bare), F.lit("Asr"), F.lit("ASR"))
