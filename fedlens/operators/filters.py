"""Declarative filter maps compiled to one SQL condition.

A report catalogue has about a hundred maps; as text each costs one parse, where building them
from column calls would cost a round trip to the JVM per operator.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_KEYS = ("fraction_train", "dirichlet_alpha", "proximal_mu", "num_malicious_clients")
BOOLEAN_KEYS = ("personalization",)
CONFIG = "config"
# Tolerances of the float comparison.
RTOL, ATOL = 1e-5, 1e-8


def column_name(key: str) -> str:
    return key.replace("-", "_")


def literal(value: Any) -> str:
    """A Python value as SQL text."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def close_to(name: str, value: float) -> str:
    """Tolerant equality; a NaN value matches missing entries."""
    if math.isnan(value):
        return f"{name} IS NULL"
    return f"coalesce(abs({name} - {literal(value)}) <= {literal(ATOL + RTOL * abs(value))}, false)"


def _filled(name: str, value: Any) -> Any:
    """What an empty filter value stands for in this column; None stands for a missing number."""
    if value is not None and value != "":
        return value
    if name in BOOLEAN_KEYS:
        return False
    return None if name in NUMERIC_KEYS else "none"


def _one_of(name: str, values: Iterable[Any]) -> str:
    wanted = [_filled(name, v) for v in values]
    present = [literal(v) for v in wanted if v is not None]
    match = f"coalesce({name} IN ({', '.join(present)}), false)" if present else "false"
    return f"({match} OR {name} IS NULL)" if len(present) < len(wanted) else match


def _equals(name: str, value: Any) -> str:
    value = _filled(name, value)
    if value is None:
        # only alpha can be asked for as missing; elsewhere a missing number equals nothing
        return f"{name} IS NULL" if name == "dirichlet_alpha" else "false"
    if isinstance(value, float) and name in NUMERIC_KEYS:
        return close_to(name, value)
    return f"coalesce({name} = {literal(value)}, false)"


def _of_map(key: str, value: Any) -> str:
    """A condition on an entry of the configuration map, which is text: typed by what is asked for."""
    entry = f"try_element_at({CONFIG}, {literal(key)})"
    if value is None or value == "":
        return f"coalesce({entry}, '') = ''"
    if isinstance(value, bool):
        return f"coalesce(try_cast({entry} AS BOOLEAN), false) = {literal(value)}"
    if isinstance(value, (int, float)):
        return close_to(f"try_cast({entry} AS DOUBLE)", float(value))
    return f"coalesce({entry} = {literal(value)}, false)"


def condition(filters: Mapping[str, Any], columns: Iterable[str], keys: Iterable[str] | None = None) -> str:
    """All conditions of the map joined by AND.

    A key is a typed column or, where the frame has the configuration map ``config``, an entry of that. ``keys`` are the
    entries that some log has, if known (``config_keys``): a key that is neither is skipped with a warning, as is one
    without a column where there is no map.
    """
    known, parts = set(columns), []
    entries = None if keys is None else set(keys)
    for key, value in filters.items():
        name, many = column_name(key), isinstance(value, (list, tuple))
        if name in known:
            parts.append(_one_of(name, value) if many else _equals(name, value))
        elif CONFIG in known and (entries is None or key in entries):
            parts.append("(" + " OR ".join(_of_map(key, v) for v in value) + ")" if many else _of_map(key, value))
        else:
            warnings.warn(f"filter key '{key}' is in no column and no log and is skipped", stacklevel=2)
    return " AND ".join(parts) or "true"


def config_keys(logs: DataFrame) -> list[str]:
    """Configuration keys that occur in any log; as many rows as there are different keys."""
    found = logs.select(F.explode(F.map_keys(CONFIG)).alias("key")).distinct()
    return sorted(r.key for r in found.collect())


def predicate(filters: Mapping[str, Any], columns: Iterable[str], keys: Iterable[str] | None = None) -> Column:
    return F.expr(condition(filters, columns, keys))
