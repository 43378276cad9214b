"""Seeded randomness that does not depend on how the input is partitioned.

Every draw is a function of (seed, tag, ids) only, so repartitioning, a lost
executor or a retried task gives the same rows back, which ``rand(seed)`` does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 32  # draws are the first 8 hex digits of an md5
DRAW_RANGE = float(2**DRAW_BITS)


def draw(seed: int | Column, tag: str, *ids: Column | str) -> Column:
    """Integer in [0, 2^32) for the row identified by ``ids``; the seed may be a column, one for each run.

    Never null, and marked so: a nullable key would make every join on it hash each row twice,
    once in the null filter Spark derives.
    """
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    start = [seed.cast("string"), F.lit(tag)] if isinstance(seed, Column) else [F.lit(f"{seed}:{tag}")]
    key = F.concat_ws(":", *start, *[p.cast("string") for p in parts])
    return F.coalesce(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def uniform(seed: int | Column, tag: str, *ids: Column | str) -> Column:
    """Double in [0, 1)."""
    return draw(seed, tag, *ids) / F.lit(DRAW_RANGE)


def pick(n: int, seed: int, tag: str, *ids: Column | str) -> Column:
    """Integer in [0, n), never null."""
    return F.coalesce(F.pmod(draw(seed, tag, *ids), F.lit(n)).cast("int"), F.lit(0))


def gaussian(seed: int, tag: str, *ids: Column | str) -> Column:
    """Standard normal by Box-Muller on two draws; the first is shifted off zero for the log."""
    u1 = (draw(seed, tag + "/r", *ids) + F.lit(1)) / F.lit(DRAW_RANGE)
    u2 = uniform(seed, tag + "/a", *ids)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
