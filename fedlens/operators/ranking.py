"""Exact ranks by a uniform draw, without sending a whole group to one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.functions.hashing import DRAW_BITS
from fedlens.session import cut_lineage

DIGIT_BITS = 16


def rank_by_draw(
    df: DataFrame, draw_col: Column, id_col: str, group: Sequence[str] = (), bits: int = 14
) -> DataFrame:
    """Adds ``rank`` (1-based, by draw then id) and ``group_size`` to every row.

    The draw range is cut into 2^``bits`` buckets; because draws are uniform, a group that holds
    a third of all rows is still spread over that many sorts. Bucket counts are combined before
    the shuffle, and only the count table (groups x buckets rows) is summed up in order.
    """
    group = list(group)
    keys = [*group, "_bucket"]
    bucket = F.shiftright(draw_col, DRAW_BITS - bits).cast("int")
    rows = df.withColumn("_draw", draw_col).withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy("_draw", id_col))
    return (
        rows.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn("rank", F.col("_before") + F.col("_inside"))
        .select(*df.columns, "rank", "group_size")
    )


def ordered_key(value: Column) -> Column:
    """Bits of a double as a long whose unsigned order is that of the doubles; both zeros are one."""

    @F.arrow_udf("long")
    def key(x: pa.Array) -> pa.Array:
        bits = (x.to_numpy(zero_copy_only=False).astype(float) + 0.0).view(np.int64)
        return pa.array(np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))))

    return key(value.cast("double"))


def value_of_key(key: Column) -> Column:
    @F.arrow_udf("double")
    def value(x: pa.Array) -> pa.Array:
        bits = x.to_numpy(zero_copy_only=False)
        return pa.array(np.where(bits < 0, bits ^ np.int64(-(2**63)), ~bits).view(float))

    return value(key)


def values_at(
    df: DataFrame, value: str, wanted: Mapping[str, Callable[[Column], Column]], group: Sequence[str] = ()
) -> DataFrame:
    """The values at given ranks of every group, one column a rank, and the group's number of values ``k``.

    ``wanted`` gives each 1-based rank from ``k``. Values become ordered keys, read digit by digit from the top: a pass counts
    the next digit among the values that share the digits found so far, and the count tells which digit holds the rank.
    Counts are partial sums of at most 2^16 rows a group and rank, so no task sorts or holds the values of a group. Null
    and NaN values do not count.
    """
    spark, group = df.sparkSession, list(group)
    present = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    keyed = cut_lineage(spark, present.select(*group, ordered_key(F.col(value)).alias("_key")), "ordered-keys")
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("k"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("k")).cast("long").alias("left")) for name, rank in wanted.items()])
    state = sizes.select(*group, "k", F.inline(asked)).withColumn("prefix", F.lit(0).cast("long"))
    state = cut_lineage(spark, state, "rank-state")
    for read in range(0, 64, DIGIT_BITS):
        prefix = F.shiftrightunsigned("_key", 64 - read) if read else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("_key", 64 - read - DIGIT_BITS).bitwiseAND(F.lit(2**DIGIT_BITS - 1))
        digits = keyed.select(*group, prefix.alias("prefix"), digit.alias("digit")).groupBy(*group, "prefix", "digit").agg(F.count("*").alias("n"))
        matched = digits.join(state, [*group, "prefix"])
        until = F.sum("n").over(W.partitionBy(*group, "name").orderBy("digit"))
        found = matched.withColumn("until", until).where((F.col("until") >= F.col("left")) & (F.col("until") - F.col("n") < F.col("left")))
        longer = F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit")).alias("prefix")
        state = cut_lineage(
            spark, found.select(*group, "k", "name", (F.col("left") - F.col("until") + F.col("n")).alias("left"), longer), "rank-state"
        )
    values = state.withColumn("value", value_of_key(F.col("prefix")))
    return values.groupBy(*group, "k").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted])
