"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the least node near it: larger neighbours only, or smaller ones only."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["w"])
    if large:
        found = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return found.where(F.col("u") != F.col("v")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, component``: the least node that each node of an edge can reach.

    Rounds of large and small stars, each written to the shared folder, until a round changes nothing; the number of rounds
    grows with the logarithm of the longest path. No node's neighbours are gathered in one place.
    """
    edges = stored(spark, edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    last = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        edges = stored(spark, _stars(_stars(edges, True), False), "edges")
    reached = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return reached.select(F.col("u").alias("node"), "component").union(roots)
