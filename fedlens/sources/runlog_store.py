"""Run-log documents that grow: rounds are merged into nested documents, version by version.

Documents lie in buckets of run ids. A merge rewrites only the buckets that new rounds touch, below a new version, and
then writes that version's manifest, one small file that names the version of every bucket. A reader takes the newest
manifest, so it sees whole versions only; a merge that broke off has no manifest and is written over by the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.sources.runlog import METRIC_GROUPS, SUMMARY_METRICS

BUCKETS = 64
MANIFEST = "bucket int, held_in int"


def bucket_of(run_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run_id.cast("string")), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """Newest version and the version that holds each bucket; version 0 is the empty store."""
    try:
        rows = spark.read.schema(MANIFEST + ", version int").parquet(f"{folder}/manifest")
    except AnalysisException:
        return 0, {}
    newest = rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).collect()  # a row a bucket
    return (newest[0].version, {r.bucket: r.held_in for r in newest}) if newest else (0, {})


def _documents(spark: SparkSession, folder: str, held: dict[int, int]) -> DataFrame | None:
    if not held:
        return None
    paths = [f"{folder}/documents/version={version}/bucket={bucket}" for bucket, version in sorted(held.items())]
    return spark.read.parquet(*paths).select("run_id", "config", "rounds", "summary")


def read_documents(spark: SparkSession, folder: str) -> DataFrame | None:
    """All documents of the newest version: run_id, config, rounds in order, summary; None for an empty store."""
    return _documents(spark, folder, manifest(spark, folder)[1])


def summary_of(rounds: Column) -> Column:
    """Best and last values of a document's rounds; a missing metric counts 0."""
    groups = {f"{g}_{n}": (g, n) for g, names in METRIC_GROUPS.items() for n in names}

    def values(column: str) -> Column:
        group, name = groups[column]
        return F.transform(rounds, lambda r: F.coalesce(r[group][name].try_cast("double"), F.lit(0.0)))

    final = {**SUMMARY_METRICS, "client_asr": "client_evaluation_backdoor_asr"}
    return F.struct(
        F.size(rounds).alias("total_rounds_completed"),
        *[F.array_max(values(c)).alias(f"best_{name}") for name, c in SUMMARY_METRICS.items()],
        *[F.element_at(values(c), -1).alias(f"final_{name}") for name, c in final.items()],
    )


def merge_documents(spark: SparkSession, folder: str, arrivals: DataFrame, buckets: int = BUCKETS) -> int:
    """Merges documents (run_id, config, rounds) into the store and returns the new version.

    A round that is there already is replaced, the array stays sorted by round, the summary is made anew, and the newer
    configuration counts. ``arrivals`` have one document a run, each round once (``upsert_rounds`` sees to it). Merges are
    made one after another, by one writer.
    """
    version, held = manifest(spark, folder)
    new = arrivals.select(
        "run_id", F.col("config").alias("_config"), F.col("rounds").alias("_rounds"), bucket_of(F.col("run_id"), buckets).alias("bucket")
    )
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    if not touched:
        return version
    old = _documents(spark, folder, {b: v for b, v in held.items() if b in set(touched)})
    if old is None:
        whole = new.select("run_id", F.col("_config").alias("config"), F.col("_rounds").alias("rounds"), "bucket")
    else:
        sent = F.transform("_rounds", lambda r: r["round"])
        kept = F.filter("rounds", lambda r: ~F.array_contains(sent, r["round"]))
        both = old.join(new, "run_id", "full_outer")
        rounds = F.when(F.col("_rounds").isNull(), F.col("rounds")).when(F.col("rounds").isNull(), F.col("_rounds"))
        whole = both.select(
            "run_id", F.coalesce("_config", "config").alias("config"),
            rounds.otherwise(F.concat(kept, "_rounds")).alias("rounds"),
            bucket_of(F.col("run_id"), buckets).alias("bucket"),
        )
    by_round = lambda a, b: F.when(a["round"] < b["round"], -1).when(a["round"] > b["round"], 1).otherwise(0)
    whole = whole.withColumn("rounds", F.array_sort("rounds", by_round)).withColumn("summary", summary_of(F.col("rounds")))
    version += 1
    target = f"{folder}/documents/version={version}"
    whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    now = sorted((held | dict.fromkeys(touched, version)).items())
    spark.createDataFrame(now, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    return version
