"""Run logs: nested JSON documents, one per run, with one entry per round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedlens.operators import cleaning as K
from fedlens.operators.filters import column_name

CORRUPT = "_corrupt"

# The metric groups of a round.
METRIC_GROUPS = {
    "training": ("loss", "num_examples"),
    "client_evaluation": ("loss", "accuracy", "f1_score", "backdoor_asr", "num_examples"),
    "server_evaluation": ("loss", "accuracy", "f1_score", "num_examples"),
}


def _texts(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Scalars are read as text and typed afterwards, so one badly typed value costs that value
# and not its whole document. The configuration is a map, so no key is lost.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "rounds",
            T.ArrayType(
                T.StructType(
                    [T.StructField("round", T.IntegerType()), T.StructField("timestamp", T.StringType())]
                    + [T.StructField(group, _texts(names)) for group, names in METRIC_GROUPS.items()]
                )
            ),
        ),
        T.StructField(CORRUPT, T.StringType()),
    ]
)


def read_logs(spark: SparkSession, folder: str, glob: str = "results.json") -> DataFrame:
    """All logs below ``folder``; the run id is the name of the directory that holds the file."""
    docs = (
        spark.read.schema(LOG_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(folder)
    )
    path = F.col("_metadata.file_path")
    return docs.select(
        F.regexp_extract(path, r"(?:run_id=)?([^/=]+)/[^/]+$", 1).alias("run_id"),
        path.alias("file_path"),
        "config",
        "rounds",
        F.col(CORRUPT).isNotNull().alias("corrupt"),
    )


def log_state(logs: DataFrame) -> DataFrame:
    """Adds ``reason``: null for a usable log, else why it is left out.

    A run id belongs to the first file in path order that is unreadable or names a scenario;
    later files of the id are duplicates. The first path is found with a partial minimum, so
    thousands of copies of one run never meet in a task.
    """
    claims = F.col("corrupt") | F.col("config.scenario_name").isNotNull()
    first = logs.where(claims).groupBy("run_id").agg(F.min("file_path").alias("_first"))
    reason = (
        F.when(claims & (F.col("file_path") != F.col("_first")), F.lit("duplicate"))
        .when(F.col("corrupt"), F.lit("corrupt"))
        .when(F.col("config.scenario_name").isNull(), F.lit("no scenario"))
        .when(F.coalesce(F.size("rounds"), F.lit(0)) <= 0, F.lit("no rounds"))
    )
    return logs.join(first, "run_id", "left").withColumn("reason", reason).drop("_first")


def usable_logs(logs: DataFrame) -> DataFrame:
    """The logs without a ``reason``, found in a single pass over the files."""
    claims = F.col("corrupt") | F.col("config.scenario_name").isNotNull()
    doc = F.struct("file_path", "config", "rounds", "corrupt")
    first = logs.where(claims).groupBy("run_id").agg(F.min_by(doc, "file_path").alias("_d"))
    return first.select("run_id", "_d.*").where("NOT corrupt AND size(rounds) > 0").drop("corrupt")


def rejected_logs(logs: DataFrame) -> DataFrame:
    return log_state(logs).where("reason IS NOT NULL").select("run_id", "file_path", "reason")


def flatten(logs: DataFrame, extra_keys: Sequence[str] = (), with_config: bool = False) -> DataFrame:
    """One row per (run, round): typed configuration and metric columns, missing metrics null.

    ``extra_keys`` are further configuration keys to carry as text columns; ``with_config`` keeps the whole configuration
    map beside the typed columns, so that filters can ask for any key.
    """
    entry = lambda *path: F.col("_r." + ".".join(path))
    metrics = [
        (K.count_or_zero(entry(group, name)) if name == "num_examples" else K.number_or_null(entry(group, name)))
        .alias(f"{group}_{name}")
        for group, names in METRIC_GROUPS.items()
        for name in names
    ]
    key = lambda name: F.col(f"config.`{name}`")
    config = [
        key("scenario_name").alias("scenario_name"),
        key("strategy-name").alias("strategy_name"),
        key("proximal-mu").alias("proximal_mu"),
        key("attack_name").alias("attack_name"),
        F.coalesce(key("partitioner-name"), F.lit("none")).alias("partitioner_name"),
        K.number_or_null(key("dirichlet-alpha")).alias("dirichlet_alpha"),
        key("fraction-train").alias("fraction_train"),
        key("personalization").try_cast("boolean").alias("personalization"),
        K.list_length(F.from_json(key("malicious-clients-ids"), "array<int>")).alias("num_malicious_clients"),
        *(key(name).alias(column_name(name)) for name in extra_keys),
    ]
    rows = logs.select("run_id", "config", F.explode("rounds").alias("_r")).where("_r.round IS NOT NULL")
    whole = ["config"] if with_config else []
    return K.config_defaults(rows.select("run_id", *config, entry("round").alias("round"), *metrics, *whole))


def load_metrics(
    spark: SparkSession, folder: str, glob: str = "results.json", extra_keys: Sequence[str] = (), with_config: bool = False
) -> DataFrame:
    """Clean flat metrics of every usable log, strategies under their report names."""
    flat = flatten(usable_logs(read_logs(spark, folder, glob)), extra_keys, with_config)
    return flat.withColumn("strategy_name", K.canonical_strategy("strategy_name", "proximal_mu"))


# --- building and writing logs --------------------------------------------------------------

def log_documents(flat: DataFrame) -> DataFrame:
    """Flat rows -> one nested document per run (rounds are bounded by the planned number).

    Attacker ids come from ``malicious_clients_ids`` where the frame has them; a frame that only
    counts attackers gets the numbers from 1 on, as many as it counts.
    """
    group = lambda g: F.struct(*[F.col(f"{g}_{n}").cast("string").alias(n) for n in METRIC_GROUPS[g]]).alias(g)
    entry = F.struct("round", F.lit(None).cast("string").alias("timestamp"), *[group(g) for g in METRIC_GROUPS])
    counted = F.coalesce(F.col("num_malicious_clients"), F.lit(0)).cast("int")
    ids = F.when(counted > 0, F.sequence(F.lit(1), counted)).otherwise(F.array().cast("array<int>"))
    if "malicious_clients_ids" in flat.columns:
        ids = F.coalesce("malicious_clients_ids", ids)
    ids = F.array_join(ids.cast("array<string>"), ",")
    config = F.struct(
        "scenario_name",
        F.col("strategy_name").alias("strategy-name"),
        F.col("proximal_mu").cast("string").alias("proximal-mu"),
        "attack_name",
        F.col("partitioner_name").alias("partitioner-name"),
        F.col("dirichlet_alpha").cast("string").alias("dirichlet-alpha"),
        F.col("fraction_train").cast("string").alias("fraction-train"),
        F.col("personalization").cast("string").alias("personalization"),
        F.concat(F.lit("["), ids, F.lit("]")).alias("malicious-clients-ids"),
        F.lit(None).cast("string").alias("seed"),
    ).alias("config")
    return flat.groupBy("run_id", config).agg(F.array_sort(F.collect_list(entry)).alias("rounds"))


def write_documents(docs: DataFrame, folder: str) -> None:
    """Text documents (column ``value``) into one directory per run id.

    A file per run is mostly file handling, so the documents are spread over all cores; a stated
    number of partitions is not folded together for being small in bytes.
    """
    keys = [c for c in docs.columns if c != "value"]
    spread = docs.repartition(docs.sparkSession.sparkContext.defaultParallelism, *keys)
    spread.write.partitionBy(*keys).text(folder)


# --- growing a log --------------------------------------------------------------------------

def upsert_rounds(arrivals: DataFrame, order: Column) -> DataFrame:
    """Latest entry of every (run, round); a re-sent round replaces the earlier one.

    A partial maximum keeps one candidate per task, so a round re-sent many times stays cheap.
    """
    values = F.struct(*[c for c in arrivals.columns if c not in ("run_id", "round")])
    latest = arrivals.groupBy("run_id", "round").agg(F.max_by(values, order).alias("_latest"))
    return latest.select("run_id", "round", "_latest.*")


SUMMARY_METRICS = {
    "client_accuracy": "client_evaluation_accuracy",
    "server_accuracy": "server_evaluation_accuracy",
    "client_f1_score": "client_evaluation_f1_score",
    "server_f1_score": "server_evaluation_f1_score",
}


def run_summary(flat: DataFrame) -> DataFrame:
    """Best and last value of each run's metrics; a missing metric counts 0."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    best = [F.max(value(c)).alias(f"best_{name}") for name, c in SUMMARY_METRICS.items()]
    final = {**SUMMARY_METRICS, "client_asr": "client_evaluation_backdoor_asr"}
    last = [F.max_by(value(c), F.col("round")).alias(f"final_{name}") for name, c in final.items()]
    return flat.groupBy("run_id").agg(F.count("*").alias("total_rounds_completed"), *best, *last)
