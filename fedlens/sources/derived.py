"""Federated-learning inputs derived from the driver tables (see FIXTURES.md, section 2).

Each frame is a lazy projection or a partially aggregated group-by of one driver table, so
its cost follows that table. ``derived_sql`` holds the same definitions for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.operators.cleaning import canonical_strategy
from fedlens.operators.fit import head_matrix, predict
from fedlens.operators.partition import assign_iid
from fedlens.session import cut_lineage
from fedlens.sources.tables import table

N_CLIENTS = 10
N_CLASSES = 10
N_DIMS = 64
SIDE = 8
HEAD_START = 48  # positions from here on form the private layer
SEED = 42
MALICIOUS = (3, 5, 7)
TARGET_CLASS = 1
TARGET_ROUND = 30  # the logs derived from events end at day 30


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").alias("features"),
        "label",
    )


def parts(spark: SparkSession, sf_dir: str, tag: str = "part") -> DataFrame:
    return assign_iid(samples(spark, sf_dir), N_CLIENTS, SEED, tag=tag)


def long_features(df: DataFrame, *keep: str) -> DataFrame:
    """One row per feature; values become doubles one by one, not by casting whole arrays."""
    return df.select(*keep, F.posexplode("features").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def head_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-mean head: one weight per class and position."""
    return (
        long_features(samples(spark, sf_dir), "label")
        .groupBy(F.col("label").alias("cls"), "pos")
        .agg(F.avg("x").alias("w"))
    )


def predictions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """``parts`` (or ``rows``) with class scores and the predicted label of the class-mean head."""
    rows = parts(spark, sf_dir) if rows is None else rows
    return predict(rows, head_matrix(head_long(spark, sf_dir)))


def layer_of(pos: Column) -> Column:
    return F.when(pos < HEAD_START, F.lit("body.weight")).otherwise(F.lit("fc2.weight"))


def client_params(spark: SparkSession, sf_dir: str, tag: str = "part", round_number: int = 1) -> DataFrame:
    """One vector per client: the mean features of its rows, weighted by their number."""
    return (
        long_features(parts(spark, sf_dir, tag), "client_id")
        .groupBy("client_id", "pos")
        .agg(F.avg("x").alias("v"), F.count("x").alias("n"))
        .select(F.lit(round_number).alias("round"), "client_id", layer_of(F.col("pos")).alias("layer"), "pos", "v", "n")
    )


def client_params_two_rounds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [client_params(spark, sf_dir, "part", 1), client_params(spark, sf_dir, "part2", 2)]


SUPPLY_MEASURES = ("l_quantity", "l_extendedprice / 1000", "l_discount * 100", "l_tax * 100")


def supplier_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client per supplier, so their number grows with the data: mean measures by line number as its vector."""
    means = [F.avg(F.expr(m)) for m in SUPPLY_MEASURES]
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.array(*means).alias("_v"), F.count("*").alias("n"))
    pos = ((F.col("l_linenumber") - 1) * len(means) + F.col("_i")).cast("int")
    return cells.select(F.col("l_suppkey").cast("int").alias("client_id"), "l_linenumber", "n", F.posexplode("_v").alias("_i", "v")).select(
        F.lit(1).alias("round"), "client_id", F.lit("body.weight").alias("layer"), pos.alias("pos"), "v", "n"
    )


def global_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        long_features(samples(spark, sf_dir))
        .groupBy("pos")
        .agg(F.avg("x").alias("v"))
        .select(layer_of(F.col("pos")).alias("layer"), "pos", "v")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client replies, one per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("round"),
        F.pmod("l_suppkey", F.lit(N_CLIENTS)).cast("int").alias("client_id"),
        F.col("l_quantity").cast("bigint").alias("num_examples"),
        (F.col("l_extendedprice") / 10000).alias("train_loss"),
        (F.col("l_extendedprice") / 20000).alias("eval_loss"),
        (1 - F.col("l_discount")).alias("eval_acc"),
        F.col("l_tax").alias("backdoor_asr"),
    )


def client_and_shared_heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A full head per client and the shared head, as (client_id,) cls, pos, w.

    A client's head has its own class means, and the shared ones for classes it lacks. Both come
    from one pass over the samples, whose sums (clients x classes x positions) are written once.
    """
    sums = cut_lineage(
        spark,
        long_features(parts(spark, sf_dir), "client_id", "label")
        .groupBy("client_id", F.col("label").alias("cls"), "pos")
        .agg(F.sum("x").alias("s"), F.count("x").alias("n")),
        "head-sums",
    )
    shared = sums.groupBy("cls", "pos").agg((F.sum("s") / F.sum("n")).alias("w"))
    clients = F.explode(F.sequence(F.lit(0), F.lit(N_CLIENTS - 1)))
    local = (
        shared.withColumn("client_id", clients)
        .join(sums, ["client_id", "cls", "pos"], "left")
        .select("client_id", "cls", "pos", F.coalesce(F.col("s") / F.col("n"), "w").alias("w"))
    )
    return local, shared


def saved_only(heads: DataFrame) -> DataFrame:
    """Heads of the clients that have trained before: ids below 7."""
    return heads.where("client_id < 7")


def _pick(index: Column, *values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def raw_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclean run configuration, one row per customer."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("run_id"),
        _pick(
            F.pmod(key, F.lit(8)),
            "fedprox", "fedavgm", "fedadam", "fedyogi", "median", "trimmed_avg", "multikrum", "other",
        ).alias("strategy_name"),
        _pick(F.pmod(key, F.lit(3)), "0.0", "0.01", "n/a").alias("proximal_mu"),
        _pick(F.pmod(key, F.lit(4)), None, "", "backdoor", "label_flipping").alias("attack_name"),
        _pick(F.pmod(key, F.lit(2)), "iid", "dirichlet").alias("partitioner_name"),
        _pick(F.pmod(key, F.lit(5)), None, 0.5, 0.1, 0.03, 0.0).alias("dirichlet_alpha"),
        _pick(F.pmod(key, F.lit(7)), None, "0.8", "0.7", "1.0", "bad", "1.0", "0.8").alias("fraction_train"),
        _pick(F.pmod(key, F.lit(6)), None, True, False, False, False, True).alias("personalization"),
        F.when(F.pmod(key, F.lit(3)) == 0, F.lit(None).cast("array<int>"))
        .when(F.pmod(key, F.lit(3)) == 1, F.array(F.lit(3), F.lit(5)))
        .otherwise(F.array().cast("array<int>"))
        .alias("malicious_clients_ids"),
        F.col("c_acctbal").cast("bigint").cast("string").alias("num_examples"),
    )


def run_configs(run: Column) -> list[Column]:
    """Configuration columns of the derived run logs, all functions of the run number."""
    strategy = F.pmod(run, F.lit(8))
    attacked = F.expr("pmod(run_no div 8, 2)") == 1
    backdoor = F.expr("pmod(run_no div 64, 2)") == 1
    iid = F.expr("pmod(run_no div 16, 2)") == 0
    full = F.expr("pmod(run_no div 32, 2)") == 0
    personal = F.expr("run_no >= 128")
    clean = _pick(strategy, "FedAvg", "FedProx", "FedAvgM", "FedAdam", "FedYogi", "FedMedian", "TrimmedAvg", "MultiKrum")
    scenario = F.concat(
        F.when(~attacked, F.lit("")).when(backdoor, F.lit("Backdoor_Attack_")).otherwise(F.lit("LabelFlip_Attack_")),
        F.when(attacked & (strategy == 6), F.lit("Fed")).otherwise(F.lit("")),
        clean,
        F.when(iid, F.lit("_IID")).when(attacked, F.lit("_nonIID_a01")).otherwise(F.lit("_nonIID_a0_1")),
        F.when(personal, F.lit("_personalized")).otherwise(F.lit("")),
        F.when(full, F.lit("")).otherwise(F.lit("_frac08")),
    )
    return [
        scenario.alias("scenario_name"),
        _pick(
            strategy, "fedprox", "fedprox", "fedavgm", "fedadam", "fedyogi", "median", "trimmed_avg", "multikrum"
        ).alias("strategy_name"),
        F.when(strategy == 1, F.lit(0.01)).otherwise(F.lit(0.0)).alias("proximal_mu"),
        F.when(~attacked, F.lit("none"))
        .when(backdoor, F.lit("backdoor"))
        .otherwise(F.lit("label_flipping"))
        .alias("attack_name"),
        F.when(iid, F.lit("iid")).otherwise(F.lit("dirichlet")).alias("partitioner_name"),
        F.when(iid, F.lit(-1.0)).otherwise(F.lit(0.1)).alias("dirichlet_alpha"),
        F.when(full, F.lit(1.0)).otherwise(F.lit(0.8)).alias("fraction_train"),
        personal.alias("personalization"),
        F.when(attacked, F.expr("1 + pmod(run_no, 3)")).otherwise(F.lit(0)).cast("int").alias("num_malicious_clients"),
    ]


CONFIG_COLUMNS = (
    "scenario_name", "strategy_name", "proximal_mu", "attack_name", "partitioner_name",
    "dirichlet_alpha", "fraction_train", "personalization", "num_malicious_clients",
)
METRIC_COLUMNS = (
    "training_loss", "training_num_examples",
    "client_evaluation_loss", "client_evaluation_accuracy", "client_evaluation_f1_score",
    "client_evaluation_backdoor_asr", "client_evaluation_num_examples",
    "server_evaluation_loss", "server_evaluation_accuracy", "server_evaluation_f1_score",
    "server_evaluation_num_examples",
)


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat run log with the names as written by a run: one row per (run, round)."""
    value, kind = F.col("value"), F.col("event_type")
    server = lambda c: F.when(F.col("run_no") < 128, c)  # personalised runs have no server side
    cells = (
        table(spark, sf_dir, "events")
        .groupBy(F.pmod("user_id", F.lit(150)).alias("run_no"), F.dayofmonth("ts").alias("round"))
        .agg(
            F.avg(value).alias("avg_value"),
            F.max(value).alias("max_value"),
            F.avg(F.when(kind == "click", F.lit(1.0)).otherwise(F.lit(0.0))).alias("click_share"),
            F.count("*").alias("n"),
        )
    )
    mean = F.col("avg_value")
    return cells.select(
        F.concat(F.lit("run_"), F.col("run_no").cast("string")).alias("run_id"),
        *run_configs(F.col("run_no")),
        "round",
        (F.col("max_value") / 127).alias("training_loss"),
        (F.col("n") * 4).alias("training_num_examples"),
        (mean / 101).alias("client_evaluation_loss"),
        (mean / 503).alias("client_evaluation_accuracy"),
        (mean / 557).alias("client_evaluation_f1_score"),
        F.col("click_share").alias("client_evaluation_backdoor_asr"),
        F.col("n").alias("client_evaluation_num_examples"),
        server(mean / 97).alias("server_evaluation_loss"),
        server(mean / 509).alias("server_evaluation_accuracy"),
        server(mean / 563).alias("server_evaluation_f1_score"),
        server(F.col("n") * 2).alias("server_evaluation_num_examples"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat run log with report names of the strategies."""
    return raw_metrics(spark, sf_dir).withColumn("strategy_name", canonical_strategy("strategy_name", "proximal_mu"))
