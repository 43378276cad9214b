"""Federated rounds end to end: choose, fit, combine, evaluate, log.

Any number of runs goes through one plan: a client of a run is a slot, and one loop step fits the slots of all runs,
combines every run by its own rule, and evaluates all of them. The driver holds the round number and the configurations.
Models, private heads, replies and confusion cells of a round are tables in a folder ``round=r`` of the ledger, written
over if the round is repeated and closed by a marker, so a broken-off job goes on after its last closed round and a
repeated one changes nothing. A lost executor costs a re-read, and a round's plan does not grow with the rounds before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.functions.hashing import gaussian
from fedlens.operators import fit as M
from fedlens.operators import metrics as Q
from fedlens.operators.cleaning import round_metrics
from fedlens.operators.combine import shared_body
from fedlens.operators.partition import assign_dirichlet, assign_iid, dirichlet_table, sample_clients, split_train_val
from fedlens.operators.poison import byzantine_updates, is_malicious, stamp_trigger
from fedlens.plans.strategies import model_of, rule_for
from fedlens.plans.transforms import AttackOnly
from fedlens.session import cut_lineage, workspace

INIT_STD = 0.01
CELL_SCHEMA = "side string, client_id int, actual int, predicted int, n bigint, loss double"
REPLY_SCHEMA = "run int, client_id int, train_loss double, num_examples bigint"
PRIVATE_SCHEMA = "client_id int, head array<array<double>>"
CLOSED_SCHEMA = "closed int, configs string"


@dataclass(frozen=True)
class Shape:
    """Model shape: classes x (features + bias); positions from ``head_start`` on are private."""

    n_classes: int
    n_features: int
    head_start: int
    width: int  # side of the picture

    @property
    def row(self) -> int:
        return self.n_features + 1

    @property
    def n_params(self) -> int:
        return self.n_classes * self.row

    def layer(self, column: Column) -> Column:
        return F.when(column < self.head_start, F.lit("body.weight")).otherwise(F.lit("fc2.weight"))


def initial_model(spark, shape: Shape, seed: int) -> DataFrame:
    """Small seeded weights, one row per parameter."""
    pos = F.col("id").cast("int")
    return spark.range(shape.n_params).select(
        shape.layer(pos % shape.row).alias("layer"),
        pos.alias("pos"),
        (F.lit(INIT_STD) * gaussian(seed, "init", pos)).alias("v"),
    )


def head_cells(model: DataFrame, shape: Shape, *keys: str) -> DataFrame:
    """Parameter rows -> (keys, cls, pos, w)."""
    cls, pos = F.expr(f"pos div {shape.row}").alias("cls"), (F.col("pos") % shape.row).alias("pos")
    return model.select(*keys, cls, pos, F.col("v").alias("w"))


def with_bias(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", F.concat("features", F.array(F.lit(1.0))))


def score_cells(rows: DataFrame, heads: np.ndarray | DataFrame) -> DataFrame:
    """Confusion cells with summed loss of every side and client, from one scoring pass."""
    scored = M.predict_personal(rows, heads) if isinstance(heads, DataFrame) else M.predict(rows, heads)
    return scored.groupBy("side", "client_id", F.col("label").alias("actual"), "predicted").agg(
        F.count("*").alias("n"), F.sum("loss").alias("loss")
    )


def round_log(
    cells: DataFrame, replies: DataFrame, targets: Mapping[int, int], n_classes: int, keys: Sequence[str] = ("run", "round")
) -> DataFrame:
    """Flat log of all rounds from their confusion cells and training replies; ``targets`` has each run's attack target.

    Sides are ``client`` (validation rows), ``server`` (central test rows) and ``trigger``
    (stamped validation rows). Client values are weighted by all examples of the client.
    """
    n, keys = F.col("n"), list(keys)
    target = F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("run"))
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), n).otherwise(0))
    other = F.sum(F.when(F.col("actual") != target, n).otherwise(0))
    fooled = F.sum(F.when((F.col("actual") != target) & (F.col("predicted") == target), n).otherwise(0))
    per_client = cells.groupBy(*keys, "side", "client_id").agg(
        (F.sum("loss") / F.sum(n)).alias("eval_loss"),
        (hits / F.sum(n)).alias("eval_acc"),
        F.coalesce(F.try_divide(fooled, other), F.lit(0.0)).alias("backdoor_asr"),
        F.sum(n).alias("num_examples"),
    )
    sides = Q.aggregate_eval(per_client, [*keys, "side"])
    sides = sides.join(Q.macro_f1(cells, [*keys, "side"], n_classes), [*keys, "side"])
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    evaluated = sides.groupBy(*keys).agg(
        of("client", "eval_loss").alias("client_evaluation_loss"),
        of("client", "eval_acc").alias("client_evaluation_accuracy"),
        of("client", "macro_f1").alias("client_evaluation_f1_score"),
        F.when(F.bool_or(F.col("side") == "client"), F.coalesce(of("trigger", "backdoor_asr"), F.lit(0.0))).alias(
            "client_evaluation_backdoor_asr"
        ),
        of("client", "num_examples").alias("client_evaluation_num_examples"),
        of("server", "eval_loss").alias("server_evaluation_loss"),
        of("server", "eval_acc").alias("server_evaluation_accuracy"),
        of("server", "macro_f1").alias("server_evaluation_f1_score"),
        of("server", "num_examples").alias("server_evaluation_num_examples"),
    )
    trained = Q.aggregate_train(replies, keys).select(
        *keys, F.col("train_loss").alias("training_loss"), F.col("num_examples").alias("training_num_examples")
    )
    return round_metrics(evaluated.join(trained, keys, "left"))


def members(dataset: DataFrame, configs: Sequence[Mapping[str, Any]], n_classes: int) -> DataFrame:
    """The rows of every run with ``run``, ``client_id`` and ``split``, as each configuration deals them.

    A projection a run (two where labels are skewed: an interval lookup), without a shuffle of the rows. Rows whose label has
    no shares belong to no client; ``partition.dirichlet_rejects`` has them.
    """
    found = []
    for run, config in enumerate(configs):
        nodes, seed = config["total-nodes"], config.get("seed", 42)
        if config.get("partitioner-name", "iid") == "dirichlet":
            shares = dirichlet_table(dataset.sparkSession, n_classes, nodes, config["dirichlet-alpha"], seed)
            dealt = assign_dirichlet(dataset, shares, seed)
        else:
            dealt = assign_iid(dataset, nodes, seed)
        found.append(split_train_val(dealt, config.get("val-split-percentage", 0.2)).withColumn("run", F.lit(run)))
    return reduce(DataFrame.unionByName, found)


class Ledger:
    """Tables of closed rounds. A round counts once its marker is there; until then it is written over."""

    def __init__(self, spark: SparkSession, folder: str, configs: Sequence[Mapping[str, Any]]):
        self.spark, self.folder, self.configs = spark, folder, repr([sorted(c.items()) for c in configs])

    def path(self, r: int, name: str) -> str:
        return f"{self.folder}/round={r}/{name}"

    def write(self, df: DataFrame, r: int, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(r, name))
        return self.spark.read.schema(df.schema).parquet(self.path(r, name))

    def read(self, r: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(r, name))

    def close(self, r: int) -> None:
        self.write(self.spark.createDataFrame([(r, self.configs)], CLOSED_SCHEMA), r, "closed")

    def is_closed(self, r: int) -> bool:
        try:
            marker = self.read(r, "closed").head()
        except AnalysisException:
            return False
        if marker and marker.configs != self.configs:
            raise ValueError(f"{self.folder} holds rounds of other configurations")
        return marker is not None

    def all_rounds(self, name: str, schema: str, rounds: Sequence[int]) -> DataFrame:
        read = self.spark.read.schema(schema)
        return reduce(DataFrame.unionByName, [read.parquet(self.path(r, name)).withColumn("round", F.lit(r)) for r in rounds])


def run_rounds(
    samples: DataFrame,
    test: DataFrame,
    config: Mapping[str, Any],
    shape: Shape,
    rounds: int | None = None,
    fit: Callable[..., DataFrame] = M.fit_units,
    evaluate: Callable[[DataFrame, Any], DataFrame] = score_cells,
    transform: Any = None,
    folder: str | None = None,
) -> DataFrame:
    """Runs the rounds of one configuration and returns its log, one row per round.

    ``samples`` carry client_id and split; ``test`` is the central test set. The other arguments are those of ``run_many``.
    """
    own = samples.withColumn("run", F.lit(0))
    return run_many(own, test, [config], shape, rounds, fit, evaluate, transform, folder).drop("run")


def run_many(
    samples: DataFrame,
    test: DataFrame,
    configs: Sequence[Mapping[str, Any]],
    shape: Shape,
    rounds: int | None = None,
    fit: Callable[..., DataFrame] = M.fit_units,
    evaluate: Callable[[DataFrame, Any], DataFrame] = score_cells,
    transform: Any = None,
    folder: str | None = None,
) -> DataFrame:
    """Runs the rounds of all ``configs`` in step and returns one row per run and round.

    ``samples`` carry run (place in ``configs``), client_id and split, as ``members`` makes them. ``fit`` trains the clients
    (signature and result of ``fit_units``) and ``evaluate`` turns rows and a head into confusion cells (as
    ``score_cells``); both can be replaced. ``transform`` is an object of ``plans.transforms``: what is done to rows before
    they are trained on (attacks included) or scored, drawn anew in every round. ``folder`` is the ledger: with one that holds closed rounds of
    the same configurations, only the others are run. Runs that fit alike share one fit. A plan grows with the number of
    runs, so long manifests go through in portions.
    """
    spark, transform = samples.sparkSession, transform or AttackOnly(shape.width)
    if rounds is None:
        wanted = {c["num-server-rounds"] for c in configs}
        if len(wanted) > 1:
            raise ValueError("runs that go together have the same number of rounds")
        rounds = wanted.pop()
    runs = range(len(configs))
    stride = max(c["total-nodes"] for c in configs) + 1  # the last slot of a run is its server
    slot = (F.col("run") * F.lit(stride) + F.col("client_id")).cast("int")
    run_of = F.floor(F.col("client_id") / F.lit(stride)).cast("int")
    seeds = [c.get("seed", 42) for c in configs]
    personal = [bool(c.get("personalization")) for c in configs]
    byzantine = [list(c.get("malicious-clients-ids") or []) if c.get("attack_name") == "byzantine" else [] for c in configs]
    rules = [rule_for(c) for c in configs]
    ledger = Ledger(spark, folder or workspace(spark, "rounds"), configs)
    alone = len(configs) == 1 and not personal[0]  # one shared head goes to the tasks as a matrix
    joined = lambda parts: reduce(DataFrame.unionByName, parts)
    of_run = lambda df, run: df.where(F.col("run") == run) if len(configs) > 1 else df

    def train_rows(r: int) -> DataFrame:
        """Training rows of the clients drawn for round ``r``, attacked anew in every round, with slots as clients."""
        found = []
        for run, config in enumerate(configs):
            rows = of_run(samples, run).where("split = 'train'")
            rows = taking_part(rows, run, config["fraction-train"], r, 0)
            found.append(with_bias(transform.train(rows, config, r)))
        return joined(found)

    def judged_rows(r: int) -> DataFrame:
        found = []
        for run, config in enumerate(configs):
            if r:
                rows = taking_part(of_run(samples, run).where("split = 'val'"), run, config["fraction-evaluate"], r, 1)
                plain = rows.drop("split").withColumn("side", F.lit("client"))
                found.append(with_bias(transform.judge(plain)))
                if "backdoor" in (config.get("attack_name") or ""):
                    stamped = plain.withColumn("features", stamp_trigger(F.col("features"), shape.width))
                    found.append(with_bias(transform.judge(stamped)).withColumn("side", F.lit("trigger")))
            if not personal[run]:
                server = {"run": F.lit(run), "client_id": F.lit(stride - 1), "side": F.lit("server")}
                found.append(with_bias(transform.judge(test)).withColumns(server))
        columns = ["run", "client_id", "sample_id", "features", "label", "side"]
        return joined([df.select(*columns) for df in found]).withColumn("client_id", slot) if found else None

    def taking_part(rows: DataFrame, run: int, fraction: float, r: int, salt: int) -> DataFrame:
        """Rows of the clients drawn for round ``r``; with full participation nothing is drawn."""
        if fraction >= 1.0:
            return rows
        own = of_run(clients, run).select("client_id").withColumn("round", F.lit(r))
        drawn = sample_clients(own, fraction, configs[run]["total-nodes"], seeds[run] + salt)
        return rows.join(drawn.select("client_id"), "client_id", "left_semi")

    def heads(current: DataFrame, private: DataFrame | None, r: int) -> np.ndarray | DataFrame:
        """The shared head, or one per slot: its run's shared body beside its own (or the first) private layer."""
        if alone:
            return M.head_matrix(head_cells(model_of(current), shape))
        whole = model_of(current, "run").unionByName(unshared)
        shared = M.head_from_long(head_cells(whole, shape, "run"), ["run"])
        slots = clients.unionByName(spark.createDataFrame([(run, stride - 1) for run in runs], "run int, client_id int"))
        each = slots.join(shared, "run").select(slot.alias("client_id"), "head")
        if private is not None:
            cut = shape.head_start
            body_then_own = F.zip_with(
                "head", "_own", lambda w, own: F.concat(F.slice(w, 1, cut), F.slice(own, cut + 1, shape.row - cut))
            )
            each = each.join(private.withColumnRenamed("head", "_own"), "client_id", "left").select(
                "client_id", F.when(F.col("_own").isNull(), F.col("head")).otherwise(body_then_own).alias("head")
            )
        return ledger.write(each, r, "heads")

    clients = cut_lineage(spark, samples.select("run", "client_id").distinct(), "clients")
    first = cut_lineage(
        spark, joined([initial_model(spark, shape, seeds[run]).withColumn("run", F.lit(run)) for run in runs]), "model"
    )
    own_private = [run for run in runs if personal[run]]
    unshared = first.where("layer LIKE 'fc2.%'").where(F.col("run").isin(own_private)).select("run", "layer", "pos", "v")
    body = lambda df, run: shared_body(df) if personal[run] else df
    moments = sorted({m for rule in rules for m in rule.moments})

    def even(state: DataFrame, run: int) -> DataFrame:
        """States of all runs have the same columns."""
        more = {m: F.lit(None).cast("double") for m in moments if m not in state.columns}
        return state.withColumns({"run": F.lit(run), **more}).select("run", "layer", "pos", "x", *moments)

    if not ledger.is_closed(0):
        start = [even(rules[run].start(body(of_run(first, run), run)), run) for run in runs]
        state = ledger.write(joined(start), 0, "state")
        rows = judged_rows(0)
        if rows is not None:
            ledger.write(evaluate(rows, heads(state, None, 0)), 0, "cells")
        else:
            ledger.write(spark.createDataFrame([], CELL_SCHEMA), 0, "cells")
        ledger.close(0)

    for r in range(1, rounds + 1):
        if ledger.is_closed(r):
            continue
        state = ledger.read(r - 1, "state")
        private = ledger.read(r - 1, "private") if own_private and r > 1 else None
        now = heads(state, private, r)
        rows = train_rows(r)
        honest = joined([of_run(rows, run).where(~is_malicious(byzantine[run])) for run in runs]) if any(byzantine) else rows
        fitted = ledger.write(joined(_fits(fit, honest, now, configs, runs, r, slot)), r, "fitted")
        weights, replies = M.merge_units(fitted)
        client = F.pmod("client_id", F.lit(stride)).alias("client_id")
        updates = weights.select(
            F.lit(r).alias("round"), run_of.alias("run"), client, shape.layer(F.col("pos")).alias("layer"),
            (F.col("cls") * shape.row + F.col("pos")).alias("pos"), F.col("w").alias("v"), "n",
        )
        replies = replies.select(run_of.alias("run"), client, "train_loss", "num_examples")
        for run in runs:
            if byzantine[run]:
                # they skip training, answer with noise, and report loss 0 with their full weight
                bad = byzantine[run]
                absent = of_run(rows, run).where(is_malicious(bad)).groupBy("client_id").agg(F.count("*").alias("n"))
                ids, model = F.explode(F.array(*[F.lit(i) for i in bad])), model_of(of_run(state, run))
                idle = model.withColumn("client_id", ids).join(absent, "client_id").withColumns({"round": F.lit(r), "run": F.lit(run)})
                updates = updates.unionByName(byzantine_updates(idle, model, bad, seeds[run]).select(*updates.columns))
                silent = absent.select(
                    F.lit(run).alias("run"), "client_id", F.lit(0.0).alias("train_loss"), F.col("n").alias("num_examples")
                )
                replies = replies.unionByName(silent)
        if own_private:
            mine = updates.where(F.col("run").isin(own_private)).withColumn("client_id", slot)
            fresh = M.head_from_long(head_cells(mine, shape, "client_id"), ["client_id"])
            kept = fresh if private is None else fresh.unionByName(private.join(fresh, "client_id", "left_anti"))
            private = ledger.write(kept, r, "private")
        replies = ledger.write(replies, r, "replies")
        krum = any(c["strategy-name"] == "multikrum" for c in configs)
        replied = {x.run: x["count"] for x in replies.groupBy("run").count().collect()} if krum else {}
        steps = []
        for run, config in enumerate(configs):
            step = {**config, "n_params": shape.n_params, "round": r, "replied": replied.get(run, 0)}
            own = of_run(updates, run).drop("run")
            before = of_run(state, run).select("layer", "pos", "x", *rules[run].moments)
            steps.append(even(rules[run].combine(body(own, run), before, step), run))
        state = ledger.write(joined(steps), r, "state")
        ledger.write(evaluate(judged_rows(r), heads(state, private, r)), r, "cells")
        ledger.close(r)
    cells = ledger.all_rounds("cells", CELL_SCHEMA, range(rounds + 1)).withColumn("run", run_of)
    sent = ledger.all_rounds("replies", REPLY_SCHEMA, range(1, rounds + 1)) if rounds else None
    sent = sent if rounds else spark.createDataFrame([], REPLY_SCHEMA + ", round int")
    targets = {run: c.get("attack_target_class", 1) for run, c in enumerate(configs)}
    return round_log(cells, sent, targets, shape.n_classes)


def logged(log: DataFrame, configs: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The log of ``run_many`` with the configuration columns of a flat log, one run id per scenario and seed."""
    rows = [
        (
            run, f"{c.get('scenario_name', 'run')}_{c.get('seed', 42)}", c.get("scenario_name", "run"), c["strategy-name"],
            float(c["proximal-mu"]), c.get("attack_name") or "none", c["partitioner-name"],
            float(c["dirichlet-alpha"]), float(c["fraction-train"]), bool(c.get("personalization")),
            [int(i) for i in c.get("malicious-clients-ids") or []],
        )
        for run, c in enumerate(configs)
    ]
    columns = (
        "run int, run_id string, scenario_name string, strategy_name string, proximal_mu double, attack_name string, "
        "partitioner_name string, dirichlet_alpha double, fraction_train double, personalization boolean, malicious_clients_ids array<int>"
    )
    named = log.sparkSession.createDataFrame(rows, columns).withColumn("num_malicious_clients", F.size("malicious_clients_ids"))
    return log.join(named, "run").drop("run")


def _fits(
    fit: Callable[..., DataFrame], rows: DataFrame, now: np.ndarray | DataFrame, configs: Sequence[Mapping[str, Any]],
    runs: Sequence[int], r: int, slot: Column,
) -> list[DataFrame]:
    """One fit for all runs with the same training parameters; each run's order is drawn by its own seed."""
    keys = ("local-epochs", "batch-size", "lr", "momentum", "proximal-mu")
    alike: dict[tuple, list[int]] = {}
    for run in runs:
        alike.setdefault(tuple(configs[run][k] for k in keys), []).append(run)
    found = []
    for (epochs, batch, lr, momentum, mu), some in alike.items():
        own = rows.where(F.col("run").isin(some)) if len(alike) > 1 else rows
        seeds = {run: configs[run].get("seed", 42) + r for run in some}
        if len(set(seeds.values())) == 1:
            seed: int | Column = seeds[some[0]]
        else:
            seed = F.element_at(F.create_map(*[F.lit(x) for pair in seeds.items() for x in pair]), F.col("run"))
        found.append(
            fit(own.withColumn("client_id", slot), now, seed=seed, epochs=epochs, batch_size=batch, lr=lr, momentum=momentum, mu=mu)
        )
    return found
