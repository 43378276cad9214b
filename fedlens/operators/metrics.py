"""Metrics of client replies and scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str = "num_examples") -> Column:
    """Mean weighted by examples; no examples give 0."""
    return F.coalesce(F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight)), F.lit(0.0))


def aggregate_train(replies: DataFrame, keys: Sequence[str] = ("round",)) -> DataFrame:
    return replies.groupBy(*keys).agg(
        weighted_mean("train_loss").alias("train_loss"), F.sum("num_examples").alias("num_examples")
    )


def aggregate_eval(replies: DataFrame, keys: Sequence[str] = ("round",)) -> DataFrame:
    """Loss, accuracy and attack success rate, all weighted by the full number of examples."""
    return replies.groupBy(*keys).agg(
        weighted_mean("eval_loss").alias("eval_loss"),
        weighted_mean("eval_acc").alias("eval_acc"),
        weighted_mean("backdoor_asr").alias("backdoor_asr"),
        F.sum("num_examples").alias("num_examples"),
    )


def confusion_cells(predictions: DataFrame, keys: Sequence[str] = (), n_classes: int = 10) -> DataFrame:
    """Rows per (actual, predicted) that occur, within ``keys``; labels out of range are in ``confusion_rejects``.

    Predictions are in range by construction. A filter on them would be pushed below the
    scoring projection and score every row a second time.
    """
    return (
        predictions.where(F.col("label").between(0, n_classes - 1))
        .groupBy(*keys, F.col("label").alias("actual"), "predicted")
        .agg(F.count("*").alias("n"))
    )


def confusion_rejects(predictions: DataFrame, keys: Sequence[str] = (), n_classes: int = 10) -> DataFrame:
    """Rows per label that no cell counts, within ``keys``: the label is null or out of range."""
    inside = F.coalesce(F.col("label").between(0, n_classes - 1), F.lit(False))
    return predictions.where(~inside).groupBy(*keys, "label").agg(F.count("*").alias("n"))


def dense_confusion(cells: DataFrame, keys: Sequence[str] = (), n_classes: int = 10) -> DataFrame:
    """All n_classes x n_classes cells of each key, zero where nothing fell.

    The grid is generated from the keys that occur, so only keys x classes^2 rows are made.
    """
    labels = F.sequence(F.lit(0), F.lit(n_classes - 1))
    cell = F.struct("actual", "predicted")
    filled = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(cell, F.col("n")))).alias("_n"))
    return (
        filled.withColumn("actual", F.explode(labels))
        .withColumn("predicted", F.explode(labels))
        .withColumn("n", F.coalesce(F.try_element_at("_n", cell), F.lit(0).cast("bigint")))
        .drop("_n")
    )


def class_sums(n_classes: int = 10) -> Column:
    """Aggregate over confusion cells: per class its hits, actual and predicted totals.

    The label domain is fixed, so the sums are columns of one grouped pass: classes that never
    occur get zeros without a join, and the rows behind the cells are read once.
    """
    n, actual, predicted = F.col("n"), F.col("actual"), F.col("predicted")
    total = lambda condition: F.sum(F.when(condition, n).otherwise(F.lit(0)))
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("cls"),
                total((actual == c) & (predicted == c)).alias("tp"),
                total(actual == c).alias("actual_n"),
                total(predicted == c).alias("predicted_n"),
            )
            for c in range(n_classes)
        ]
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_f1(sums: Column) -> Column:
    """F1 of one class from its sums; 0/0 counts as 0."""
    return _ratio(sums["tp"] * 2.0, sums["predicted_n"] + sums["actual_n"])


def mean_f1(classes: Column) -> Column:
    """Macro F1 from the array made by ``class_sums``."""
    return F.aggregate(classes, F.lit(0.0), lambda acc, c: acc + class_f1(c)) / F.size(classes)


def per_class_scores(cells: DataFrame, keys: Sequence[str] = (), n_classes: int = 10) -> DataFrame:
    """Precision, recall and F1 of every class of the label domain; 0/0 counts as 0."""
    sums = cells.groupBy(*keys).agg(class_sums(n_classes).alias("_classes")).select(*keys, F.explode("_classes").alias("_c"))
    c = F.col("_c")
    return sums.select(
        *keys,
        c["cls"].alias("cls"),
        _ratio(c["tp"], c["predicted_n"]).alias("precision"),
        _ratio(c["tp"], c["actual_n"]).alias("recall"),
        class_f1(c).alias("f1"),
    )


def macro_f1(cells: DataFrame, keys: Sequence[str] = (), n_classes: int = 10) -> DataFrame:
    sums = cells.groupBy(*keys).agg(class_sums(n_classes).alias("_classes"))
    return sums.select(*keys, mean_f1(F.col("_classes")).alias("macro_f1"))


def eval_scores(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean cross-entropy and accuracy of scored rows."""
    return predictions.groupBy(*keys).agg(
        F.avg("loss").alias("eval_loss"),
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("eval_acc"),
        F.count("*").alias("num_examples"),
    )


def attack_success(target: int) -> Column:
    """Share of non-target rows predicted as the target; no such rows give 0."""
    other = F.col("label") != target
    return F.coalesce(
        F.try_divide(F.count_if((F.col("predicted") == target) & other), F.count_if(other)), F.lit(0.0)
    )
