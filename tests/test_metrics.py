import pytest
from pyspark.sql import functions as F

from conftest import rows
from fedlens.functions.text import clean_metric_name, mean_std_text, title_words
from fedlens.operators import cleaning as K
from fedlens.operators import metrics as M

MATRIX = [[8, 2, 0, 0], [1, 6, 3, 0], [0, 0, 0, 0], [2, 0, 0, 0]]


@pytest.fixture(scope="module")
def cells(spark):
    data = [(a, p, n) for a, row in enumerate(MATRIX) for p, n in enumerate(row) if n]
    return spark.createDataFrame(data, "actual int, predicted int, n bigint")


def test_per_class_scores_and_macro_f1(cells):
    scores = {r.cls: (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6)) for r in M.per_class_scores(cells, n_classes=4).collect()}
    assert scores == {
        0: (0.727273, 0.8, 0.761905), 1: (0.75, 0.6, 0.666667), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0),
    }
    assert round(M.macro_f1(cells, n_classes=4).first().macro_f1, 6) == 0.357143


def test_keyed_scores_fill_absent_classes(cells):
    keyed = cells.withColumn("k", F.lit("a")).unionByName(cells.where("actual = 0").withColumn("k", F.lit("b")))
    assert M.per_class_scores(keyed, ["k"], 4).count() == 8
    assert rows(M.macro_f1(keyed, ["k"], 4).select("k", F.round("macro_f1", 6)))[1] == ("b", round((16 / 18) / 4, 6))


def test_dense_matrix_has_every_cell(spark, cells):
    dense = M.dense_confusion(cells.withColumn("k", F.lit(1)), ["k"], 4)
    assert dense.count() == 16
    assert {(r.actual, r.predicted): r.n for r in dense.collect()} == {
        (a, p): n for a, row in enumerate(MATRIX) for p, n in enumerate(row)
    }


def test_sum_of_matrix_equals_rows(spark):
    df = spark.createDataFrame([(i % 3, i % 4, i % 5) for i in range(200)], "client_id int, label int, predicted int")
    assert M.confusion_cells(df, ["client_id"]).agg(F.sum("n")).first()[0] == 200


def test_labels_out_of_range_are_left_out(spark):
    df = spark.createDataFrame([(0, 1), (12, 1), (-1, 1)], "label int, predicted int")
    assert M.confusion_cells(df).agg(F.sum("n")).first()[0] == 1


def test_weighted_means(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (1, 30, 0.1), (2, 0, 0.7)], "round int, num_examples bigint, train_loss double")
    got = {r.round: (round(r.train_loss, 9), r.num_examples) for r in M.aggregate_train(df).collect()}
    assert got == {1: (0.2, 40), 2: (0.0, 0)}


def test_attack_success_without_other_rows_is_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "label int, predicted int")
    assert df.agg(M.attack_success(1)).first()[0] == 0.0
    df = spark.createDataFrame([(1, 1), (0, 1), (2, 0), (3, 1), (4, 4)], "label int, predicted int")
    assert df.agg(M.attack_success(1)).first()[0] == 0.5


def test_text(spark):
    df = spark.createDataFrame([(0.1235, 0.0625), (0.0625, None), (None, 1.0), (1234.5678, 0.1)], "m double, s double")
    assert [r[0] for r in df.select(mean_std_text(F.col("m"), F.col("s"))).collect()] == [
        "0.123 ± 0.062", "0.062 ± 0.000", "N/A", "1234.568 ± 0.100",
    ]
    names = spark.createDataFrame([("strategy-name", "round40_client_asr"), ("scenario_name", "round40_server_f1_score")], "a string, b string")
    assert rows(names.select(title_words(F.col("a")), clean_metric_name(F.col("b"), 40))) == [
        ("Scenario Name", "Server F1 Score"), ("Strategy Name", "Client ASR"),
    ]


def test_strategy_names(spark):
    data = [("fedprox", 0.0), ("fedprox", None), ("fedprox", 0.01), ("fedprox", -1.0), ("median", 0.0), ("FedProx", 0.0), ("new", 1.0)]
    df = spark.createDataFrame(data, "n string, mu double")
    got = [tuple(r) for r in df.select(K.canonical_strategy("n", "mu"), K.canonical_strategy("n", "mu", True)).collect()]
    assert got == [
        ("FedAvg", "FedAvg"), ("FedAvg", "FedAvg"), ("FedProx", "FedProx"), ("fedprox", "fedprox"),
        ("FedMedian", "FedMedian"), ("FedProx", "FedAvg"), ("new", "new"),
    ]


def test_contract_columns_are_added(spark):
    df = K.with_contract(spark.createDataFrame([("a", "iid"), ("b", None)], "run_id string, partitioner_name string"))
    assert rows(df.select("run_id", "personalization", "attack_name", "fraction_train", "dirichlet_alpha", "partitioner_name")) == [
        ("a", False, "none", 1.0, -1.0, "iid"), ("b", False, "none", 1.0, None, "unknown"),
    ]


def test_every_row_is_in_a_cell_or_a_reject(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 12, 1), (1, -1, 2), (1, None, 2), (1, -1, 0)], "client_id int, label int, predicted int")
    rejects = M.confusion_rejects(df, ["client_id"])
    assert {tuple(r) for r in rejects.collect()} == {(0, 12, 1), (1, -1, 2), (1, None, 1)}
    total = M.confusion_cells(df).agg(F.sum("n")).first()[0] + M.confusion_rejects(df).agg(F.sum("n")).first()[0]
    assert total == df.count()
