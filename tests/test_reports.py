import pytest
from pyspark.sql import functions as F

from conftest import rows
from fedlens.operators import reports as R
from fedlens.operators.filters import predicate
from fedlens.plans import reports as P

METRICS = ("server_evaluation_accuracy", "server_evaluation_f1_score", "client_evaluation_accuracy", "client_evaluation_f1_score", "client_evaluation_backdoor_asr")
SCHEMA = (
    "run_id string, scenario_name string, strategy_name string, attack_name string, partitioner_name string, "
    "dirichlet_alpha double, fraction_train double, proximal_mu double, personalization boolean, num_malicious_clients int, "
    "round int, " + ", ".join(f"{m} double" for m in METRICS)
)


def run(run_id, strategy, values, attack="none", bad=0, rnd=40, scenario="s", personal=False, alpha=-1.0):
    partitioner = "iid" if alpha == -1.0 else "dirichlet"
    return (run_id, scenario, strategy, attack, partitioner, alpha, 1.0, 0.0, personal, bad, rnd, *values)


def test_definition_counts():
    series = P.series_reports()
    assert len(series) == 39 and len(P.attacker_reports()) == 3 and len(P.label_flip_reports()) == 9
    assert len({r.name for r in series}) == 39
    assert len(P.table_reports()) == 31 and len(P.overfit_scenarios()) == 12
    titles = [t.heading for t in P.table_reports()]
    assert titles[0] == "### Table 1: Performance at Round 40 in IID Scenarios (Full Participation)"
    assert titles[13] == "### Table 14: Performance under Backdoor Attack at Round 40 (IID, 1 Malicious Client)"
    assert titles[30] == "### Table 31: Performance under Label Flipping Attack at Round 40 (Non-IID α=0.1, 3 Malicious Clients)"


def test_filter_values(spark):
    data = [("a", 0.1, "none", True), ("b", 0.1 + 1e-9, "none", False), ("c", None, "x'y\\z", False), ("d", 0.2, "none", None)]
    df = spark.createDataFrame(data, "run_id string, dirichlet_alpha double, attack_name string, personalization boolean")
    hits = lambda f: [r[0] for r in rows(df.where(predicate(f, df.columns)).select("run_id"))]
    assert hits({"dirichlet-alpha": 0.1}) == ["a", "b"]
    assert hits({"dirichlet-alpha": float("nan")}) == hits({"dirichlet-alpha": None}) == ["c"]
    assert hits({"dirichlet-alpha": [0.2, None]}) == ["c", "d"]
    assert hits({"attack_name": [None, ""]}) == ["a", "b", "d"]
    assert hits({"attack_name": "x'y\\z"}) == ["c"]
    assert hits({"personalization": [None]}) == ["b", "c"] and hits({"personalization": True}) == ["a"]
    assert hits({}) == ["a", "b", "c", "d"]
    with pytest.warns(UserWarning, match="no column"):
        assert hits({"missing-key": 1, "dirichlet-alpha": 0.2}) == ["d"]


@pytest.fixture(scope="module")
def backdoor_runs(spark):
    data = []
    for strategy, means in {
        "MultiKrum": (0.71, 0.72, 0.73, 0.74, 0.05), "FedAvg": (0.61, 0.62, 0.63, 0.64, 0.85),
        "Other": (0.5, 0.5, 0.5, 0.5, 0.5), "Another": (0.4, 0.4, 0.4, 0.4, 0.4),
    }.items():
        for sign in (-1, 1):  # two runs, deviation 0.003 sqrt 2
            data.append(run(f"{strategy}{sign}", strategy, [m + sign * 0.003 for m in means], "backdoor", 1))
    return spark.createDataFrame(data, SCHEMA)


def test_markdown_layout(backdoor_runs):
    tables = P.table_reports()
    lines = R.markdown_lines(R.table_cells(backdoor_runs, tables, 40), tables)
    text = [r.line for r in lines.where("number = 14").orderBy("line_no").collect()]
    assert text == [
        "### Table 14: Performance under Backdoor Attack at Round 40 (IID, 1 Malicious Client)",
        "",
        "| Strategy Name   | Server Accuracy   | Server F1 Score   | Client Accuracy   | Client F1 Score   | Client ASR    |",
        "|:----------------|:------------------|:------------------|:------------------|:------------------|:--------------|",
        "| FedAvg          | 0.610 ± 0.004     | 0.620 ± 0.004     | 0.630 ± 0.004     | 0.640 ± 0.004     | 0.850 ± 0.004 |",
        "| MultiKrum       | 0.710 ± 0.004     | 0.720 ± 0.004     | 0.730 ± 0.004     | 0.740 ± 0.004     | 0.050 ± 0.004 |",
        "| Another         | 0.400 ± 0.004     | 0.400 ± 0.004     | 0.400 ± 0.004     | 0.400 ± 0.004     | 0.400 ± 0.004 |",
        "| Other           | 0.500 ± 0.004     | 0.500 ± 0.004     | 0.500 ± 0.004     | 0.500 ± 0.004     | 0.500 ± 0.004 |",
    ]
    empty = [r.line for r in lines.where("number = 5").orderBy("line_no").collect()]
    assert empty == [tables[4].heading, "", P.NO_DATA]


def test_metric_without_data_is_dropped_and_single_run_has_zero_deviation(spark):
    data = [run("a", "FedAvg", (None, None, 0.5, 0.4, 0.0), personal=True, scenario="A_personalized")]
    df = spark.createDataFrame(data, SCHEMA)
    tables = P.table_reports()
    lines = R.markdown_lines(R.table_cells(df, tables, 40), tables).where("number = 13").orderBy("line_no").collect()
    assert [r.line for r in lines][2:] == [
        "| Scenario Name   | Client Accuracy   | Client F1 Score   |",
        "|:----------------|:------------------|:------------------|",
        "| A_personalized  | 0.500 ± 0.000     | 0.400 ± 0.000     |",
    ]


def test_runs_without_the_target_round_stay(spark):
    """A strategy that stopped early reads N/A; a table of such runs alone has no data."""
    some = (0.5, 0.4, 0.3, 0.2, 0.0)
    data = [run("a", "FedAvg", some), run("b", "FedProx", some, rnd=39), run("c", "FedAvg", some, alpha=0.5, rnd=39)]
    tables = P.table_reports()
    lines = R.markdown_lines(R.table_cells(spark.createDataFrame(data, SCHEMA), tables, 40), tables)
    text = [r.line for r in lines.where("number = 1").orderBy("line_no").collect()][4:]
    assert [x.split("|")[1:3] for x in text] == [[" FedAvg          ", " 0.500 ± 0.000     "], [" FedProx         ", " N/A               "]]
    assert [r.line for r in lines.where("number = 2").orderBy("line_no").collect()] == [tables[1].heading, "", P.NO_DATA]


def test_markdown_files(spark, backdoor_runs, tmp_path):
    tables = P.table_reports()
    R.write_markdown(R.markdown_lines(R.table_cells(backdoor_runs, tables, 40), tables), str(tmp_path / "out"))
    parts = list((tmp_path / "out" / "number=14").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text().splitlines()[4].startswith("| FedAvg ")


def test_series_with_baseline_and_band(spark):
    clean = [run(f"c{i}", "FedAvg", (0.8, 0.8, v, 0.7, 0.0), rnd=1) for i, v in enumerate((0.01, 0.99))]
    attacked = [run("x", "FedAvg", (0.3, 0.3, 0.2, 0.2, 0.9), "byzantine", 2, rnd=1), run("y", "FedMedian", (0.6, 0.6, 0.5, 0.5, 0.0), "byzantine", 2, rnd=1)]
    df = spark.createDataFrame(clean + attacked, SCHEMA)
    out = R.report_series(df, P.series_reports()).where("report = 'fig_38_attack_byzantine_iid_full'")
    acc = {r.series: r for r in out.where("metric = 'client_evaluation_accuracy'").collect()}
    assert set(acc) == {"FedAvg (Under Attack)", "FedMedian", "FedAvg (No Attack)"}
    base = acc["FedAvg (No Attack)"]
    assert base.is_baseline and base.mean == pytest.approx(0.5) and base.lo == 0.0 and base.hi == 1.05
    assert acc["FedMedian"].std == 0.0
    assert out.count() == 12


def test_personalised_reports_show_client_metrics_only(spark):
    data = [
        run("a", "FedAvg", (None, None, 0.5, 0.4, 0.0), personal=True, scenario="FedAvg_nonIID_a0_1_personalized", alpha=0.1),
        run("b", "FedAvg", (0.6, 0.6, 0.5, 0.4, 0.0), scenario="FedAvg_nonIID_a0_1", alpha=0.1),
    ]
    out = R.report_series(spark.createDataFrame(data, SCHEMA), P.series_reports())
    metrics = lambda report: {r.metric for r in out.where(F.col("report") == report).collect()}
    assert metrics("fig_11_noniid_a01_all_vs_personalized") == set(P.CLIENT_METRICS)
    assert metrics("fig_05_noniid_a01_baseline") == set(P.SERVER_METRICS + P.CLIENT_METRICS)
