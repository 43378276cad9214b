import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fedlens.operators.filters import predicate
from fedlens.plans import scenarios as N
from fedlens.sources import runlog as L
from fedlens.sources import runlog_store as V

CONFIG = {
    "scenario_name": "FedAvg_IID", "strategy-name": "fedprox", "proximal-mu": 0.0, "partitioner-name": "iid",
    "fraction-train": 1.0, "personalization": False, "attack_name": None, "malicious-clients-ids": [3, 5],
}


def entry(number, client=0.5, server=0.6):
    return {
        "round": number, "timestamp": "2024-01-01 00:00:00",
        "training": {"loss": 1.5, "num_examples": 80},
        "client_evaluation": {"loss": 1.0, "accuracy": client, "f1_score": 0.4, "backdoor_asr": 0.0, "num_examples": 20},
        "server_evaluation": {} if server is None else {"loss": 0.9, "accuracy": server, "f1_score": 0.5, "num_examples": 100},
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("outputs")

    def put(path, content):
        target = root / path / "results.json"
        target.parent.mkdir(parents=True)
        target.write_text(content if isinstance(content, str) else json.dumps(content, indent=2))

    start = {"round": 0, "training": {}, "client_evaluation": {}, "server_evaluation": {"loss": 2.3, "accuracy": 0.1, "f1_score": 0.02, "num_examples": 100}}
    put("a/plain", {"config": CONFIG, "rounds": [start, entry(1), entry(2, 0.7)], "summary": {}})
    put("b/plain", {"config": {**CONFIG, "scenario_name": "copy"}, "rounds": [entry(1, 0.9)]})
    put("personal", {"config": {**CONFIG, "scenario_name": "P", "seed": 7, "personalization": True, "dirichlet-alpha": 0.1, "partitioner-name": "dirichlet"}, "rounds": [entry(1, server=None)]})
    put("odd", {"config": {"scenario_name": "odd", "proximal-mu": "n/a", "attack_name": "", "malicious-clients-ids": "none", "strategy-name": "fedprox"}, "rounds": [entry(1, float("nan"))]})
    put("nulls", {"config": {"scenario_name": "nulls", "strategy-name": "trimmed_avg", "fraction-train": None, "personalization": None, "partitioner-name": "iid"}, "rounds": [{"round": None}, entry(3)]})
    put("anonymous", {"config": {"strategy-name": "median"}, "rounds": [entry(1)]})
    put("zz/anonymous", {"config": {**CONFIG, "scenario_name": "named later"}, "rounds": [entry(1)]})
    put("empty", {"config": CONFIG, "rounds": []})
    put("cut", json.dumps({"config": CONFIG, "rounds": [entry(1)]})[:120])
    (root / "plain.txt").write_text("not a log")
    return str(root)


def test_usable_and_rejected(spark, folder):
    logs = L.read_logs(spark, folder)
    kept = {(r.run_id, r.config["scenario_name"]) for r in L.usable_logs(logs).collect()}
    assert kept == {("plain", "FedAvg_IID"), ("personal", "P"), ("odd", "odd"), ("nulls", "nulls"), ("anonymous", "named later")}
    assert rows(L.rejected_logs(logs).select("run_id", "reason")) == [
        ("anonymous", "no scenario"), ("cut", "corrupt"), ("empty", "no rounds"), ("plain", "duplicate"),
    ]
    both = L.log_state(logs).where("reason IS NULL").select("run_id", "file_path")
    assert rows(both) == rows(L.usable_logs(logs).select("run_id", "file_path"))


def test_flat_values(spark, folder):
    flat = {(r.run_id, r["round"]): r for r in L.load_metrics(spark, folder).collect()}
    assert set(flat) == {("plain", 0), ("plain", 1), ("plain", 2), ("personal", 1), ("odd", 1), ("nulls", 3), ("anonymous", 1)}
    start = flat["plain", 0]
    assert start.client_evaluation_accuracy is None and start.client_evaluation_num_examples == 0
    assert start.server_evaluation_accuracy == 0.1 and start.num_malicious_clients == 2
    assert start.dirichlet_alpha == -1.0 and start.strategy_name == "FedAvg" and start.attack_name == "none"
    assert flat["personal", 1].server_evaluation_accuracy is None and flat["personal", 1].personalization is True
    odd = flat["odd", 1]
    assert odd.client_evaluation_accuracy is None and odd.proximal_mu is None and odd.strategy_name == "FedAvg"
    assert odd.num_malicious_clients == 0 and odd.partitioner_name == "none" and odd.dirichlet_alpha is None
    nulls = flat["nulls", 3]
    assert nulls.fraction_train == 1.0 and nulls.personalization is False and nulls.strategy_name == "TrimmedAvg"


def test_any_configuration_key_can_be_filtered(spark, folder):
    logs = L.load_metrics(spark, folder, extra_keys=["alpha-server", "local-epochs"])
    assert logs.where("alpha_server IS NOT NULL").count() == 0
    flat = L.flatten(L.usable_logs(L.read_logs(spark, folder)), ["seed"])
    assert flat.where(predicate({"seed": "7"}, flat.columns)).select("run_id").distinct().count() == 1


def test_documents_keep_every_attacker(spark):
    row = ("a", "A", "FedAvg", 0.0, "byzantine", "iid", -1.0, 1.0, False, 5, [4, 8, 15, 16, 23])
    names = "run_id string, scenario_name string, strategy_name string, proximal_mu double, attack_name string, partitioner_name string, dirichlet_alpha double, fraction_train double, personalization boolean, num_malicious_clients int, malicious_clients_ids array<int>"
    flat = spark.createDataFrame([row], names).withColumn("round", F.lit(1))
    for group, metrics in L.METRIC_GROUPS.items():
        flat = flat.withColumns({f"{group}_{m}": F.lit(0.5) for m in metrics})
    listed = lambda df: L.log_documents(df).first().config["malicious-clients-ids"]
    assert listed(flat) == "[4,8,15,16,23]" and listed(flat.drop("malicious_clients_ids")) == "[1,2,3,4,5]"


def test_documents_round_trip(spark, folder):
    flat = L.load_metrics(spark, folder).where("run_id <> 'odd'")
    again = L.flatten(L.log_documents(flat))
    assert rows(again.select(*flat.columns)) == rows(flat)


def test_upsert_and_summary(spark):
    sent = spark.createDataFrame(
        [("r", 1, 0.1, 1), ("r", 2, 0.5, 2), ("r", 1, 0.9, 3), ("s", 1, None, 1)], "run_id string, round int, acc double, seq int"
    )
    latest = L.upsert_rounds(sent, F.col("seq"))
    assert rows(latest.select("run_id", "round", F.coalesce("acc", F.lit(-1.0)))) == [("r", 1, 0.9), ("r", 2, 0.5), ("s", 1, -1.0)]
    names = set(L.SUMMARY_METRICS.values()) | {"client_evaluation_backdoor_asr"}
    flat = latest.select("run_id", "round", *[F.col("acc").alias(n) for n in sorted(names)])
    summary = {r.run_id: r for r in L.run_summary(flat).collect()}
    assert summary["r"].best_client_accuracy == 0.9 and summary["r"].final_client_accuracy == 0.5
    assert summary["r"].total_rounds_completed == 2 and summary["s"].best_server_f1_score == 0.0


def test_scenario_grid():
    grid = N.scenario_definitions()
    names = [d["scenario_name"] for d in grid]
    assert len(grid) == 101
    assert len({json.dumps(d, sort_keys=True) for d in grid}) == 101
    assert sum("personalization" in d for d in grid) == 12
    assert {"FedYogi_nonIID_a0_03_frac07", "LabelFlip_Attack_MultiKrum_nonIID_a05", "FedAvg_IID_personalized"} <= set(names)
    krum = next(d for d in grid if d["scenario_name"] == "Backdoor_Attack_MultiKrum_nonIID_a05")
    assert krum["num_nodes_to_select"] == 9 and krum["num-malicious-nodes"] == 1


def test_manifest(spark):
    frame = N.scenarios_frame(spark)
    assert [r.scenario_name for r in frame.where("enabled").collect()] == ["FedAvg_IID"]
    runs = N.run_manifest(frame)
    assert runs.count() == 101 * 15
    one = runs.where("scenario_name = 'FedAdam_nonIID_a0_1' AND repetition = 14").first()
    assert one.seed == 56 and one.config["seed"] == "56" and one.config["beta_1"] == "0.7" and one.config["lr"] == "0.01"
    assert one.config["dirichlet-alpha"] == "0.1" and one.config["strategy-name"] == "fedadam"


def document(run_id, *entries, scenario="S"):
    text = {"run_id": run_id, "config": {"scenario_name": scenario}, "rounds": list(entries)}
    return json.dumps(text)


def documents(spark, *lines):
    schema = "run_id string, config map<string,string>, " + L.LOG_SCHEMA["rounds"].dataType.simpleString().join(["rounds ", ""])
    return spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", schema).alias("d")).select("d.*")


def stored(spark, folder):
    docs = V.read_documents(spark, folder)
    return {
        r.run_id: ([(e["round"], e["client_evaluation"]["accuracy"]) for e in r.rounds], r.summary, r.config["scenario_name"])
        for r in docs.collect()
    }


def test_documents_grow_by_whole_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert V.read_documents(spark, folder) is None
    assert V.merge_documents(spark, folder, documents(spark, document("a", entry(2), entry(1, 0.9)), document("b", entry(1, None))), 4) == 1
    first = stored(spark, folder)
    assert first["a"][0] == [(1, "0.9"), (2, "0.5")]
    summary = first["a"][1]
    assert (summary.total_rounds_completed, summary.best_client_accuracy, summary.final_client_accuracy) == (2, 0.9, 0.5)
    assert first["b"][1].best_client_accuracy == 0.0
    more = documents(spark, document("a", entry(2, 0.7), entry(3, 0.1), scenario="T"), document("c", entry(5)))
    assert V.merge_documents(spark, folder, more, 4) == 2
    second = stored(spark, folder)
    assert second["a"][0] == [(1, "0.9"), (2, "0.7"), (3, "0.1")] and second["a"][2] == "T"
    assert second["b"] == first["b"] and second["c"][0] == [(5, "0.5")]
    assert second["a"][1].final_client_accuracy == 0.1
    # the same rounds again change nothing but the version, and nothing new makes none
    assert V.merge_documents(spark, folder, more, 4) == 3 and stored(spark, folder) == second
    assert V.merge_documents(spark, folder, more.limit(0), 4) == 3


def test_a_merge_that_broke_off_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "store")
    V.merge_documents(spark, folder, documents(spark, document("a", entry(1))), 1)
    before = stored(spark, folder)
    V.merge_documents(spark, folder, documents(spark, document("a", entry(2))), 1)
    os.rename(f"{folder}/manifest/version=2", f"{tmp_path}/taken-back")  # as if the job had ended before the manifest
    assert stored(spark, folder) == before
    V.merge_documents(spark, folder, documents(spark, document("a", entry(3))), 1)
    assert [n for n, _ in stored(spark, folder)["a"][0]] == [1, 3]
