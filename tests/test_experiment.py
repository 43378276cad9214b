import numpy as np
import pytest
from pyspark.sql import functions as F

from fedlens.functions.hashing import draw
from fedlens.operators import fit as M
from fedlens.operators.partition import split_train_val
from fedlens.plans import strategies as G
from fedlens.plans.rounds import Shape, logged, members, run_many, run_rounds, score_cells
from fedlens.plans.scenarios import BASE_CONFIG
from fedlens.plans.transforms import AttackOnly, Pictures
from fedlens.sources import runlog as L

SMALL = Shape(n_classes=10, n_features=16, head_start=12, width=4)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(10, 16)) * 1.5
    labels = rng.integers(0, 10, 400)
    x = centers[labels] + rng.normal(size=(400, 16))
    rows = [(i, x[i].tolist(), int(labels[i]), int(i % 4)) for i in range(400)]
    return spark.createDataFrame(rows, "sample_id bigint, features array<double>, label int, client_id int").repartition(5)


def sgd(x, y, start, batch, lr, momentum, mu):
    w, v, total = start.copy(), np.zeros_like(start), 0.0
    for lo in range(0, len(y), batch):
        xb, yb = x[lo : lo + batch], y[lo : lo + batch]
        z = np.exp(xb @ w.T - (xb @ w.T).max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        total += -np.log(p[np.arange(len(yb)), yb]).sum() + mu / 2 * np.square(w - start).sum() * len(yb)
        p[np.arange(len(yb)), yb] -= 1
        v = momentum * v + p.T @ xb / len(yb) + mu * (w - start)
        w = w - lr * v
    return w, total / len(y)


@pytest.mark.parametrize("workers, parts, chunk_rows", [(1, 1, 50_000), (1, 7, 40), (3, 4, 16)])
def test_fit_matches_single_machine(data, workers, parts, chunk_rows):
    """The number of workers decides the result; partitioning, the size of a client and that of a chunk do not."""
    start = np.random.default_rng(1).normal(size=(10, 16)) * 0.1
    uneven = data.where("client_id <> 2 OR sample_id < 90").repartition(parts)
    fitted = M.fit_units(uneven, start, seed=9, batch_size=16, lr=0.1, momentum=0.9, mu=0.05, workers=workers, chunk_rows=chunk_rows)
    weights, replies = M.merge_units(fitted)
    got = {c: np.zeros((10, 16)) for c in range(4)}
    for r in weights.collect():
        got[r.client_id][r.cls, r.pos] = r.w
    loss = {r.client_id: r.train_loss for r in replies.collect()}
    pdf = uneven.withColumn("d", draw(9, "fit", "sample_id")).toPandas().sort_values(["client_id", "d", "sample_id"])
    for c, g in pdf.groupby("client_id"):
        runs = []
        for _, u in g.groupby(g["d"] % workers):
            runs.append((sgd(np.stack(u["features"].to_numpy()), u["label"].to_numpy(), start, 16, 0.1, 0.9, 0.05), len(u)))
        want = sum(w * n for (w, _), n in runs) / len(g)
        assert np.allclose(got[c], want)
        assert loss[c] == pytest.approx(sum(l * n for (_, l), n in runs) / len(g))


@pytest.mark.parametrize("batch, own", [(16, True), (None, False), (None, True)])
def test_epochs_go_on_from_chunk_to_chunk(spark, data, batch, own):
    """Two epochs of clients that are larger than a chunk, from a shared head or from heads of their own."""
    heads = {c: np.random.default_rng(c).normal(size=(10, 16)) * 0.1 for c in range(4)}
    hot = data.where("client_id <> 2 OR sample_id < 60")
    head = heads[0]
    if own:
        head = spark.createDataFrame([(c, h.tolist()) for c, h in heads.items() if c < 3], "client_id int, head array<array<double>>")
    fitted = M.fit_units(hot, head, seed=9, epochs=2, batch_size=batch, lr=0.1, momentum=0.9, mu=0.05, chunk_rows=33)
    got = {r.client_id: r for r in fitted.collect()}
    assert sorted(got) == ([0, 1, 2] if own else [0, 1, 2, 3])
    pdf = hot.withColumn("d", draw(9, "fit", "sample_id")).toPandas().sort_values(["client_id", "d", "sample_id"])
    for c, r in got.items():
        g = pdf[pdf["client_id"] == c]
        x, y = np.stack(g["features"].to_numpy()), g["label"].to_numpy()
        start = heads[c if own else 0]
        w, v, total = start, np.zeros_like(start), 0.0
        for _ in range(2):
            for lo in range(0, len(y), batch or len(y)):
                xb, yb = x[lo : lo + (batch or len(y))], y[lo : lo + (batch or len(y))]
                p = np.exp(xb @ w.T)
                p /= p.sum(1, keepdims=True)
                total += -np.log(p[np.arange(len(yb)), yb]).sum() + 0.025 * np.square(w - start).sum() * len(yb)
                p[np.arange(len(yb)), yb] -= 1
                v = 0.9 * v + p.T @ xb / len(yb) + 0.05 * (w - start)
                w = w - 0.1 * v
        assert np.allclose(np.array(r.weights), w) and r.num_examples == len(y)
        assert r.train_loss == pytest.approx(total / len(y))


def test_gradient_and_scores_match_numpy(data):
    head = np.random.default_rng(2).normal(size=(10, 16))
    pdf = data.toPandas()
    x, y = np.stack(pdf["features"].to_numpy()), pdf["label"].to_numpy()
    logits = x @ head.T
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    scored = {r.sample_id: (r.predicted, r.loss) for r in M.predict(data, head).collect()}
    for i, s in enumerate(pdf["sample_id"]):
        assert scored[s][0] == logits[i].argmax() and scored[s][1] == pytest.approx(-np.log(p[i, y[i]]))
    p[np.arange(len(y)), y] -= 1
    for r in M.client_gradient(data, 10, head).collect():
        mine = (pdf["client_id"] == r.client_id).to_numpy()
        assert r.g == pytest.approx((p[mine, r.cls] * x[mine, r.pos]).mean(), abs=1e-12) and r.n == mine.sum()


def test_own_heads_meet_chunks_of_rows(spark, data):
    """Gradients under own heads are those under each head alone, however a client is cut."""
    heads = {c: np.random.default_rng(c).normal(size=(10, 16)) for c in range(3)}
    frame = spark.createDataFrame([(c, h.tolist()) for c, h in heads.items()], "client_id int, head array<array<double>>")
    got = {(r.client_id, r.cls, r.pos): (r.g, r.n) for r in M.client_gradient(data, 10, frame, chunk_rows=9).collect()}
    assert len(got) == 3 * 160
    for c, h in heads.items():
        for r in M.client_gradient(data.where(F.col("client_id") == c), 10, h).collect():
            assert got[c, r.cls, r.pos] == (pytest.approx(r.g, abs=1e-12), r.n)


def test_label_out_of_range_has_no_loss(spark):
    df = spark.createDataFrame([([1.0, 0.0], 7), ([0.0, 1.0], 1)], "features array<double>, label int")
    got = [tuple(r) for r in M.predict(df, np.eye(2)).select("label", "predicted", F.col("loss").isNull()).orderBy("label").collect()]
    assert got == [(1, 1, False), (7, 0, True)]


def test_personal_scores_use_own_head(spark, data):
    heads = {c: np.random.default_rng(c).normal(size=(10, 16)) for c in range(4)}
    frame = spark.createDataFrame([(c, h.tolist()) for c, h in heads.items()], "client_id int, head array<array<double>>")
    scored = M.predict_personal(data, frame, chunk_rows=30)
    assert scored.count() == data.count()
    for r in scored.collect():
        assert r.predicted == (heads[r.client_id] @ np.array(r.features)).argmax()


def config(**more):
    return {**BASE_CONFIG, "strategy-name": "fedavg", "total-nodes": 4, "lr": 0.1, **more}


def run(data, rounds=2, **more):
    drawn = split_train_val(data, 0.25, seed=7)
    samples = split_train_val(drawn.where("split = 'train'").drop("split"), 0.2)
    test = drawn.where("split = 'val'").drop("split", "client_id")
    return [r.asDict() for r in run_rounds(samples, test, config(**more), SMALL, rounds).orderBy("round").collect()]


def test_rounds_learn_and_start_with_the_server_only(data):
    log = run(data, 3)
    assert [r["round"] for r in log] == [0, 1, 2, 3]
    assert log[0]["training_loss"] is None and log[0]["client_evaluation_accuracy"] is None
    assert log[0]["server_evaluation_accuracy"] is not None
    assert log[3]["server_evaluation_accuracy"] > max(0.4, log[0]["server_evaluation_accuracy"])
    assert log[3]["training_loss"] < log[1]["training_loss"]


def test_personal_rounds_have_no_server_side(data):
    log = run(data, 2, personalization=True)
    assert [r["round"] for r in log] == [1, 2]
    assert all(r["server_evaluation_accuracy"] is None for r in log)
    assert log[1]["client_evaluation_accuracy"] > 0.3


def test_partial_participation_trains_fewer_rows(data):
    full, part = run(data, 1), run(data, 1, **{"fraction-train": 0.5})
    assert part[1]["training_num_examples"] < full[1]["training_num_examples"]


@pytest.mark.parametrize("rule", ["median", "trimmed_avg", "multikrum", "fedavgm", "fedadam", "fedyogi"])
def test_every_rule_runs(data, rule):
    log = run(data, 1, **{"strategy-name": rule, "num-malicious-nodes": 1, "num_nodes_to_select": 3, "eta": 0.01})
    assert log[1]["server_evaluation_num_examples"] > 0


def test_byzantine_clients_report_zero_loss_with_full_weight(data):
    clean, bad = run(data, 1), run(data, 1, attack_name="byzantine", **{"malicious-clients-ids": [1]})
    assert bad[1]["training_num_examples"] == clean[1]["training_num_examples"]
    assert bad[1]["training_loss"] < clean[1]["training_loss"] * 0.9


def test_backdoor_reports_success(data):
    log = run(data, 1, attack_name="backdoor", attack_injection_rate=0.9, **{"malicious-clients-ids": [0, 1, 2, 3]})
    assert log[1]["client_evaluation_backdoor_asr"] > 0.0


def test_private_training_clips_and_adds_noise(data):
    shy = run(data, 1, use_dp=True, dp_clipping_norm=1e-6, dp_noise_multiplier=0.0)
    assert shy[1]["server_evaluation_loss"] == pytest.approx(shy[0]["server_evaluation_loss"], abs=1e-4)
    loud = run(data, 1, use_dp=True, dp_clipping_norm=1.0, dp_noise_multiplier=50.0)
    assert loud[1]["server_evaluation_loss"] > shy[1]["server_evaluation_loss"]


def test_rules_can_be_added(data):
    G.register("frozen", G.Rule(lambda updates, state, config: state))
    log = run(data, 1, **{"strategy-name": "frozen"})
    assert log[0]["server_evaluation_loss"] == log[1]["server_evaluation_loss"]


def parts_of(data):
    drawn = split_train_val(data, 0.25, seed=7)
    return split_train_val(drawn.where("split = 'train'").drop("split"), 0.2), drawn.where("split = 'val'").drop("split", "client_id")


def as_rows(log):
    return [tuple(r) for r in log.orderBy(*[c for c in ("run", "round") if c in log.columns]).collect()]


def test_runs_together_are_runs_alone(data):
    """Runs of different rules, attacks, rates and seeds give in one plan what each gives alone."""
    train, test = parts_of(data)
    configs = [
        config(seed=5, **{"strategy-name": "fedadam", "eta": 0.01, "lr": 0.2}), config(personalization=True),
        config(attack_name="backdoor", attack_injection_rate=0.5, **{"malicious-clients-ids": [2], "fraction-train": 0.5}),
    ]
    both = train.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1))))
    together = run_many(both, test, configs, SMALL, 1)
    columns = [c for c in together.columns if c not in ("run", "round")]
    for run, one in enumerate(configs):
        alone = run_rounds(train, test, one, SMALL, 1)
        a = as_rows(alone.select("round", *columns))
        b = as_rows(together.where(F.col("run") == run).select("round", *columns))
        assert len(a) == len(b) >= 1
        for x, y in zip(a, b):
            assert all(p == q or p == pytest.approx(q, abs=2e-4) for p, q in zip(x, y))


def test_broken_off_and_repeated_rounds_change_nothing(spark, data, tmp_path):
    train, test = parts_of(data)
    want = as_rows(run_rounds(train, test, config(), SMALL, 2))
    folder = f"file:{tmp_path}/ledger"
    run_rounds(train, test, config(), SMALL, 1, folder=folder)
    half = "run int, client_id int, train_loss double, num_examples bigint"
    spark.createDataFrame([(0, 0, 9.0, 10**6)], half).write.parquet(f"{folder}/round=2/replies")  # broken off here
    assert as_rows(run_rounds(train, test, config(), SMALL, 2, folder=folder)) == want
    fitted = []
    again = run_rounds(train, test, config(), SMALL, 2, folder=folder, fit=lambda *a, **k: fitted.append(1))
    assert as_rows(again) == want and not fitted
    with pytest.raises(ValueError):
        run_rounds(train, test, config(lr=0.2), SMALL, 2, folder=folder)


def test_manifest_rows_become_documents(spark, data, tmp_path):
    rows = data.drop("client_id")
    configs = [
        config(scenario_name="One_IID", seed=1),
        config(scenario_name="Two_nonIID", seed=2, **{"partitioner-name": "dirichlet", "dirichlet-alpha": 0.5, "val-split-percentage": 0.4}),
    ]
    dealt = members(rows, configs, 10)
    held = {r.run: r["count"] for r in dealt.groupBy("run").count().collect()}
    shares = {(r.run, r.split): r["count"] for r in dealt.groupBy("run", "split").count().collect()}
    assert held == {0: 400, 1: 400} and shares[1, "val"] > 1.5 * shares[0, "val"]
    log = logged(run_many(dealt, rows, configs, SMALL, 1), configs)
    docs = L.log_documents(log).select("run_id", F.to_json(F.struct("config", "rounds")).alias("value"))
    L.write_documents(docs, f"{tmp_path}/logs")
    found = L.load_metrics(spark, f"{tmp_path}/logs", "*.txt")
    got = sorted((r.run_id, r.round, r.dirichlet_alpha, r.server_evaluation_num_examples) for r in found.collect())
    assert got == [("One_IID_1", 0, 0.0, 400), ("One_IID_1", 1, 0.0, 400), ("Two_nonIID_2", 0, 0.5, 400), ("Two_nonIID_2", 1, 0.5, 400)]


def test_transform_fit_and_evaluation_can_be_replaced(data):
    train, test = parts_of(data)
    seen = []

    class Blank(AttackOnly):
        def train(self, rows, run, r):
            seen.append(r)
            return rows.withColumn("features", F.transform("features", lambda x: x * 0.0))

    def lazy(rows, head, **how):
        return M.fit_units(rows, head, **{**how, "epochs": 1, "lr": 0.0})

    def generous(rows, heads):
        return score_cells(rows, heads).withColumn("loss", F.lit(0.0))

    plain = as_rows(run_rounds(train, test, config(), SMALL, 1).select("round", "server_evaluation_accuracy"))
    blind = as_rows(run_rounds(train, test, config(), SMALL, 1, transform=Blank(4)).select("round", "server_evaluation_accuracy"))
    assert seen == [1] and blind[1][1] < plain[1][1]
    still = as_rows(run_rounds(train, test, config(), SMALL, 1, fit=lazy, evaluate=generous).select("server_evaluation_accuracy", "server_evaluation_loss", "round"))
    assert still[0][:2] == still[1][:2] and still[0][1] == 0.0


def test_pictures_are_drawn_anew_each_round(data):
    """Crops, flips and poisoned rows change with the round; a round gives the same rows however they lie."""
    run = config(attack_name="backdoor", attack_injection_rate=0.5, **{"malicious-clients-ids": [0, 1, 2, 3]})
    pictures = Pictures(4, 1)
    rows = lambda df: {r.sample_id: (tuple(r.features), r.label) for r in df.collect()}
    first, again, second = rows(pictures.train(data, run, 1)), rows(pictures.train(data.repartition(3), run, 1)), rows(pictures.train(data, run, 2))
    assert first == again and sum(first[i] != second[i] for i in first) > 300
    stamped = (1.0 - 0.1307) / 0.3081
    hit = [i for i, (x, y) in first.items() if all(abs(x[r * 4 + c] - stamped) < 1e-9 for r in range(3) for c in range(3))]
    assert 120 < len(hit) < 280 and {first[i][1] for i in hit} == {1}
    train, test = parts_of(data)
    log = as_rows(run_rounds(train, test, config(), SMALL, 1, transform=pictures).select("round", "server_evaluation_num_examples"))
    assert log[0][1] == log[1][1] > 0
