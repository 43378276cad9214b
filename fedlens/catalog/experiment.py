"""Local fitting, personal heads, and whole federated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedlens.operators import fit as M
from fedlens.operators import metrics as Q
from fedlens.operators.partition import split_train_val
from fedlens.plans.rounds import Shape, logged, members, run_many, run_rounds
from fedlens.plans.scenarios import BASE_CONFIG
from fedlens.session import cut_lineage, workspace
from fedlens.sources import derived as D
from fedlens.sources import derived_sql as S
from fedlens.sources import runlog as L

LR, MU, MOMENTUM = 0.1, 0.01, 0.9
ROUNDS = 3
SHAPE = Shape(D.N_CLASSES, D.N_DIMS, D.HEAD_START, D.SIDE)


def client_gradient(spark, sf):
    gradient = M.client_gradient(D.parts(spark, sf), D.N_CLASSES, M.head_matrix(D.head_long(spark, sf)))
    return gradient.withColumn("g", F.round("g", 6))


def fedprox_step(spark, sf):
    """One step of every client from its own head, pulled towards the shared one."""
    local, shared = D.client_and_shared_heads(spark, sf)
    heads = cut_lineage(spark, M.head_from_long(local, ["client_id"]), "heads")  # of known size when joined
    step = M.proximal_step(M.client_gradient(D.parts(spark, sf), D.N_CLASSES, heads), local, shared, LR, MU)
    return step.withColumn("w", F.round("w", 6))


def client_fit(spark, sf):
    head = M.head_matrix(D.head_long(spark, sf))
    weights, _ = M.merge_units(M.fit_units(D.parts(spark, sf), head, seed=D.SEED, mu=MU))
    return weights.withColumn("w", F.round("w", 6))


def client_fit_full_batch(spark, sf):
    """Two epochs of full-batch descent with momentum and the proximal pull."""
    head = M.head_matrix(D.head_long(spark, sf))
    fitted = M.fit_units(D.parts(spark, sf), head, seed=D.SEED, epochs=2, batch_size=None, lr=LR, momentum=MOMENTUM, mu=MU)
    return M.merge_units(fitted)[0].withColumn("w", F.round("w", 6))


def _personal(spark, sf):
    local, shared = D.client_and_shared_heads(spark, sf)
    clients = local.select("client_id").distinct()
    saved = M.head_from_long(D.saved_only(local), ["client_id"])
    return cut_lineage(spark, M.personal_heads(clients, saved, M.head_from_long(shared)), "heads")


def personal_head(spark, sf):
    return M.head_to_long(_personal(spark, sf), "client_id").withColumn("w", F.round("w", 6))


def clients_without_head(spark, sf):
    clients = D.parts(spark, sf).groupBy("client_id").agg(F.count("*").alias("n_rows"))
    local, _ = D.client_and_shared_heads(spark, sf)
    return M.clients_without_head(clients, D.saved_only(local).select("client_id").distinct())


def personal_eval(spark, sf):
    scored = M.predict_personal(D.parts(spark, sf), _personal(spark, sf))
    scores = Q.eval_scores(scored, ["client_id"])
    return scores.select("client_id", F.round("eval_loss", 6).alias("eval_loss"), F.round("eval_acc", 6).alias("eval_acc"), "num_examples")


def _run(spark, sf, **config):
    """Samples over 10 clients; rows of an own draw form the central test set."""
    drawn = split_train_val(D.parts(spark, sf), 0.2, seed=7).withColumnRenamed("split", "side")
    samples = split_train_val(drawn.where("side = 'train'").drop("side"), 0.2)
    test = drawn.where("side = 'val'").drop("side", "client_id")
    full = {**BASE_CONFIG, "strategy-name": "fedavg", "lr": 0.5, **config}
    return run_rounds(samples, test, full, SHAPE, ROUNDS)


def federated_rounds(spark, sf):
    return _run(spark, sf)


def federated_attack_rounds(spark, sf):
    """Backdoor attackers against Multi-Krum, with partial participation."""
    return _run(
        spark, sf, **{
            "strategy-name": "multikrum", "attack_name": "backdoor", "malicious-clients-ids": [3, 5],
            "attack_injection_rate": 0.15, "num-malicious-nodes": 2, "num_nodes_to_select": 6,
            "fraction-train": 0.8, "fraction-evaluate": 0.8,
        },
    )


def federated_personal_rounds(spark, sf):
    """Private last layer on every client, momentum on the server."""
    return _run(spark, sf, **{"strategy-name": "fedavgm", "server_momentum": 0.7, "personalization": True})


#: Two rows of a manifest, full-batch so that SQL can follow them.
MANIFEST = [
    {**BASE_CONFIG, "scenario_name": "FedAvg_IID", "strategy-name": "fedprox", "lr": 0.5, "batch-size": None, "total-nodes": 12},
    {**BASE_CONFIG, "scenario_name": "FedAvgM_IID", "strategy-name": "fedavgm", "server_momentum": 0.7, "lr": 0.3, "batch-size": None, "seed": 43},
]
LOGGED = [
    "training_loss", "training_num_examples", "client_evaluation_loss", "client_evaluation_accuracy",
    "client_evaluation_num_examples", "server_evaluation_loss", "server_evaluation_accuracy", "server_evaluation_num_examples",
]


def manifest_rounds(spark, sf):
    """Two manifest rows from partitioning to documents, in one plan, read back as reports read them."""
    drawn = split_train_val(D.samples(spark, sf), 0.2, seed=7)
    dataset = drawn.where("split = 'train'").drop("split")
    test = drawn.where("split = 'val'").drop("split")
    log = run_many(members(dataset, MANIFEST, D.N_CLASSES), test, MANIFEST, SHAPE, 2)
    docs = L.log_documents(logged(log, MANIFEST)).select("run_id", F.to_json(F.struct("config", "rounds")).alias("value"))
    folder = workspace(spark, "manifest-logs")
    L.write_documents(docs, folder)
    return L.load_metrics(spark, folder, "*.txt").select("run_id", "scenario_name", "strategy_name", "round", *LOGGED)


QUERIES = {
    f.__name__: f
    for f in (
        client_gradient, fedprox_step, client_fit, client_fit_full_batch, personal_head, clients_without_head, personal_eval,
        federated_rounds, federated_attack_rounds, federated_personal_rounds, manifest_rounds,
    )
}


def _gradient(source: str, tag: str = "") -> str:
    """Gradient of every client from ``source`` (sample_id, client_id, label, cls, score)."""
    return f"""norm{tag} AS (SELECT sample_id, ln(sum(exp(score))) AS lse FROM {source} GROUP BY sample_id),
      residual{tag} AS (SELECT s.sample_id, s.client_id, s.cls, exp(s.score - n.lse) - (s.label = s.cls)::INT AS r
        FROM {source} s JOIN norm{tag} n USING (sample_id)),
      gradient{tag} AS (SELECT r.client_id, r.cls, l.pos, avg(r.r * l.x) AS g, count(*) AS n
        FROM residual{tag} r JOIN parts_long l USING (sample_id) GROUP BY ALL)"""


_BASE = f"WITH {S.SAMPLES}, {S.parts()}, {S.SAMPLES_LONG}, {S.PARTS_LONG}, {S.HEAD}, {S.CLIENT_HEADS}"
_SHARED_SCORES = """logits AS (SELECT l.sample_id, l.client_id, l.label, h.cls, sum(l.x * h.w) AS score
  FROM parts_long l JOIN head h USING (pos) GROUP BY ALL)"""
_OWN_SCORES = lambda heads: f"""logits AS (SELECT l.sample_id, l.client_id, l.label, h.cls, sum(l.x * h.w) AS score
  FROM parts_long l JOIN {heads} h USING (client_id, pos) GROUP BY ALL)"""

SQL = {
    "client_gradient": f"""{_BASE}, {_SHARED_SCORES}, {_gradient("logits")}
        SELECT client_id, cls, pos, round(g, 6) + 0.0 AS g, n FROM gradient""",
    "fedprox_step": f"""{_BASE}, {_OWN_SCORES("client_heads")}, {_gradient("logits")}
        SELECT g.client_id, g.cls, g.pos, round(c.w - {LR} * (g.g + {MU} * (c.w - h.w)), 6) AS w, g.n
        FROM gradient g JOIN client_heads c USING (client_id, cls, pos) JOIN head h ON h.cls = g.cls AND h.pos = g.pos""",
    "client_fit_full_batch": f"""{_BASE}, {_SHARED_SCORES}, {_gradient("logits")},
        once AS (SELECT g.client_id, g.cls, g.pos, h.w - {LR} * g.g AS w, g.g AS v, h.w AS start
          FROM gradient g JOIN head h ON h.cls = g.cls AND h.pos = g.pos),
        {_OWN_SCORES("once").replace("logits AS", "logits_2 AS")}, {_gradient("logits_2", "_2")}
        SELECT g.client_id, g.cls, g.pos, round(o.w - {LR} * ({MOMENTUM} * o.v + g.g + {MU} * (o.w - o.start)), 6) + 0.0 AS w, g.n
        FROM gradient_2 g JOIN once o USING (client_id, cls, pos)""",
    "personal_head": f"{_BASE} SELECT client_id, cls, pos, round(w, 6) + 0.0 AS w FROM personal",
    "clients_without_head": f"""{_BASE} SELECT client_id, count(*) AS n_rows FROM parts
        WHERE client_id NOT IN (SELECT client_id FROM saved_heads) GROUP BY client_id""",
    "personal_eval": f"""{_BASE}, {_OWN_SCORES("personal")}, best AS (
          SELECT sample_id, client_id, label, first(cls ORDER BY score DESC, cls) AS predicted, ln(sum(exp(score))) AS lse
          FROM logits GROUP BY sample_id, client_id, label)
        SELECT b.client_id, round(avg(b.lse - t.score), 6) AS eval_loss, round(avg((b.predicted = b.label)::INT::DOUBLE), 6) AS eval_acc,
          count(*) AS num_examples FROM best b JOIN logits t ON t.sample_id = b.sample_id AND t.cls = b.label GROUP BY b.client_id""",
}


def _manifest_run(run: int, nodes: int, seed: int, lr: float, beta: float) -> str:
    """CTEs of one run: every client takes a full-batch step a round, the server averages and adds its momentum."""
    side = f"""CASE WHEN {S.uniform(7, "split", "sample_id")} < 0.2 THEN 'server'
        WHEN {S.uniform(42, "split", "sample_id")} < 0.2 THEN 'client' ELSE 'train' END"""
    ctes = [
        f"""d{run} AS (SELECT sample_id, label, ({S.draw(seed, "part", "sample_id")} % {nodes})::INT AS client_id, {side} AS side FROM samples)""",
        f"""w{run}_0 AS (SELECT p // 65 AS cls, p % 65 AS pos, 0.01 * {S.gaussian(seed, "init", "p")} AS w, 0.0::DOUBLE AS m
          FROM (SELECT unnest(range(650)) AS p))""",
    ]
    for r in range(3):
        ctes.append(f"""z{run}_{r} AS (SELECT d.sample_id, d.client_id, d.label, d.side, w.cls, sum(x.x * w.w) AS z
          FROM d{run} d JOIN biased x USING (sample_id) JOIN w{run}_{r} w USING (pos) GROUP BY ALL)""")
        ctes.append(f"""s{run}_{r} AS (SELECT sample_id, client_id, label, side, ln(sum(exp(z))) AS lse,
          ln(sum(exp(z))) - max(z) FILTER (cls = label) AS loss, first(cls ORDER BY z DESC, cls) = label AS hit
          FROM z{run}_{r} GROUP BY sample_id, client_id, label, side)""")
        if r < 2:
            ctes.append(f"""g{run}_{r} AS (SELECT z.client_id, z.cls, x.pos,
              avg((exp(z.z - s.lse) - (z.label = z.cls)::INT) * x.x) AS g, count(*) AS n
              FROM z{run}_{r} z JOIN s{run}_{r} s USING (sample_id) JOIN biased x USING (sample_id)
              WHERE z.side = 'train' GROUP BY z.client_id, z.cls, x.pos)""")
            ctes.append(f"""a{run}_{r} AS (SELECT cls, pos, sum(n * (w.w - {lr} * g)) / sum(n) AS a
              FROM g{run}_{r} JOIN w{run}_{r} w USING (cls, pos) GROUP BY cls, pos)""")
            ctes.append(f"""w{run}_{r + 1} AS (SELECT cls, pos, w - ({beta} * m + w - a) AS w, {beta} * m + w - a AS m
              FROM w{run}_{r} JOIN a{run}_{r} USING (cls, pos))""")
    return ", ".join(ctes)


def _manifest_rows(run: int, scenario: str, seed: int, strategy: str) -> str:
    of = lambda r, side: f"FROM s{run}_{r} WHERE side = '{side}'"
    rows = []
    for r in range(3):
        trained = f"(SELECT round(avg(loss), 6) {of(r - 1, 'train')}), (SELECT count(*) {of(r - 1, 'train')})" if r else "NULL, 0"
        client = (
            f"(SELECT round(avg(loss), 6) {of(r, 'client')}), (SELECT round(avg(hit::INT), 4) {of(r, 'client')}), (SELECT count(*) {of(r, 'client')})"
            if r else "NULL, NULL, 0"
        )
        server = f"(SELECT round(avg(loss), 6) {of(r, 'server')}), (SELECT round(avg(hit::INT), 4) {of(r, 'server')}), (SELECT count(*) {of(r, 'server')})"
        rows.append(f"SELECT '{scenario}_{seed}', '{scenario}', '{strategy}', {r}, {trained}, {client}, {server}")
    return " UNION ALL ".join(rows)


SQL["manifest_rounds"] = f"""WITH {S.SAMPLES}, {S.SAMPLES_LONG},
    biased AS (SELECT sample_id, pos, x FROM samples_long UNION ALL SELECT sample_id, 64, 1.0 FROM samples),
    {_manifest_run(0, 12, 42, 0.5, 0.0)}, {_manifest_run(1, 10, 43, 0.3, 0.7)},
    found(run_id, scenario_name, strategy_name, round, {", ".join(LOGGED)}) AS (
      {_manifest_rows(0, "FedAvg_IID", 42, "FedAvg")} UNION ALL {_manifest_rows(1, "FedAvgM_IID", 43, "FedAvgM")})
    SELECT * FROM found"""
