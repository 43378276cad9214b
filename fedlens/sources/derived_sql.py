"""SQL definitions of the derived inputs, used to check the Spark frames."""

from __future__ import annotations


def draw(seed: int, tag: str, *ids: str) -> str:
    key = " || ':' || ".join([f"'{seed}:{tag}'"] + [f"({i})::VARCHAR" for i in ids])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT)"


def uniform(seed: int, tag: str, *ids: str) -> str:
    return f"({draw(seed, tag, *ids)} / 4294967296.0)"


def gaussian(seed: int, tag: str, *ids: str) -> str:
    r, a = draw(seed, tag + "/r", *ids), uniform(seed, tag + "/a", *ids)
    return f"(sqrt(-2.0 * ln(({r} + 1) / 4294967296.0)) * cos(2.0 * pi() * {a}))"


SAMPLES = "samples AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS features, label FROM embeddings)"


def parts(name: str = "parts", tag: str = "part") -> str:
    return f"{name} AS (SELECT *, ({draw(42, tag, 'sample_id')} % 10)::INT AS client_id FROM samples)"


def long(source: str, *keep: str, name: str | None = None) -> str:
    cols = "".join(c + ", " for c in keep)
    name = name or source + "_long"
    return (
        f"{name} AS (SELECT {cols}unnest(features) AS x, "
        f"(generate_subscripts(features, 1) - 1)::INT AS pos FROM {source})"
    )


SAMPLES_LONG = long("samples", "sample_id", "label")
PARTS_LONG = long("parts", "sample_id", "label", "client_id")
HEAD = "head AS (SELECT label AS cls, pos, avg(x) AS w FROM samples_long GROUP BY label, pos)"

HEAD_CTES = ", ".join([SAMPLES, parts(), SAMPLES_LONG, HEAD])


def scored(source: str, name: str = "scored", head: str = "head") -> str:
    """Score of every (sample, class) of ``source`` under ``head``."""
    return (
        f"{long(source, 'sample_id')}, {name} AS (SELECT l.sample_id, h.cls, sum(l.x * h.w) AS score "
        f"FROM {source}_long l JOIN {head} h USING (pos) GROUP BY l.sample_id, h.cls)"
    )


def predicted(source: str, name: str = "predictions", scores: str = "scored") -> str:
    """Predicted class and cross-entropy of every row of ``source``."""
    return f"""{name}_best AS (
  SELECT sample_id, first(cls ORDER BY score DESC, cls) AS predicted,
         max(score) + ln(sum(exp(score))) - max(score) AS lse FROM {scores} GROUP BY sample_id),
{name} AS (
  SELECT s.sample_id, s.client_id, s.label, b.predicted, b.lse - t.score AS loss
  FROM {source} s JOIN {name}_best b USING (sample_id)
  JOIN {scores} t ON t.sample_id = s.sample_id AND t.cls = s.label)"""


PREDICTION_CTES = ", ".join([HEAD_CTES, scored("parts"), predicted("parts")])

LAYER = "CASE WHEN pos < 48 THEN 'body.weight' ELSE 'fc2.weight' END"


def client_params(name: str = "client_params", source: str = "parts", round_number: int = 1) -> str:
    return (
        f"{name} AS (SELECT {round_number} AS round, client_id, {LAYER} AS layer, pos, avg(x) AS v, "
        f"count(x) AS n FROM {source}_long GROUP BY client_id, pos)"
    )


SUPPLIER_PARAMS = """supplier_params AS (
  SELECT 1 AS round, l_suppkey::INT AS client_id, ((l_linenumber - 1) * 4 + i)::INT AS pos, v, n
  FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, unnest(range(4)) AS i,
          unnest([avg(l_quantity), avg(l_extendedprice / 1000), avg(l_discount * 100), avg(l_tax * 100)]) AS v
        FROM lineitem GROUP BY l_suppkey, l_linenumber))"""
GLOBAL_PARAMS = f"global_params AS (SELECT {LAYER} AS layer, pos, avg(x) AS v FROM samples_long GROUP BY pos)"
PARAM_CTES = ", ".join(
    [SAMPLES, parts(), SAMPLES_LONG, PARTS_LONG, client_params(), GLOBAL_PARAMS]
)
TWO_ROUND_CTES = ", ".join(
    [
        PARAM_CTES,
        parts("parts2", "part2"),
        long("parts2", "client_id"),
        client_params("client_params2", "parts2", 2),
        "avg1 AS (SELECT layer, pos, sum(n * v) / sum(n) AS a FROM client_params GROUP BY layer, pos)",
        "avg2 AS (SELECT layer, pos, sum(n * v) / sum(n) AS a FROM client_params2 GROUP BY layer, pos)",
    ]
)

REPLIES = """replies AS (
  SELECT l_linenumber AS round, (l_suppkey % 10)::INT AS client_id, l_quantity::BIGINT AS num_examples,
         l_extendedprice / 10000 AS train_loss, l_extendedprice / 20000 AS eval_loss,
         1 - l_discount AS eval_acc, l_tax AS backdoor_asr FROM lineitem)"""

CLIENT_HEADS = """own_means AS (
  SELECT client_id, label AS cls, pos, avg(x) AS own FROM parts_long GROUP BY client_id, label, pos),
client_heads AS (
  SELECT c.client_id, h.cls, h.pos, coalesce(o.own, h.w) AS w
  FROM head h CROSS JOIN (SELECT unnest(range(10))::INT AS client_id) c
  LEFT JOIN own_means o ON o.client_id = c.client_id AND o.cls = h.cls AND o.pos = h.pos),
saved_heads AS (SELECT * FROM client_heads WHERE client_id < 7),
personal AS (
  SELECT c.client_id, h.cls, h.pos, coalesce(s.w, h.w) AS w
  FROM head h CROSS JOIN (SELECT DISTINCT client_id FROM client_heads) c
  LEFT JOIN saved_heads s ON s.client_id = c.client_id AND s.cls = h.cls AND s.pos = h.pos)"""

RAW_CONFIG = """raw_config AS (
  SELECT c_custkey AS run_id,
    ['fedprox','fedavgm','fedadam','fedyogi','median','trimmed_avg','multikrum','other'][c_custkey % 8 + 1] AS strategy_name,
    ['0.0','0.01','n/a'][c_custkey % 3 + 1] AS proximal_mu,
    [NULL,'','backdoor','label_flipping'][c_custkey % 4 + 1] AS attack_name,
    ['iid','dirichlet'][c_custkey % 2 + 1] AS partitioner_name,
    [NULL,0.5,0.1,0.03,0.0][c_custkey % 5 + 1]::DOUBLE AS dirichlet_alpha,
    [NULL,'0.8','0.7','1.0','bad','1.0','0.8'][c_custkey % 7 + 1] AS fraction_train,
    [NULL,true,false,false,false,true][c_custkey % 6 + 1] AS personalization,
    CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN [3,5] ELSE []::INT[] END AS malicious_clients_ids,
    trunc(c_acctbal)::BIGINT::VARCHAR AS num_examples
  FROM customer)"""

CLEAN_NAMES = "['FedAvg','FedProx','FedAvgM','FedAdam','FedYogi','FedMedian','TrimmedAvg','MultiKrum']"
RAW_NAMES = "['fedprox','fedprox','fedavgm','fedadam','fedyogi','median','trimmed_avg','multikrum']"

RAW_METRICS = f"""cells AS (
  SELECT user_id % 150 AS run_no, day(ts)::INT AS round, avg(value) AS m, max(value) AS mx, count(*) AS n,
         avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS clicks
  FROM events GROUP BY 1, 2),
raw_metrics AS (
  SELECT 'run_' || run_no AS run_id,
    (CASE WHEN (run_no // 8) % 2 = 0 THEN '' WHEN (run_no // 64) % 2 = 1 THEN 'Backdoor_Attack_' ELSE 'LabelFlip_Attack_' END)
      || (CASE WHEN (run_no // 8) % 2 = 1 AND run_no % 8 = 6 THEN 'Fed' ELSE '' END) || {CLEAN_NAMES}[run_no % 8 + 1]
      || (CASE WHEN (run_no // 16) % 2 = 0 THEN '_IID' WHEN (run_no // 8) % 2 = 1 THEN '_nonIID_a01' ELSE '_nonIID_a0_1' END)
      || (CASE WHEN run_no >= 128 THEN '_personalized' ELSE '' END)
      || (CASE WHEN (run_no // 32) % 2 = 0 THEN '' ELSE '_frac08' END) AS scenario_name,
    {RAW_NAMES}[run_no % 8 + 1] AS strategy_name,
    CASE WHEN run_no % 8 = 1 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS proximal_mu,
    CASE WHEN (run_no // 8) % 2 = 0 THEN 'none' WHEN (run_no // 64) % 2 = 1 THEN 'backdoor' ELSE 'label_flipping' END AS attack_name,
    CASE WHEN (run_no // 16) % 2 = 0 THEN 'iid' ELSE 'dirichlet' END AS partitioner_name,
    CASE WHEN (run_no // 16) % 2 = 0 THEN -1.0::DOUBLE ELSE 0.1::DOUBLE END AS dirichlet_alpha,
    CASE WHEN (run_no // 32) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS fraction_train,
    run_no >= 128 AS personalization,
    (CASE WHEN (run_no // 8) % 2 = 1 THEN 1 + run_no % 3 ELSE 0 END)::INT AS num_malicious_clients,
    round, mx / 127 AS training_loss, n * 4 AS training_num_examples,
    m / 101 AS client_evaluation_loss, m / 503 AS client_evaluation_accuracy, m / 557 AS client_evaluation_f1_score,
    clicks AS client_evaluation_backdoor_asr, n AS client_evaluation_num_examples,
    CASE WHEN run_no < 128 THEN m / 97 END AS server_evaluation_loss,
    CASE WHEN run_no < 128 THEN m / 509 END AS server_evaluation_accuracy,
    CASE WHEN run_no < 128 THEN m / 563 END AS server_evaluation_f1_score,
    CASE WHEN run_no < 128 THEN n * 2 END AS server_evaluation_num_examples
  FROM cells)"""

CANONICAL = """CASE WHEN strategy_name = 'fedprox' AND proximal_mu > 0 THEN 'FedProx'
    WHEN strategy_name = 'fedprox' AND (proximal_mu = 0 OR proximal_mu IS NULL) THEN 'FedAvg'
    WHEN strategy_name = 'fedavgm' THEN 'FedAvgM' WHEN strategy_name = 'fedadam' THEN 'FedAdam'
    WHEN strategy_name = 'fedyogi' THEN 'FedYogi' WHEN strategy_name = 'median' THEN 'FedMedian'
    WHEN strategy_name = 'trimmed_avg' THEN 'TrimmedAvg' WHEN strategy_name = 'multikrum' THEN 'MultiKrum'
    ELSE strategy_name END"""

METRICS = f"{RAW_METRICS}, metrics AS (SELECT * REPLACE ({CANONICAL} AS strategy_name) FROM raw_metrics)"
