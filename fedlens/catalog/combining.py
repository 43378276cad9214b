"""Combining client parameter vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fedlens.operators import combine as C
from fedlens.operators import krum as K
from fedlens.session import cut_lineage
from fedlens.sources import derived as D
from fedlens.sources import derived_sql as S

# Server parameters of the experiment grid.
AVGM = {"lr": 1.0, "beta": 0.7}
ADAM = {"eta": 0.1, "beta_1": 0.7, "beta_2": 0.99, "tau": 0.01}
YOGI = {"eta": 0.01, "beta_1": 0.7, "beta_2": 0.99, "tau": 0.001}
BETA = 0.2
N_MALICIOUS, N_SELECT = 2, 8
CLIP, NOISE = 0.1, 0.3
BLOCK = 16


def _value(df, value="v"):
    return df.select("layer", "pos", F.round(value, 6).alias(value))


def _blocks(spark, sf):
    updates = D.client_params(spark, sf)
    return (
        C.to_blocks(updates, ["round", "client_id"], BLOCK),
        C.to_blocks(D.global_params(spark, sf), [], BLOCK),
    )


def _delta(spark, sf):
    return C.client_delta(*_blocks(spark, sf))


def client_delta(spark, sf):
    return C.to_long(_delta(spark, sf), ["round", "client_id"], BLOCK).select(
        "round", "client_id", "layer", "pos", F.round("v", 6).alias("v")
    )


def update_norms(spark, sf):
    return C.update_norms(_delta(spark, sf)).withColumn("norm", F.round("norm", 6))


def update_norm_stats(spark, sf):
    stats = C.norm_stats(C.update_norms(_delta(spark, sf)))
    return stats.select("round", *[F.round(c, 6).alias(c) for c in stats.columns if c != "round"])


def fedavg(spark, sf):
    return _value(C.fedavg(D.client_params(spark, sf)))


def fed_median(spark, sf):
    return _value(C.coordinate_median(D.client_params(spark, sf)))


def fed_trimmed_mean(spark, sf):
    return _value(C.trimmed_mean(D.client_params(spark, sf), BETA))


def fedper_body(spark, sf):
    return _value(C.fedavg(C.shared_body(D.client_params(spark, sf))))


def model_carry_forward(spark, sf):
    """The mean of the round lacks the last positions; they keep their current value."""
    new = C.fedavg(D.client_params(spark, sf)).where("pos < 60")
    return _value(C.carry_forward(D.global_params(spark, sf), new))


def _two_rounds(spark, sf, moments, step, params):
    state = C.server_state(D.global_params(spark, sf), moments)
    means = [C.fedavg(updates) for updates in D.client_params_two_rounds(spark, sf)]
    state = reduce(lambda s, mean: step(s, mean, **params), means, state)
    return state.select("layer", "pos", *[F.round(c, 6).alias(c) for c in ("x", *moments)])


def fedavgm_2rounds(spark, sf):
    return _two_rounds(spark, sf, ["m"], C.avgm_step, AVGM)


def fedadam_2rounds(spark, sf):
    return _two_rounds(spark, sf, ["m", "v"], C.adam_step, ADAM)


def fedyogi_2rounds(spark, sf):
    return _two_rounds(spark, sf, ["m", "v"], C.yogi_step, YOGI)


def _updates(spark, sf):
    """Client vectors as a written table, for rules that read them more than once."""
    return cut_lineage(spark, D.client_params(spark, sf), "updates")


def _clipped_mean(spark, sf):
    return C.fedavg(C.clip_updates(_updates(spark, sf), D.global_params(spark, sf), CLIP))


def dp_clip(spark, sf):
    return _value(_clipped_mean(spark, sf))


def dp_noise(spark, sf):
    return _value(C.add_noise(_clipped_mean(spark, sf), NOISE, CLIP, D.N_CLIENTS, D.SEED))


def _distances(updates):
    blocks = C.to_blocks(updates, ["round", "client_id"])
    return K.tile_distances(blocks, D.N_CLIENTS, D.N_DIMS)


def _scores(updates):
    return K.krum_scores(_distances(updates), D.N_CLIENTS, N_MALICIOUS)


def krum_pairwise(spark, sf):
    return K.pairwise_distances(_distances(D.client_params(spark, sf))).withColumn("sq_dist", F.round("sq_dist", 6))


def krum_scores(spark, sf):
    return _scores(D.client_params(spark, sf)).withColumn("score", F.round("score", 6))


def krum_select(spark, sf):
    chosen = K.krum_select(_scores(D.client_params(spark, sf)))
    return chosen.select("round", "client_id", F.round("score", 6).alias("score"))


def krum_suppliers(spark, sf):
    """Scores of as many clients as there are suppliers, an eighth of them taken for attackers."""
    updates = cut_lineage(spark, D.supplier_params(spark, sf), "updates")
    n = updates.select("client_id").distinct().count()
    blocks = C.to_blocks(updates, ["round", "client_id"])
    scores = K.streamed_scores(blocks, n, 7 * len(D.SUPPLY_MEASURES), n // 8)
    return scores.select("client_id", F.round("score", 4).alias("score"))


def multikrum(spark, sf):
    updates = _updates(spark, sf)
    return _value(K.multikrum(updates, K.krum_select(_scores(updates), N_SELECT)))


QUERIES = {
    f.__name__: f
    for f in (
        client_delta, update_norms, update_norm_stats, fedavg, fed_median, fed_trimmed_mean, fedper_body,
        model_carry_forward, fedavgm_2rounds, fedadam_2rounds, fedyogi_2rounds, dp_clip, dp_noise,
        krum_pairwise, krum_scores, krum_select, krum_suppliers, multikrum,
    )
}

_P = "WITH " + S.PARAM_CTES
_DELTA = """delta AS (SELECT c.round, c.client_id, layer, pos, c.v - g.v AS v, c.n, g.v AS x
  FROM client_params c JOIN global_params g USING (layer, pos)),
  norms AS (SELECT round, client_id, sqrt(sum(v * v)) AS norm FROM delta GROUP BY round, client_id)"""
_MEAN = "sum(n * v) / sum(n)"
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY layer, pos ORDER BY v, client_id) AS i,
  count(*) OVER (PARTITION BY layer, pos) AS k FROM client_params)"""
_CLIPPED = f"""clipped AS (SELECT layer, pos, sum(n * (x + least(1.0, {CLIP} / norm) * v)) / sum(n) AS v
  FROM delta JOIN norms USING (round, client_id) GROUP BY layer, pos)"""
_PAIRS = """pairs AS (SELECT a.round, a.client_id AS client_a, b.client_id AS client_b,
    sum((a.v - b.v) * (a.v - b.v)) AS sq_dist
  FROM client_params a JOIN client_params b USING (layer, pos) WHERE a.client_id < b.client_id GROUP BY ALL)"""
_SCORES = f"""{_PAIRS}, mirrored AS (
    SELECT round, client_a AS client_id, sq_dist FROM pairs UNION ALL SELECT round, client_b, sq_dist FROM pairs),
  near AS (SELECT *, row_number() OVER (PARTITION BY round, client_id ORDER BY sq_dist) AS i FROM mirrored),
  scores AS (SELECT round, client_id, sum(sq_dist) AS score FROM near WHERE i <= {D.N_CLIENTS} - {N_MALICIOUS} - 2
    GROUP BY round, client_id),
  placed AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY score, client_id) AS place FROM scores)"""


def _unrolled(moments: str, step1: str, step2: str) -> str:
    """Two server rounds written out: ``s1`` from the global model, ``s2`` from ``s1``."""
    return f"""WITH {S.TWO_ROUND_CTES},
      s0 AS (SELECT layer, pos, v AS x, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM global_params),
      s1 AS (SELECT layer, pos, {step1} FROM s0 JOIN avg1 USING (layer, pos)),
      s2 AS (SELECT layer, pos, {step2} FROM s1 JOIN avg2 USING (layer, pos))
      SELECT layer, pos, round(x, 6) + 0.0 AS x, {moments} FROM s2"""


def _avgm() -> str:
    m = f"({AVGM['beta']} * m + (x - a))"
    step = f"x - {AVGM['lr']} * {m} AS x, {m} AS m"
    return _unrolled("round(m, 6) + 0.0 AS m", step, step)


def _adaptive(p: dict, second: str) -> str:
    m = f"({p['beta_1']} * m + (1 - {p['beta_1']}) * (a - x))"
    step = f"x + {p['eta']} * {m} / (sqrt({second}) + {p['tau']}) AS x, {m} AS m, {second} AS v"
    return _unrolled("round(m, 6) + 0.0 AS m, round(v, 6) + 0.0 AS v", step, step)


_D2 = "((a - x) * (a - x))"

SQL = {
    "client_delta": f"{_P}, {_DELTA} SELECT round, client_id, layer, pos, round(v, 6) + 0.0 AS v FROM delta",
    "update_norms": f"{_P}, {_DELTA} SELECT round, client_id, round(norm, 6) AS norm FROM norms",
    "update_norm_stats": f"""{_P}, {_DELTA} SELECT round, round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max,
        round(median(norm), 6) AS norm_median, round(quantile_cont(norm, 0.9), 6) AS norm_p90 FROM norms GROUP BY round""",
    "fedavg": f"{_P} SELECT layer, pos, round({_MEAN}, 6) AS v FROM client_params GROUP BY layer, pos",
    "fed_median": f"{_P} SELECT layer, pos, round(median(v), 6) AS v FROM client_params GROUP BY layer, pos",
    "fed_trimmed_mean": f"""{_P}, {_RANKED} SELECT layer, pos, round(avg(v), 6) AS v FROM ranked
        WHERE i > floor({BETA}::DOUBLE * k) AND i <= k - floor({BETA}::DOUBLE * k) GROUP BY layer, pos""",
    "fedper_body": f"""{_P} SELECT layer, pos, round({_MEAN}, 6) AS v FROM client_params
        WHERE layer NOT LIKE 'fc2.%' GROUP BY layer, pos""",
    "model_carry_forward": f"""{_P}, fresh AS (SELECT layer, pos, {_MEAN} AS v FROM client_params WHERE pos < 60 GROUP BY layer, pos)
        SELECT g.layer, g.pos, round(coalesce(f.v, g.v), 6) AS v FROM global_params g LEFT JOIN fresh f USING (layer, pos)""",
    "fedavgm_2rounds": _avgm(),
    "fedadam_2rounds": _adaptive(ADAM, f"({ADAM['beta_2']} * v + (1 - {ADAM['beta_2']}) * {_D2})"),
    "fedyogi_2rounds": _adaptive(YOGI, f"(v - (1 - {YOGI['beta_2']}) * {_D2} * sign(v - {_D2}))"),
    "dp_clip": f"{_P}, {_DELTA}, {_CLIPPED} SELECT layer, pos, round(v, 6) + 0.0 AS v FROM clipped",
    "dp_noise": f"""{_P}, {_DELTA}, {_CLIPPED} SELECT layer, pos,
        round(v + {NOISE * CLIP / D.N_CLIENTS!r}::DOUBLE * {S.gaussian(42, 'dp', 'layer', 'pos')}, 6) AS v FROM clipped""",
    "krum_pairwise": f"{_P}, {_PAIRS} SELECT round, client_a, client_b, round(sq_dist, 6) AS sq_dist FROM pairs",
    "krum_scores": f"{_P}, {_SCORES} SELECT round, client_id, round(score, 6) AS score FROM scores",
    "krum_select": f"{_P}, {_SCORES} SELECT round, client_id, round(score, 6) AS score FROM placed WHERE place = 1",
    "krum_suppliers": f"""WITH {S.SUPPLIER_PARAMS}, far AS (
          SELECT a.client_id, b.client_id AS other, sum((a.v - b.v) * (a.v - b.v)) AS d
          FROM supplier_params a JOIN supplier_params b USING (pos) WHERE a.client_id <> b.client_id GROUP BY ALL),
        total AS (SELECT count(DISTINCT client_id) AS k FROM supplier_params),
        near AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY d) AS i FROM far)
        SELECT client_id, round(sum(d), 4) AS score FROM near, total WHERE i <= greatest(1, k - k // 8 - 2) GROUP BY client_id""",
    "multikrum": f"""{_P}, {_SCORES} SELECT layer, pos, round(avg(v), 6) AS v FROM client_params
        WHERE client_id IN (SELECT client_id FROM placed WHERE place <= {N_SELECT}) GROUP BY layer, pos""",
}
