"""Filters, baselines, curves and tables over the flat metrics."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from fedlens.operators import cleaning as K
from fedlens.operators import reports as R
from fedlens.operators.filters import config_keys, predicate
from fedlens.plans import reports as P
from fedlens.session import workspace
from fedlens.sources import derived as D
from fedlens.sources import derived_sql as S
from fedlens.sources import runlog as L

SERIES = P.series_reports() + P.attacker_reports()
FLIPS = P.label_flip_reports()
TABLES = P.table_reports(D.TARGET_ROUND)
CURVE_METRICS = [*P.SERVER_METRICS, *P.CLIENT_METRICS, P.ASR_METRIC]
MIXED_FILTER = {
    "attack_name": ["none", None, ""],
    "personalization": [False, None],
    "dirichlet-alpha": [0.5, 0.1, None],
    "strategy-name": ["FedAvg", "FedProx", "FedMedian", "TrimmedAvg"],
}
KEY_FILTER = {"server_momentum": [0.7, 0.8], "fraction-train": 1.0, "seed": None, "warm-up": True}
CLOSE_FILTER = {"fraction-train": 0.8, "dirichlet-alpha": -1.0, "personalization": False}
STATS = ("mean", "std", "lo", "hi")


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


def _clean_config(spark, sf):
    config = K.config_defaults(D.raw_config(spark, sf))
    return config.withColumn("strategy_name", K.canonical_strategy("strategy_name", "proximal_mu"))


def filter_map(spark, sf):
    config = _clean_config(spark, sf)
    return config.where(predicate(MIXED_FILTER, config.columns)).select("run_id", "strategy_name", "attack_name")


def filter_isclose(spark, sf):
    config = _clean_config(spark, sf)
    return config.where(predicate(CLOSE_FILTER, config.columns)).select("run_id", "fraction_train", "dirichlet_alpha")


def filter_config_key(spark, sf):
    """Rounds of runs picked by keys that only their configuration map has; a key of no log is skipped."""
    momentum = F.when(F.col("config.strategy-name") == "fedavgm", F.lit("0.70")).otherwise(F.lit("0.0"))
    docs = L.log_documents(D.raw_metrics(spark, sf))
    whole = docs.withColumn("config", F.struct("config.*", momentum.alias("server_momentum")))
    folder = workspace(spark, "momentum-logs")
    L.write_documents(whole.select("run_id", F.to_json(F.struct("config", "rounds")).alias("value")), folder)
    logs = L.usable_logs(L.read_logs(spark, folder, "*.txt"))
    flat = L.flatten(logs, with_config=True)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the last key is in no log
        chosen = flat.where(predicate(KEY_FILTER, flat.columns, config_keys(logs)))
    return chosen.select("run_id", "round", "partitioner_name")


def mean_std_by_round(spark, sf):
    return _rounded(
        R.mean_std_by_round(D.metrics(spark, sf), ["scenario_name"], CURVE_METRICS), "scenario_name", "round", "metric"
    )


def overfit_curve(spark, sf):
    curve = R.overfit_curve(D.metrics(spark, sf).where("personalization"))
    return _rounded(curve, "scenario_name", "round")


def personalised_flag(spark, sf):
    personal = F.lower("scenario_name").contains("personalized") | F.col("personalization")
    return D.metrics(spark, sf).groupBy("strategy_name", "partitioner_name").agg(
        F.bool_or(personal).cast("int").alias("has_personalised")
    )


def baseline_no_attack(spark, sf):
    attacked = F.col("attack_name") != "none"
    rows = R.attach_baseline(D.metrics(spark, sf), "client_evaluation_accuracy", attacked, True)
    return _baseline_columns(rows)


def baseline_full_participation(spark, sf):
    partial = (F.col("attack_name") == "none") & (F.col("fraction_train") < 1.0)
    rows = R.attach_baseline(D.metrics(spark, sf), "client_evaluation_accuracy", partial, False)
    return _baseline_columns(rows)


def _baseline_columns(rows):
    return _rounded(rows, "strategy_name", "attack_name", "partitioner_name", "round")


def run_counts(spark, sf):
    """Runs and scenarios in each selection; a single run has no deviation."""
    return (
        D.metrics(spark, sf)
        .groupBy("attack_name", "partitioner_name", "strategy_name")
        .agg(F.count_distinct("run_id").alias("n_runs"), F.count_distinct("scenario_name").alias("n_scenarios"))
        .withColumn("single_run", (F.col("n_runs") < 2).cast("int"))
    )


def strategy_order(spark, sf):
    names = _clean_config(spark, sf).groupBy("strategy_name").agg(F.count("*").alias("n_runs"))
    return names.withColumn("place", R.strategy_position(F.col("strategy_name"))).orderBy("place", "strategy_name")


def series_labels(spark, sf):
    """Label of every attacked run in its attack report and in the attacker-count report."""
    by_strategy = next(r for r in SERIES if r.name == "fig_35_attack_backdoor_iid_full")
    by_count = next(r for r in SERIES if r.name == "fig_attack_backdoor_1_vs_2_clients")
    runs = D.metrics(spark, sf).groupBy("run_id", "strategy_name", "num_malicious_clients").agg(F.count("*").alias("n_rounds"))
    return runs.select(
        "run_id", F.expr(R.series_label(by_strategy)).alias("strategy_label"),
        F.expr(R.series_label(by_count)).alias("count_label"), "n_rounds",
    )


def _series(spark, sf, reports):
    rows = R.report_series(D.metrics(spark, sf), reports).withColumn("is_baseline", F.col("is_baseline").cast("int"))
    return _rounded(rows, "report", "series", "is_baseline", "round", "metric")


def report_series(spark, sf):
    return _series(spark, sf, SERIES)


def attack_count_series(spark, sf):
    return _series(spark, sf, [r for r in SERIES if r.series_key == "num_malicious_clients"])


def labelflip_grid(spark, sf):
    return _series(spark, sf, FLIPS)


def round40_table(spark, sf):
    """All tables at the last round of the derived logs."""
    return R.table_cells(D.metrics(spark, sf), TABLES, D.TARGET_ROUND)


def report_markdown(spark, sf):
    return R.markdown_lines(R.table_cells(D.metrics(spark, sf), TABLES, D.TARGET_ROUND), TABLES)


QUERIES = {
    f.__name__: f
    for f in (
        filter_map, filter_isclose, filter_config_key, mean_std_by_round, overfit_curve, personalised_flag, baseline_no_attack,
        baseline_full_participation, run_counts, strategy_order, series_labels, report_series, attack_count_series,
        labelflip_grid, round40_table, report_markdown,
    )
}


# --- SQL ------------------------------------------------------------------------------------

def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)


def sql_filter(filters: dict) -> str:
    """A filter map written out for the SQL side."""
    parts = []
    for key, value in filters.items():
        name = key.replace("-", "_")
        number = name in ("fraction_train", "dirichlet_alpha", "num_malicious_clients")
        if isinstance(value, list):
            empty = None if number else False if name == "personalization" else "none"
            values = [empty if v in (None, "") else v for v in value]
            listed = f"{name} IN ({', '.join(_literal(v) for v in values if v is not None)})"
            parts.append(f"({listed} OR {name} IS NULL)" if None in values else listed)
        elif isinstance(value, float):
            parts.append(f"abs({name} - {_literal(value)}) <= 1e-8 + 1e-5 * abs({_literal(value)})")
        else:
            parts.append(f"{name} = {_literal(value)}")
    return " AND ".join(parts) or "true"


def _sql_series(reports) -> str:
    """Union of one selection per report and baseline, then the grouped statistics."""
    picks = []
    for r in reports:
        key = r.series_key.replace("-", "_")
        label = f"{key}::VARCHAR"
        if r.legend:
            label = f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in r.legend.items()) + f" ELSE {label} END"
        if r.is_attack:
            label = f"CASE WHEN {label} = 'FedAvg' THEN 'FedAvg (Under Attack)' ELSE {label} END"
        metrics = ", ".join(CURVE_METRICS)
        head = f"SELECT '{r.name}' AS report, '{r.layout}' AS layout"
        picks.append(f"{head}, {label} AS series, 0 AS is_baseline, round, scenario_name, personalization, {metrics} FROM metrics WHERE {sql_filter(r.filters)}")
        if r.baseline_filters() is not None:
            picks.append(f"{head}, '{r.baseline_name}' AS series, 1 AS is_baseline, round, scenario_name, personalization, {metrics} FROM metrics WHERE {sql_filter(r.baseline_filters())}")
    stacked = " UNION ALL ".join(
        f"SELECT report, layout, series, is_baseline, round, '{m}' AS metric, {m} AS v FROM picked WHERE {m} IS NOT NULL"
        for m in CURVE_METRICS
    )
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    return f"""WITH {S.METRICS}, picked AS ({" UNION ALL ".join(picks)}),
      personal AS (SELECT report, bool_or(is_baseline = 0 AND (personalization OR lower(scenario_name) LIKE '%personalized%')) AS p
        FROM picked GROUP BY report),
      stacked AS ({stacked}),
      stats AS (SELECT report, layout, series, is_baseline, round, metric, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s
        FROM stacked GROUP BY ALL)
      SELECT report, series, is_baseline, round, metric, round(m, 6) AS mean, round(s, 6) AS std,
        round(greatest(m - s, 0), 6) AS lo, round(least(m + s, 1.05), 6) AS hi
      FROM stats JOIN personal USING (report)
      WHERE (layout = 'standard' AND metric IN ({listed(P.LAYOUTS["standard"])})
             AND NOT (p AND metric IN ({listed(P.SERVER_METRICS)})))
         OR (layout = 'backdoor' AND metric IN ({listed(P.LAYOUTS["backdoor"])}))"""


def _sql_cells() -> str:
    """Common expressions up to ``table_cells``: the text of every table."""
    picks = " UNION ALL ".join(
        f"SELECT {t.number} AS number, '{t.kind}' AS kind, '{t.index}' AS index, {t.index.replace('-', '_')} AS key, "
        + ", ".join(f"CASE WHEN round = {D.TARGET_ROUND} THEN {c} END AS {c}" for c in P.TABLE_COLUMNS.values())
        + f" FROM metrics WHERE {sql_filter(t.filters)}"
        for t in TABLES
    )
    order = "[" + ", ".join(f"'{s}'" for s in P.STRATEGY_ORDER) + "]"
    cell = lambda name, c: (
        f"CASE WHEN kind IN ({', '.join(repr(k) for k, v in P.TABLE_KINDS.items() if name in v)}) "
        f"AND sum(count({c})) OVER (PARTITION BY number) > 0 THEN CASE WHEN avg({c}) IS NULL THEN 'N/A' ELSE "
        f"printf('%.3f', avg({c})) || ' ± ' || printf('%.3f', coalesce(stddev_samp({c}), 0)) END END AS {name}"
    )
    return f"""WITH {S.METRICS}, picked AS ({picks}),
      table_cells AS (SELECT number, index,
        CASE WHEN index = 'strategy-name' THEN coalesce(list_position({order}, key), {len(P.STRATEGY_ORDER) + 1}) ELSE 0 END::INT AS place,
        key, {", ".join(cell(n, c) for n, c in P.TABLE_COLUMNS.items())}
        FROM picked GROUP BY number, kind, index, key)"""


def _sql_markdown() -> str:
    heads = {"server_accuracy": "Server Accuracy", "server_f1_score": "Server F1 Score",
             "client_accuracy": "Client Accuracy", "client_f1_score": "Client F1 Score", "client_asr": "Client ASR"}
    values = ", ".join(f"({t.number}, '{t.heading}')" for t in TABLES)
    width = ", ".join(f"greatest({len(h) + 2}, max(length({n}))) AS w_{n}" for n, h in heads.items())
    used = ", ".join(f"count({n}) > 0 AS u_{n}" for n in heads)
    joined = lambda first, text: "'| ' || rpad(" + first + ", w_key::INT, ' ') || " + " || ".join(
        f"CASE WHEN u_{n} THEN ' | ' || rpad({text(n)}, w_{n}::INT, ' ') ELSE '' END" for n in heads
    ) + " || ' |'"
    name = "CASE index WHEN 'strategy-name' THEN 'Strategy Name' ELSE 'Scenario Name' END"
    rule = "'|:' || repeat('-', w_key::INT + 1) || " + " || ".join(
        f"CASE WHEN u_{n} THEN '|:' || repeat('-', w_{n}::INT + 1) ELSE '' END" for n in heads
    ) + " || '|'"
    return f"""{_sql_cells()}, headings(number, heading) AS (VALUES {values}),
      layout AS (SELECT number, index, greatest(15, max(length(key))) AS w_key, {width}, {used} FROM table_cells GROUP BY number, index
        HAVING {" + ".join(f"count({n})" for n in heads)} > 0)
      SELECT number, 0 AS line_no, heading AS line FROM headings
      UNION ALL SELECT number, 1, '' FROM headings
      UNION ALL SELECT number, 2, '{P.NO_DATA}' FROM headings WHERE number NOT IN (SELECT number FROM layout)
      UNION ALL SELECT number, 2, {joined(name, lambda n: f"'{heads[n]}'")} FROM layout
      UNION ALL SELECT number, 3, {rule} FROM layout
      UNION ALL SELECT c.number, 3 + (row_number() OVER (PARTITION BY c.number ORDER BY place, key))::INT,
        {joined("key", lambda n: f"c.{n}")} FROM table_cells c JOIN layout l ON c.number = l.number"""


_CONFIG = f"""WITH {S.RAW_CONFIG}, typed AS (SELECT run_id, strategy_name,
    CASE WHEN proximal_mu IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(proximal_mu AS DOUBLE) END AS proximal_mu,
    coalesce(nullif(attack_name, ''), 'none') AS attack_name, coalesce(personalization, false) AS personalization,
    CASE WHEN fraction_train IS NULL THEN 1.0::DOUBLE ELSE TRY_CAST(fraction_train AS DOUBLE) END AS fraction_train,
    CASE WHEN partitioner_name = 'iid' THEN coalesce(dirichlet_alpha, -1.0) ELSE dirichlet_alpha END AS dirichlet_alpha
    FROM raw_config), config AS (SELECT * REPLACE ({S.CANONICAL} AS strategy_name) FROM typed)"""
_ALPHA = "round(dirichlet_alpha, 6)"
_CLEAN = "attack_name = 'none' AND strategy_name = 'FedAvg' AND NOT personalization"
_STACK = " UNION ALL ".join(
    f"SELECT scenario_name, round, '{m}' AS metric, {m} AS v FROM metrics WHERE {m} IS NOT NULL" for m in CURVE_METRICS
)
_LOSSES = ", ".join(
    f"round(avg({c}), 6) AS {s}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {s}_std, "
    f"round(greatest(avg({c}) - coalesce(stddev_samp({c}), 0), 0), 6) AS {s}_lo, "
    f"round(avg({c}) + coalesce(stddev_samp({c}), 0), 6) AS {s}_hi"
    for s, c in (("train", "training_loss"), ("val", "client_evaluation_loss"))
)

SQL = {
    "filter_map": f"{_CONFIG} SELECT run_id, strategy_name, attack_name FROM config WHERE {sql_filter(MIXED_FILTER)}",
    "filter_config_key": f"""WITH {S.METRICS} SELECT run_id, round, partitioner_name FROM metrics
        WHERE strategy_name = 'FedAvgM' AND fraction_train = 1.0""",
    "filter_isclose": f"{_CONFIG} SELECT run_id, fraction_train, dirichlet_alpha FROM config WHERE {sql_filter(CLOSE_FILTER)}",
    "mean_std_by_round": f"""WITH {S.METRICS}, stacked AS ({_STACK}), stats AS (SELECT scenario_name, round, metric, avg(v) AS m,
        coalesce(stddev_samp(v), 0) AS s FROM stacked GROUP BY ALL)
        SELECT scenario_name, round, metric, round(m, 6) AS mean, round(s, 6) AS std, round(greatest(m - s, 0), 6) AS lo,
        round(least(m + s, 1.05), 6) AS hi FROM stats""",
    "overfit_curve": f"""WITH {S.METRICS} SELECT scenario_name, round, {_LOSSES} FROM metrics WHERE personalization
        AND training_loss IS NOT NULL AND client_evaluation_loss IS NOT NULL GROUP BY scenario_name, round""",
    "personalised_flag": f"""WITH {S.METRICS} SELECT strategy_name, partitioner_name,
        bool_or(lower(scenario_name) LIKE '%personalized%' OR personalization)::INT AS has_personalised
        FROM metrics GROUP BY ALL""",
    "baseline_no_attack": f"""WITH {S.METRICS}, a AS (SELECT strategy_name, attack_name, partitioner_name, {_ALPHA} AS alpha_key,
          fraction_train, round, avg(client_evaluation_accuracy) AS m FROM metrics WHERE attack_name <> 'none' GROUP BY ALL),
        b AS (SELECT partitioner_name, {_ALPHA} AS alpha_key, fraction_train, round, avg(client_evaluation_accuracy) AS bm
          FROM metrics WHERE {_CLEAN} GROUP BY ALL)
        SELECT a.strategy_name, a.attack_name, a.partitioner_name, a.alpha_key, a.fraction_train, a.round,
          round(m, 6) AS mean, round(bm, 6) AS baseline_mean FROM a JOIN b ON a.partitioner_name = b.partitioner_name
          AND a.alpha_key IS NOT DISTINCT FROM b.alpha_key AND a.fraction_train = b.fraction_train AND a.round = b.round""",
    "baseline_full_participation": f"""WITH {S.METRICS}, a AS (SELECT strategy_name, attack_name, partitioner_name, {_ALPHA} AS alpha_key,
          fraction_train, round, avg(client_evaluation_accuracy) AS m FROM metrics
          WHERE attack_name = 'none' AND fraction_train < 1 GROUP BY ALL),
        b AS (SELECT partitioner_name, {_ALPHA} AS alpha_key, round, avg(client_evaluation_accuracy) AS bm
          FROM metrics WHERE {_CLEAN} AND fraction_train = 1 GROUP BY ALL)
        SELECT a.strategy_name, a.attack_name, a.partitioner_name, a.alpha_key, a.fraction_train, a.round,
          round(m, 6) AS mean, round(bm, 6) AS baseline_mean FROM a JOIN b ON a.partitioner_name = b.partitioner_name
          AND a.alpha_key IS NOT DISTINCT FROM b.alpha_key AND a.round = b.round""",
    "run_counts": f"""WITH {S.METRICS} SELECT attack_name, partitioner_name, strategy_name, count(DISTINCT run_id) AS n_runs,
        count(DISTINCT scenario_name) AS n_scenarios, (count(DISTINCT run_id) < 2)::INT AS single_run FROM metrics GROUP BY ALL""",
    "strategy_order": f"""{_CONFIG} SELECT strategy_name, count(*) AS n_runs,
        coalesce(list_position([{", ".join(repr(s) for s in P.STRATEGY_ORDER)}], strategy_name), {len(P.STRATEGY_ORDER) + 1})::INT AS place
        FROM config GROUP BY strategy_name""",
    "series_labels": f"""WITH {S.METRICS} SELECT run_id,
        CASE WHEN strategy_name = 'FedAvg' THEN 'FedAvg (Under Attack)' ELSE strategy_name END AS strategy_label,
        CASE num_malicious_clients WHEN 1 THEN '1 Malicious Client' WHEN 2 THEN '2 Malicious Clients'
          ELSE num_malicious_clients::VARCHAR END AS count_label, count(*) AS n_rounds FROM metrics GROUP BY ALL""",
    "report_series": _sql_series(SERIES),
    "attack_count_series": _sql_series([r for r in SERIES if r.series_key == "num_malicious_clients"]),
    "labelflip_grid": _sql_series(FLIPS),
    "round40_table": f"{_sql_cells()} SELECT * FROM table_cells",
    "report_markdown": _sql_markdown(),
}
