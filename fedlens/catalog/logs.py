"""Run logs: reading, cleaning, growing, and the run manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedlens.functions.text import mean_std_text
from fedlens.operators import cleaning as K
from fedlens.operators.metrics import aggregate_eval, aggregate_train
from fedlens.plans import scenarios as N
from fedlens.session import workspace
from fedlens.sources import derived as D
from fedlens.sources import derived_sql as S
from fedlens.sources import runlog as L
from fedlens.sources import runlog_store as V
from fedlens.sources.tables import table

GLOB = "*.txt"
FLAT = ["run_id", *D.CONFIG_COLUMNS, "round", *D.METRIC_COLUMNS]
METRICS = [c for c in D.METRIC_COLUMNS if not c.endswith("num_examples")]
COUNTS = [c for c in D.METRIC_COLUMNS if c.endswith("num_examples")]


def _flat(df):
    """Flat log with booleans as 0/1 and metrics to 6 decimals."""
    rounded = {c: F.round(c, 6) for c in METRICS}
    return df.select(*FLAT).withColumns({**rounded, "personalization": F.col("personalization").cast("int")})


def _log_folder(spark, sf):
    """Writes the derived runs as documents, with the irregular files every archive holds.

    Folder ``a`` has the runs; ``b`` has a second copy of each, a cut-off file, a file without a
    scenario and one without rounds per personalised run.
    """
    whole = "to_json(struct(config, rounds))"
    files = [
        f"struct('a' AS copy, run_id, {whole} AS value)",
        f"struct('b' AS copy, run_id, {whole} AS value)",
    ]
    irregular = {
        "cut_": f"left({whole}, 400)",
        "anonymous_": "to_json(struct(rounds))",
        "empty_": "to_json(struct(config, array() AS rounds))",
    }
    files += [
        f"CASE WHEN config.personalization = 'true' THEN struct('b' AS copy, concat('{prefix}', run_id) AS run_id, {text} AS value) END"
        for prefix, text in irregular.items()
    ]
    docs = L.log_documents(D.raw_metrics(spark, sf)).select(F.expr(f"inline(array_compact(array({', '.join(files)})))"))
    folder = workspace(spark, "run-logs")
    L.write_documents(docs, folder)
    return folder


def scan_runlog(spark, sf):
    return _flat(L.load_metrics(spark, _log_folder(spark, sf), GLOB))


def runlog_dedup(spark, sf):
    kept = L.usable_logs(L.read_logs(spark, _log_folder(spark, sf), GLOB))
    return kept.select("run_id", F.regexp_extract("file_path", "copy=([a-z]+)/", 1).alias("copy"), F.size("rounds").alias("n_rounds"))


def runlog_rejects(spark, sf):
    rejected = L.rejected_logs(L.read_logs(spark, _log_folder(spark, sf), GLOB))
    return rejected.select("run_id", F.regexp_extract("file_path", "copy=([a-z]+)/", 1).alias("copy"), "reason")


def runlog_flat(spark, sf):
    flat = L.flatten(L.log_documents(D.raw_metrics(spark, sf)))
    return _flat(flat)


def _arrivals(spark, sf):
    """Every event is one sending of its run's round."""
    return table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(150)).alias("run_id"),
        F.dayofmonth("ts").alias("round"),
        (F.col("value") / 503).alias("accuracy"),
        "event_type", "ts", "event_id",
    )


def runlog_upsert(spark, sf):
    latest = L.upsert_rounds(_arrivals(spark, sf), F.struct("ts", "event_id"))
    return latest.select("run_id", "round", F.round("accuracy", 6).alias("accuracy"), "event_type", "event_id")


def _sendings(spark, sf, rest):
    """Documents of the rounds sent with every other event: each run's rounds once, the latest sending of each."""
    sent = _arrivals(spark, sf).where(F.pmod("event_id", F.lit(2)) == rest)
    latest = L.upsert_rounds(sent, F.struct("ts", "event_id")).withColumnRenamed("run_id", "run_no")
    blank = [F.lit(None).cast("double").alias(c) for c in D.METRIC_COLUMNS if not c.startswith("client_evaluation_a")]
    flat = latest.select(
        F.concat(F.lit("run_"), F.col("run_no").cast("string")).alias("run_id"), *D.run_configs(F.col("run_no")), "round",
        F.col("accuracy").alias("client_evaluation_accuracy"), *blank,
    )
    return L.log_documents(flat)


def runlog_document_upsert(spark, sf):
    """Documents that grow in two sendings, the second repeated; rounds by their place in the document, beside its summary."""
    folder = workspace(spark, "document-store")
    for rest in (0, 1, 1):
        V.merge_documents(spark, folder, _sendings(spark, sf, rest))
    docs = V.read_documents(spark, folder)
    accuracy = F.col("r.client_evaluation.accuracy").cast("double")
    rows = docs.select("run_id", "config.scenario_name", "summary", F.posexplode("rounds").alias("place", "r"))
    return rows.select(
        "run_id", "scenario_name", "place", F.col("r.round").alias("round"), F.round(accuracy, 6).alias("accuracy"),
        "summary.total_rounds_completed", F.round("summary.best_client_accuracy", 6).alias("best_client_accuracy"),
        F.round("summary.final_client_accuracy", 6).alias("final_client_accuracy"), "summary.final_server_accuracy",
    )


def run_summary(spark, sf):
    summary = L.run_summary(D.metrics(spark, sf))
    return summary.select(
        "run_id", "total_rounds_completed", *[F.round(c, 6).alias(c) for c in summary.columns if c.startswith(("best", "final"))]
    )


def config_defaults(spark, sf):
    return K.config_defaults(D.raw_config(spark, sf)).select(
        "run_id", "attack_name", F.col("personalization").cast("int").alias("personalization"), "fraction_train",
        "dirichlet_alpha", "strategy_name", "proximal_mu", "partitioner_name",
    )


def coerce_numeric(spark, sf):
    return D.raw_config(spark, sf).select(
        "run_id",
        K.number_or_null("proximal_mu").alias("proximal_mu"),
        K.number_or_null("fraction_train").alias("fraction_train"),
        K.count_or_zero("num_examples").alias("num_examples"),
    )


def canonical_strategy(spark, sf):
    config = K.config_defaults(D.raw_config(spark, sf))
    return config.select("run_id", K.canonical_strategy("strategy_name", "proximal_mu").alias("strategy_name"))


def malicious_count(spark, sf):
    return D.raw_config(spark, sf).select("run_id", K.list_length("malicious_clients_ids").alias("num_malicious_clients"))


def round_metrics(spark, sf):
    """Train and eval metrics of each round as they are written to the log."""
    replies = D.replies(spark, sf)
    train = aggregate_train(replies).withColumnRenamed("num_examples", "train_examples")
    return K.round_metrics(train.join(aggregate_eval(replies), "round"))


def format_mean_std(spark, sf):
    """Display text of the accuracy of every scenario and round."""
    cells = D.metrics(spark, sf).groupBy("scenario_name", "round").agg(
        F.avg("server_evaluation_accuracy").alias("m"), F.stddev_samp("server_evaluation_accuracy").alias("s")
    )
    return cells.select("scenario_name", "round", mean_std_text(F.col("m"), F.col("s")).alias("cell"))


def run_manifest(spark, sf):
    """Every customer row as a scenario, overlaid on the base configuration and repeated."""
    text = {
        "strategy-name": F.col("strategy_name"),
        "partitioner-name": F.col("partitioner_name"),
        "dirichlet-alpha": F.coalesce(F.col("dirichlet_alpha"), F.lit(0.0)).cast("string"),
    }
    overrides = F.create_map(*[v for k, c in text.items() for v in (F.lit(k), c)])
    scenarios = D.raw_config(spark, sf).select(F.col("run_id").alias("scenario_id"), overrides.alias("overrides"))
    value = lambda key: F.try_element_at("config", F.lit(key))
    return N.run_manifest(scenarios).select(
        "scenario_id", "repetition", "seed",
        value("strategy-name").alias("strategy_name"),
        value("partitioner-name").alias("partitioner_name"),
        value("dirichlet-alpha").cast("double").alias("dirichlet_alpha"),
        value("seed").cast("int").alias("config_seed"),
        value("lr").cast("double").alias("lr"),
        F.size("config").alias("n_keys"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        scan_runlog, runlog_dedup, runlog_rejects, runlog_flat, runlog_upsert, runlog_document_upsert, run_summary, config_defaults,
        coerce_numeric, canonical_strategy, malicious_count, round_metrics, format_mean_std, run_manifest,
    )
}

_FLAT_COLS = ", ".join(["run_id", *[c for c in D.CONFIG_COLUMNS if c != "personalization"], "personalization::INT AS personalization", "round"])
_FLAT_METRICS = ", ".join([f"round({c}, 6) AS {c}" for c in METRICS] + [f"coalesce({c}, 0) AS {c}" for c in COUNTS])
_MU = "CASE WHEN proximal_mu IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(proximal_mu AS DOUBLE) END"
_SUMMARY = {**L.SUMMARY_METRICS, "client_asr": "client_evaluation_backdoor_asr"}
_WEIGHTED = lambda c, d: f"round(coalesce(sum(num_examples * {c}) / nullif(sum(num_examples), 0), 0), {d}) AS {c}"

SQL = {
    "scan_runlog": f"WITH {S.METRICS} SELECT {_FLAT_COLS}, {_FLAT_METRICS} FROM metrics",
    "runlog_dedup": f"WITH {S.METRICS} SELECT run_id, 'a' AS copy, count(*)::INT AS n_rounds FROM metrics GROUP BY run_id",
    "runlog_rejects": f"""WITH {S.METRICS}, runs AS (SELECT DISTINCT run_id, personalization FROM metrics)
        SELECT run_id, 'b' AS copy, 'duplicate' AS reason FROM runs
        UNION ALL SELECT 'cut_' || run_id, 'b', 'corrupt' FROM runs WHERE personalization
        UNION ALL SELECT 'anonymous_' || run_id, 'b', 'no scenario' FROM runs WHERE personalization
        UNION ALL SELECT 'empty_' || run_id, 'b', 'no rounds' FROM runs WHERE personalization""",
    "runlog_flat": f"WITH {S.METRICS} SELECT {_FLAT_COLS}, {_FLAT_METRICS} FROM raw_metrics",
    "runlog_upsert": """WITH ranked AS (SELECT user_id % 150 AS run_id, day(ts)::INT AS round, value / 503 AS accuracy, event_type, event_id,
          row_number() OVER (PARTITION BY user_id % 150, day(ts) ORDER BY ts DESC, event_id DESC) AS r FROM events)
        SELECT run_id, round, round(accuracy, 6) AS accuracy, event_type, event_id FROM ranked WHERE r = 1""",
    "runlog_document_upsert": f"""WITH {S.RAW_METRICS}, sent AS (
          SELECT user_id % 150 AS run_no, day(ts)::INT AS round, value / 503 AS accuracy,
            row_number() OVER (PARTITION BY user_id % 150, day(ts) ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS r FROM events),
        names AS (SELECT DISTINCT run_id, scenario_name FROM raw_metrics)
        SELECT 'run_' || run_no AS run_id, scenario_name, (row_number() OVER w - 1)::INT AS place, round, round(accuracy, 6) AS accuracy,
          (count(*) OVER a)::INT AS total_rounds_completed, round(max(accuracy) OVER a, 6) AS best_client_accuracy,
          round(last_value(accuracy) OVER a, 6) AS final_client_accuracy, 0.0 AS final_server_accuracy
        FROM sent JOIN names ON names.run_id = 'run_' || run_no WHERE r = 1
        WINDOW w AS (PARTITION BY run_no ORDER BY round),
          a AS (PARTITION BY run_no ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "run_summary": f"""WITH {S.METRICS} SELECT run_id, count(*) AS total_rounds_completed,
        {", ".join(f"round(max(coalesce({c}, 0)), 6) AS best_{n}" for n, c in L.SUMMARY_METRICS.items())},
        {", ".join(f"round(arg_max(coalesce({c}, 0), round), 6) AS final_{n}" for n, c in _SUMMARY.items())}
        FROM metrics GROUP BY run_id""",
    "config_defaults": f"""WITH {S.RAW_CONFIG} SELECT run_id, coalesce(nullif(attack_name, ''), 'none') AS attack_name,
        coalesce(personalization, false)::INT AS personalization,
        CASE WHEN fraction_train IS NULL THEN 1.0::DOUBLE ELSE TRY_CAST(fraction_train AS DOUBLE) END AS fraction_train,
        CASE WHEN partitioner_name = 'iid' THEN coalesce(dirichlet_alpha, -1.0) ELSE dirichlet_alpha END AS dirichlet_alpha,
        strategy_name, {_MU} AS proximal_mu, partitioner_name FROM raw_config""",
    "coerce_numeric": f"""WITH {S.RAW_CONFIG} SELECT run_id, TRY_CAST(proximal_mu AS DOUBLE) AS proximal_mu,
        TRY_CAST(fraction_train AS DOUBLE) AS fraction_train, coalesce(TRY_CAST(num_examples AS BIGINT), 0) AS num_examples FROM raw_config""",
    "canonical_strategy": f"""WITH {S.RAW_CONFIG}, typed AS (SELECT run_id, strategy_name, {_MU} AS proximal_mu FROM raw_config)
        SELECT run_id, {S.CANONICAL} AS strategy_name FROM typed""",
    "malicious_count": f"""WITH {S.RAW_CONFIG} SELECT run_id, coalesce(len(malicious_clients_ids), 0)::INT AS num_malicious_clients
        FROM raw_config""",
    "round_metrics": f"""WITH {S.REPLIES} SELECT round, {_WEIGHTED("train_loss", 6)}, sum(num_examples)::BIGINT AS train_examples,
        {_WEIGHTED("eval_loss", 6)}, {_WEIGHTED("eval_acc", 4)}, {_WEIGHTED("backdoor_asr", 4)},
        sum(num_examples)::BIGINT AS num_examples FROM replies GROUP BY round""",
    "format_mean_std": f"""WITH {S.METRICS} SELECT scenario_name, round,
        CASE WHEN avg(server_evaluation_accuracy) IS NULL THEN 'N/A' ELSE
          printf('%.3f', avg(server_evaluation_accuracy)) || ' ± ' || printf('%.3f', coalesce(stddev_samp(server_evaluation_accuracy), 0))
        END AS cell FROM metrics GROUP BY scenario_name, round""",
    "run_manifest": f"""WITH {S.RAW_CONFIG} SELECT run_id AS scenario_id, rep::INT AS repetition, (42 + rep)::INT AS seed,
        strategy_name, partitioner_name, coalesce(dirichlet_alpha, 0.0) AS dirichlet_alpha, (42 + rep)::INT AS config_seed,
        0.01::DOUBLE AS lr, {len(N.BASE_CONFIG)}::INT AS n_keys FROM raw_config CROSS JOIN (SELECT unnest(range(15)) AS rep)""",
}
