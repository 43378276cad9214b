"""Partitions, scores, reply metrics and confusion matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedlens.operators import metrics as M
from fedlens.operators import partition as P
from fedlens.operators.poison import is_malicious, stamp_trigger
from fedlens.sources import derived as D
from fedlens.sources import derived_sql as S
from fedlens.sources.tables import table

ROUND6 = lambda c: F.round(c, 6).alias(c)


def _rounded(df, *keys, counts=()):
    """Keys and counts as they are, every other column to 6 decimals."""
    return df.select(*keys, *[ROUND6(c) for c in df.columns if c not in keys and c not in counts], *counts)


def partition_iid(spark, sf):
    return P.assign_iid(D.samples(spark, sf), D.N_CLIENTS, D.SEED).select("sample_id", "client_id")


def partition_iid_balanced(spark, sf):
    return P.assign_iid_balanced(D.samples(spark, sf), D.N_CLIENTS, D.SEED).select("sample_id", "client_id")


def train_val_split(spark, sf):
    return P.split_train_val(D.parts(spark, sf), 0.2).select("sample_id", "client_id", "split")


def train_val_split_exact(spark, sf):
    return P.split_train_val_exact(D.parts(spark, sf), 0.2).select("sample_id", "client_id", "split")


def shares():
    return P.dirichlet_shares(D.N_CLASSES, D.N_CLIENTS, 0.1, D.SEED)


def partition_dirichlet(spark, sf):
    return P.assign_dirichlet(D.samples(spark, sf), shares(), D.SEED).select("sample_id", "label", "client_id")


def partition_shares(spark, sf):
    """Rows of every client where customers are the clients and hold weighted shares of nine classes.

    Rows of the tenth class have no shares: they are counted under client -1.
    """
    label = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("label")
    weights = table(spark, sf, "customer").select(F.col("c_custkey").alias("client_id"), label)
    weights = weights.withColumn("weight", (F.pmod(F.col("client_id") * (F.col("label") + 3), F.lit(97)) + 1).cast("double"))
    shares, rows = P.share_table(weights), D.samples(spark, sf)
    held = P.assign_dirichlet(rows, shares, D.SEED).groupBy("client_id").agg(F.count("*").alias("n_rows"))
    lost = P.dirichlet_rejects(rows, shares, D.SEED).agg(F.lit(-1).alias("client_id"), F.count("*").alias("n_rows"))
    return held.union(lost)


def label_distribution(spark, sf):
    """Rows per client and label under the uniform and the skewed partition."""
    kinds = {
        "iid": P.assign_iid(D.samples(spark, sf), D.N_CLIENTS, D.SEED),
        "dirichlet": P.assign_dirichlet(D.samples(spark, sf), shares(), D.SEED),
    }
    frames = [P.label_distribution(df, D.N_CLASSES).withColumn("partitioner", F.lit(k)) for k, df in kinds.items()]
    return frames[0].unionByName(frames[1])


def sample_clients(spark, sf):
    """Clients that replied in each round, thinned to a fraction of 0.8."""
    clients = D.replies(spark, sf).select("round", "client_id").distinct()
    return P.sample_clients(clients, 0.8, D.N_CLIENTS, D.SEED)


def malicious_flag(spark, sf):
    return D.replies(spark, sf).groupBy("client_id").agg(F.count("*").alias("n_replies")).withColumn(
        "is_malicious", is_malicious(D.MALICIOUS).cast("int")
    )


def predict_labels(spark, sf):
    return D.predictions(spark, sf).select("sample_id", "client_id", "label", "predicted", ROUND6("loss"))


def confusion_matrix(spark, sf):
    return M.dense_confusion(M.confusion_cells(D.predictions(spark, sf), ["client_id"]), ["client_id"])


def confusion_matrix_global(spark, sf):
    return M.confusion_cells(D.predictions(spark, sf))


def per_class_f1(spark, sf):
    return _rounded(M.per_class_scores(M.confusion_cells(D.predictions(spark, sf))), "cls")


def macro_f1(spark, sf):
    """Macro F1 of every client and of all clients together, from one set of cells."""
    cells = M.confusion_cells(D.predictions(spark, sf), ["client_id"])
    scope = F.explode(F.array(F.concat(F.lit("client_"), F.col("client_id").cast("string")), F.lit("all")))
    scoped = cells.withColumn("scope", scope).groupBy("scope", "actual", "predicted").agg(F.sum("n").alias("n"))
    return _rounded(M.macro_f1(scoped, ["scope"]), "scope")


def client_report(spark, sf):
    """Loss, accuracy and macro F1 of every client and of all clients together."""
    cells = (
        D.predictions(spark, sf)
        .groupBy("client_id", F.col("label").alias("actual"), "predicted")
        .agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))
    )
    scope = F.explode(F.array(F.concat(F.lit("client_"), F.col("client_id").cast("string")), F.lit("all")))
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = (
        cells.withColumn("scope", scope)
        .groupBy("scope")
        .agg(
            (F.sum("loss") / F.sum("n")).alias("eval_loss"),
            (hits / F.sum("n")).alias("eval_acc"),
            F.sum("n").alias("num_examples"),
            M.class_sums(D.N_CLASSES).alias("classes"),
        )
        .select("scope", "eval_loss", "eval_acc", M.mean_f1(F.col("classes")).alias("macro_f1"), "num_examples")
    )
    return _rounded(rows, "scope", counts=["num_examples"])


def eval_scores(spark, sf):
    scored = P.split_train_val(D.predictions(spark, sf), 0.2)
    return _rounded(M.eval_scores(scored, ["client_id", "split"]), "client_id", "split", counts=["num_examples"])


def attack_success_rate(spark, sf):
    """Success of the trigger on every client's rows: stamped, scored with the same head."""
    triggered = D.parts(spark, sf).withColumn("features", stamp_trigger(F.col("features"), D.SIDE))
    return (
        D.predictions(spark, sf, triggered)
        .groupBy("client_id")
        .agg(F.round(M.attack_success(D.TARGET_CLASS), 6).alias("backdoor_asr"), F.count("*").alias("num_examples"))
    )


def agg_train_metrics(spark, sf):
    return _rounded(M.aggregate_train(D.replies(spark, sf)), "round", counts=["num_examples"])


def agg_eval_metrics(spark, sf):
    return _rounded(M.aggregate_eval(D.replies(spark, sf)), "round", counts=["num_examples"])


QUERIES = {
    f.__name__: f
    for f in (
        partition_iid, partition_iid_balanced, train_val_split, train_val_split_exact, partition_dirichlet, partition_shares,
        label_distribution, sample_clients, malicious_flag, predict_labels, confusion_matrix,
        confusion_matrix_global, per_class_f1, macro_f1, client_report, eval_scores, attack_success_rate,
        agg_train_metrics, agg_eval_metrics,
    )
}

_PRED = "WITH " + S.PREDICTION_CTES
_SPLIT = f"CASE WHEN {S.uniform(42, 'split', 'sample_id')} < 0.2 THEN 'val' ELSE 'train' END"
_INTERVALS = "intervals(label, client_id, lo, hi) AS (VALUES " + ", ".join(
    f"({label}, {client}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for label, client, lo, hi in P.share_intervals(shares())
) + ")"
_DIRICHLET = f"""{_INTERVALS}, skewed AS (
  SELECT s.sample_id, s.label, i.client_id FROM samples s JOIN intervals i ON s.label = i.label
   AND {S.uniform(42, 'dirichlet', 's.sample_id')} >= i.lo AND {S.uniform(42, 'dirichlet', 's.sample_id')} < i.hi)"""
_LABEL_COLS = ", ".join(f"count(*) FILTER (label = {c}) AS label_{c}" for c in range(10))
_DOMAIN = "(SELECT unnest(range(10))::INT AS cls)"
_F1 = f"""cells AS (SELECT scope, label AS actual, predicted, count(*) AS n FROM (
    SELECT 'client_' || client_id AS scope, label, predicted FROM predictions
    UNION ALL SELECT 'all', label, predicted FROM predictions) GROUP BY ALL),
  classes AS (
    SELECT scope, cls,
      coalesce(sum(n) FILTER (actual = cls AND predicted = cls), 0)::DOUBLE AS tp,
      coalesce(sum(n) FILTER (predicted = cls), 0)::DOUBLE AS p,
      coalesce(sum(n) FILTER (actual = cls), 0)::DOUBLE AS a
    FROM cells CROSS JOIN {_DOMAIN} GROUP BY scope, cls)"""

SQL = {
    "partition_iid": f"WITH {S.SAMPLES}, {S.parts()} SELECT sample_id, client_id FROM parts",
    "partition_iid_balanced": f"""WITH {S.SAMPLES} SELECT sample_id,
        ((row_number() OVER (ORDER BY {S.draw(42, 'part', 'sample_id')}, sample_id) - 1) % 10)::INT AS client_id
        FROM samples""",
    "train_val_split": f"WITH {S.SAMPLES}, {S.parts()} SELECT sample_id, client_id, {_SPLIT} AS split FROM parts",
    "train_val_split_exact": f"""WITH {S.SAMPLES}, {S.parts()}, ranked AS (SELECT sample_id, client_id,
        row_number() OVER (PARTITION BY client_id ORDER BY {S.draw(42, 'split', 'sample_id')}, sample_id) AS r,
        count(*) OVER (PARTITION BY client_id) AS k FROM parts)
        SELECT sample_id, client_id, CASE WHEN r <= ceil(k * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split
        FROM ranked""",
    "partition_dirichlet": f"WITH {S.SAMPLES}, {_DIRICHLET} SELECT sample_id, label, client_id FROM skewed",
    "partition_shares": f"""WITH {S.SAMPLES}, weights AS (SELECT c_custkey::INT AS client_id, label,
          (c_custkey * (label + 3) % 97 + 1)::DOUBLE AS weight FROM customer, (SELECT unnest(range(9)) AS label)),
        slices AS (SELECT label, client_id, (sum(weight) OVER u - weight) / sum(weight) OVER a AS lo,
            CASE WHEN client_id = max(client_id) OVER a THEN 1.0 ELSE sum(weight) OVER u / sum(weight) OVER a END AS hi FROM weights
          WINDOW a AS (PARTITION BY label), u AS (PARTITION BY label ORDER BY client_id ROWS UNBOUNDED PRECEDING)),
        drawn AS (SELECT sample_id, label, {S.uniform(42, "dirichlet", "sample_id")} AS u FROM samples),
        placed AS (SELECT coalesce(client_id, -1) AS client_id FROM drawn d LEFT JOIN slices s ON s.label = d.label AND u >= lo AND u < hi)
        SELECT client_id, count(*) AS n_rows FROM placed GROUP BY client_id
        UNION ALL SELECT -1, 0 WHERE NOT EXISTS (FROM placed WHERE client_id = -1)""",
    "label_distribution": f"""WITH {S.SAMPLES}, {S.parts()}, {_DIRICHLET}
        SELECT client_id, {_LABEL_COLS}, 'iid' AS partitioner FROM parts GROUP BY client_id
        UNION ALL SELECT client_id, {_LABEL_COLS}, 'dirichlet' FROM skewed GROUP BY client_id""",
    "sample_clients": f"""WITH {S.REPLIES}, c AS (SELECT DISTINCT round, client_id FROM replies), r AS (
        SELECT round, client_id, row_number() OVER (PARTITION BY round
          ORDER BY {S.draw(42, 'round', 'round', 'client_id')}, client_id) AS rank FROM c)
        SELECT round, client_id, rank FROM r WHERE rank <= greatest(1, floor(10 * 0.8))""",
    "malicious_flag": f"""WITH {S.REPLIES} SELECT client_id, count(*) AS n_replies,
        (client_id IN (3, 5, 7))::INT AS is_malicious FROM replies GROUP BY client_id""",
    "predict_labels": f"""{_PRED} SELECT sample_id, client_id, label, predicted, round(loss, 6) AS loss
        FROM predictions""",
    "confusion_matrix": f"""{_PRED} SELECT c.client_id, a.cls AS actual, p.cls AS predicted, count(s.sample_id) AS n
        FROM (SELECT DISTINCT client_id FROM predictions) c CROSS JOIN {_DOMAIN} a CROSS JOIN {_DOMAIN} p
        LEFT JOIN predictions s ON s.client_id = c.client_id AND s.label = a.cls AND s.predicted = p.cls
        GROUP BY ALL""",
    "confusion_matrix_global": f"{_PRED} SELECT label AS actual, predicted, count(*) AS n FROM predictions GROUP BY ALL",
    "per_class_f1": f"""{_PRED}, {_F1} SELECT cls, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision,
        round(coalesce(tp / nullif(a, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + a, 0), 0), 6) AS f1
        FROM classes WHERE scope = 'all'""",
    "macro_f1": f"""{_PRED}, {_F1} SELECT scope, round(avg(coalesce(2 * tp / nullif(p + a, 0), 0)), 6) AS macro_f1
        FROM classes GROUP BY scope""",
    "client_report": f"""{_PRED}, {_F1}, scoped AS (
          SELECT 'client_' || client_id AS scope, loss, (predicted = label)::INT AS hit FROM predictions
          UNION ALL SELECT 'all', loss, (predicted = label)::INT FROM predictions),
        f AS (SELECT scope, avg(coalesce(2 * tp / nullif(p + a, 0), 0)) AS macro_f1 FROM classes GROUP BY scope)
        SELECT scope, round(avg(loss), 6) AS eval_loss, round(avg(hit), 6) AS eval_acc, count(*) AS num_examples,
          round(any_value(f.macro_f1), 6) AS macro_f1 FROM scoped JOIN f USING (scope) GROUP BY scope""",
    "eval_scores": f"""{_PRED} SELECT client_id, {_SPLIT} AS split, round(avg(loss), 6) AS eval_loss,
        round(avg((predicted = label)::INT::DOUBLE), 6) AS eval_acc, count(*) AS num_examples
        FROM predictions GROUP BY ALL""",
    "attack_success_rate": f"""WITH {S.HEAD_CTES}, stamped AS (
        SELECT sample_id, client_id, label, list_transform(features, lambda x, i:
          CASE WHEN (i - 1) // 8 < 3 AND (i - 1) % 8 < 3 THEN 1.0 ELSE x END) AS features FROM parts),
        {S.scored('stamped')}, {S.predicted('stamped')}
        SELECT client_id, round(coalesce(count(*) FILTER (predicted = 1 AND label <> 1)::DOUBLE
          / nullif(count(*) FILTER (label <> 1), 0), 0), 6) AS backdoor_asr, count(*) AS num_examples
        FROM predictions GROUP BY client_id""",
    "agg_train_metrics": f"""WITH {S.REPLIES} SELECT round,
        round(coalesce(sum(num_examples * train_loss) / nullif(sum(num_examples), 0), 0), 6) AS train_loss,
        sum(num_examples)::BIGINT AS num_examples FROM replies GROUP BY round""",
    "agg_eval_metrics": f"""WITH {S.REPLIES} SELECT round,
        round(coalesce(sum(num_examples * eval_loss) / nullif(sum(num_examples), 0), 0), 6) AS eval_loss,
        round(coalesce(sum(num_examples * eval_acc) / nullif(sum(num_examples), 0), 0), 6) AS eval_acc,
        round(coalesce(sum(num_examples * backdoor_asr) / nullif(sum(num_examples), 0), 0), 6) AS backdoor_asr,
        sum(num_examples)::BIGINT AS num_examples FROM replies GROUP BY round""",
}
