"""Feature transforms and attacks on samples and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedlens.operators import features as T
from fedlens.operators import poison as A
from fedlens.operators.partition import split_train_val
from fedlens.plans.transforms import Pictures
from fedlens.sources import derived as D
from fedlens.sources import derived_sql as S

FLIP_RATE, INJECTION_RATE = 0.7, 0.15
PADDING = 4
CONFIGURED = ("none", "label_flipping", "backdoor", "byzantine")


def _pixels(df, *keep):
    return df.select("sample_id", *keep, F.posexplode("features").alias("pos", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 6)
    )


def _split_parts(spark, sf):
    return split_train_val(D.parts(spark, sf), 0.2)


def _attacked():
    return A.is_malicious(D.MALICIOUS) & (F.col("split") == "train")


def label_flip(spark, sf):
    rows = _split_parts(spark, sf)
    return rows.select(
        "sample_id", "client_id", "split", "label", A.flipped_label(_attacked(), FLIP_RATE, D.SEED).alias("flipped")
    )


def backdoor_inject(spark, sf):
    rows = A.inject_backdoor(_split_parts(spark, sf), _attacked(), D.SIDE, D.TARGET_CLASS, INJECTION_RATE, D.SEED)
    return _pixels(rows, "label", F.col("poisoned").cast("int").alias("poisoned"))


def trigger_eval(spark, sf):
    """Validation rows with the trigger set and their labels kept."""
    rows = _split_parts(spark, sf).where("split = 'val'")
    return _pixels(rows.withColumn("features", A.stamp_trigger(F.col("features"), D.SIDE)), "label")


def byzantine_update(spark, sf):
    updates = A.byzantine_updates(D.client_params(spark, sf), D.global_params(spark, sf), D.MALICIOUS, D.SEED)
    return updates.select("client_id", "layer", "pos", F.round("v", 6).alias("v"))


def poison_dispatch(spark, sf):
    """What every client does under each configured attack, with the rows it trains on."""
    rows = _split_parts(spark, sf).where("split = 'train'")
    configured = F.explode(F.array(*[F.lit(a) for a in CONFIGURED]))
    acting = rows.select("sample_id", "client_id", "label", configured.alias("configured")).withColumn(
        "attack", A.effective_attack(F.col("configured"), D.MALICIOUS)
    )
    flipped = A.flipped_label(F.col("attack") == "label_flipping", 1.0, D.SEED)
    return acting.groupBy("configured", "client_id", "attack").agg(
        F.bool_and(A.trains(F.col("attack"))).cast("int").alias("trains"),
        F.count("*").alias("n"),
        F.count_if(flipped != F.col("label")).alias("n_flipped"),
    )


def normalize_features(spark, sf):
    return _pixels(D.samples(spark, sf).withColumn("features", T.normalize(F.col("features"))))


def augment_features(spark, sf):
    dy, dx = T.crop_offsets(D.SEED, PADDING)
    rows = D.samples(spark, sf).withColumns({"dy": dy, "dx": dx, "flip": T.flip_drawn(D.SEED)})
    picture = T.crop_and_flip(F.col("features"), D.SIDE, PADDING, F.col("dy"), F.col("dx"), F.col("flip"))
    return _pixels(rows.withColumn("features", picture))


def training_rows(spark, sf):
    """What a run trains on in its second round: crops, flips, the backdoor, standardised pixels, all drawn for that round."""
    config = {
        "seed": D.SEED, "attack_name": "backdoor", "malicious-clients-ids": list(D.MALICIOUS),
        "attack_target_class": D.TARGET_CLASS, "attack_injection_rate": INJECTION_RATE,
    }
    rows = _split_parts(spark, sf).where("split = 'train'")
    return _pixels(Pictures(D.SIDE, PADDING).train(rows, config, 2), "client_id", "label")


QUERIES = {
    f.__name__: f
    for f in (
        label_flip, backdoor_inject, trigger_eval, byzantine_update, poison_dispatch, normalize_features,
        augment_features, training_rows,
    )
}

_BASE = f"WITH {S.SAMPLES}, {S.parts()}"
_IDS = "(3, 5, 7)"
_SPLIT = f"CASE WHEN {S.uniform(42, 'split', 'sample_id')} < 0.2 THEN 'val' ELSE 'train' END"
_ROWS = f"split_parts AS (SELECT *, {_SPLIT} AS split FROM parts)"
_FLIP = "label IN (0, 1, 3, 4, 5, 6, 7, 8)"
_STAMPED = "list_transform(features, lambda x, i: CASE WHEN (i - 1) // 8 < 3 AND (i - 1) % 8 < 3 THEN 1.0 ELSE x END)"


def _unnested(source: str, *keep: str, features: str = "features") -> str:
    cols = "".join(f", {k}" for k in keep)
    return f"""SELECT sample_id{cols}, pos, round(x, 6) + 0.0 AS x FROM (
      SELECT sample_id{cols}, unnest({features}) AS x, (generate_subscripts({features}, 1) - 1)::INT AS pos FROM {source})"""


SQL = {
    "label_flip": f"""{_BASE}, {_ROWS} SELECT sample_id, client_id, split, label,
        CASE WHEN client_id IN {_IDS} AND split = 'train' AND {_FLIP}
          AND {S.uniform(42, 'flip', 'sample_id')} < {FLIP_RATE} THEN 2 ELSE label END AS flipped FROM split_parts""",
    "backdoor_inject": f"""{_BASE}, {_ROWS}, marked AS (SELECT sample_id, label, features, (client_id IN {_IDS}
          AND split = 'train' AND {S.uniform(42, 'backdoor', 'sample_id')} < {INJECTION_RATE})::INT AS poisoned FROM split_parts),
        stamped AS (SELECT sample_id, CASE WHEN poisoned = 1 THEN 1 ELSE label END AS label, poisoned,
          CASE WHEN poisoned = 1 THEN {_STAMPED} ELSE features END AS features FROM marked)
        {_unnested("stamped", "label", "poisoned")}""",
    "trigger_eval": f"""{_BASE}, {_ROWS}, stamped AS (SELECT sample_id, label, {_STAMPED} AS features
        FROM split_parts WHERE split = 'val') {_unnested("stamped", "label")}""",
    "byzantine_update": f"""WITH {S.PARAM_CTES} SELECT client_id, layer, pos, round(CASE WHEN client_id IN {_IDS}
        THEN g.v + 0.5 * {S.gaussian(42, 'byzantine', 'client_id', 'round', 'layer', 'pos')} ELSE c.v END, 6) + 0.0 AS v
        FROM client_params c JOIN global_params g USING (layer, pos)""",
    "poison_dispatch": f"""{_BASE}, {_ROWS}, acting AS (SELECT client_id, label, configured,
          CASE WHEN client_id IN {_IDS} THEN configured ELSE 'none' END AS attack
          FROM (SELECT *, unnest({list(CONFIGURED)}) AS configured FROM split_parts WHERE split = 'train'))
        SELECT configured, client_id, attack, (attack <> 'byzantine')::INT AS trains, count(*) AS n,
          count(*) FILTER (attack = 'label_flipping' AND {_FLIP}) AS n_flipped FROM acting GROUP BY ALL""",
    "normalize_features": f"""WITH {S.SAMPLES}, scaled AS (SELECT sample_id,
        list_transform(features, lambda x: (x - 0.1307) / 0.3081) AS features FROM samples) {_unnested("scaled")}""",
    "augment_features": f"""WITH {S.SAMPLES}, drawn AS (SELECT sample_id, features,
          floor({S.uniform(42, 'crop-row', 'sample_id')} * 9)::INT AS dy,
          floor({S.uniform(42, 'crop-col', 'sample_id')} * 9)::INT AS dx,
          {S.uniform(42, 'hflip', 'sample_id')} < 0.5 AS flip FROM samples),
        spots AS (SELECT sample_id, features, i::INT AS pos, i // 8 + dy - 4 AS r,
          (CASE WHEN flip THEN 7 - i % 8 ELSE i % 8 END) + dx - 4 AS c FROM drawn, unnest(range(64)) t(i))
        SELECT sample_id, pos, round(CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7
          THEN features[r * 8 + c + 1] ELSE 0.0 END, 6) AS x FROM spots""",
    "training_rows": f"""{_BASE}, {_ROWS}, drawn AS (SELECT sample_id, client_id, label, features,
          floor({S.uniform(44, 'crop-row', 'sample_id')} * 9)::INT AS dy, floor({S.uniform(44, 'crop-col', 'sample_id')} * 9)::INT AS dx,
          {S.uniform(44, 'hflip', 'sample_id')} < 0.5 AS flip,
          client_id IN {_IDS} AND {S.uniform(44, 'backdoor', 'sample_id')} < {INJECTION_RATE} AS hit FROM split_parts WHERE split = 'train'),
        spots AS (SELECT sample_id, client_id, label, features, hit, i::INT AS pos, i // 8 + dy - 4 AS r,
          (CASE WHEN flip THEN 7 - i % 8 ELSE i % 8 END) + dx - 4 AS c FROM drawn, unnest(range(64)) t(i))
        SELECT sample_id, client_id, CASE WHEN hit THEN 1 ELSE label END AS label, pos,
          round((CASE WHEN hit AND pos // 8 < 3 AND pos % 8 < 3 THEN 1.0 WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7
            THEN features[r * 8 + c + 1] ELSE 0.0 END - 0.1307) / 0.3081, 6) + 0.0 AS x FROM spots""",
}
