import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from fedlens.functions.hashing import draw, gaussian, uniform
from fedlens.operators import features as T
from fedlens.operators import partition as P
from fedlens.operators import poison as A
from fedlens.operators.ranking import rank_by_draw


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(3000).select(F.col("id").alias("sample_id"), (F.col("id") % 10).cast("int").alias("label"))


def test_draws_do_not_depend_on_partitioning(samples):
    with_u = lambda df: rows(df.select("sample_id", uniform(1, "t", "sample_id")))
    assert with_u(samples.repartition(1)) == with_u(samples.repartition(13))


def test_gaussian_moments(samples):
    stats = samples.select(gaussian(5, "g", "sample_id").alias("z")).agg(F.avg("z"), F.stddev("z"), F.count("z")).first()
    assert abs(stats[0]) < 0.07 and stats[1] == pytest.approx(1.0, abs=0.05) and stats[2] == 3000


@pytest.mark.parametrize("parts", [1, 16])
def test_exact_rank_with_one_group_of_half_the_rows(spark, parts):
    df = spark.range(2000).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 7).cast("int").alias("g")
    ).repartition(parts)
    d = draw(3, "r", "sample_id")
    got = rank_by_draw(df, d, "sample_id", ["g"], bits=4).toPandas()
    want = df.withColumn("d", d).toPandas().sort_values(["g", "d", "sample_id"])
    want["rank"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="sample_id")
    assert len(merged) == 2000 and (merged["rank_x"] == merged["rank_y"]).all()
    sizes = got.groupby("g")["group_size"].agg(["min", "max", "size"])
    assert (sizes["min"] == sizes["size"]).all() and (sizes["max"] == sizes["size"]).all()


def test_partitions_cover_every_sample_once(samples):
    for assigned in (
        P.assign_iid(samples, 7, 42), P.assign_iid_balanced(samples, 7, 42),
        P.assign_dirichlet(samples, P.dirichlet_shares(10, 7, 0.05, 42), 42),
    ):
        assert assigned.count() == assigned.select("sample_id").distinct().count() == 3000


def test_balanced_sizes_differ_by_one_at_most(samples):
    sizes = [r["count"] for r in P.assign_iid_balanced(samples, 7, 42).groupBy("client_id").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_dirichlet_follows_the_shares(samples):
    shares = P.dirichlet_shares(10, 5, 0.5, 1)
    counts = P.assign_dirichlet(samples, shares, 42).groupBy("label", "client_id").count().collect()
    got = np.zeros((10, 5))
    for r in counts:
        got[r.label, r.client_id] = r["count"] / 300
    assert np.abs(got - shares).max() < 0.1


def test_exact_split(samples):
    split = P.split_train_val_exact(P.assign_iid(samples, 4, 42), 0.2)
    for r in split.groupBy("client_id").agg(F.count_if(F.col("split") == "val").alias("v"), F.count("*").alias("n")).collect():
        assert r.v == int(np.ceil(r.n * 0.2))


def test_client_sampling_takes_at_least_one(spark):
    clients = spark.range(10).select(F.col("id").cast("int").alias("client_id"), F.lit(1).alias("round"))
    assert P.sample_clients(clients, 0.05, 10, 42).count() == 1
    assert P.sample_clients(clients, 0.8, 10, 42).count() == 8


def test_attacks_with_zero_rate_change_nothing(spark):
    df = spark.range(50).select(
        F.col("id").alias("sample_id"), F.lit(3).alias("client_id"), F.lit("train").alias("split"),
        (F.col("id") % 10).cast("int").alias("label"), F.array_repeat(F.lit(0.5), 64).alias("features"),
    )
    config = {"malicious-clients-ids": [3], "attack_flip-fraction": 0.0, "attack_injection_rate": 0.0}
    for attack in ("label_flipping", "backdoor", "byzantine", "none", None):
        poisoned = A.poison_samples(df, {**config, "attack_name": attack}, 8)
        assert rows(poisoned.select(*df.columns)) == rows(df)


def test_label_flip_leaves_target_nine_and_validation_alone(spark):
    df = spark.range(40).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") < 20, 3).otherwise(4).alias("client_id"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("val").alias("split"), (F.col("id") % 10).cast("int").alias("label"),
    )
    out = A.poison_samples(df, {"malicious-clients-ids": [3], "attack_name": "label_flipping"}, 8).withColumnRenamed("label", "new")
    for r in out.join(df.select("sample_id", "label"), "sample_id").collect():
        attacked = r.client_id == 3 and r.split == "train" and r.label not in (2, 9)
        assert r.new == (2 if attacked else r.label)


def test_trigger_and_augmentation_against_numpy(spark):
    picture = np.arange(1.0, 65.0).reshape(8, 8)
    df = spark.createDataFrame([(picture.ravel().tolist(),)], "features array<double>")
    stamped = np.array(df.select(A.stamp_trigger(F.col("features"), 8)).first()[0]).reshape(8, 8)
    want = picture.copy()
    want[:3, :3] = 1.0
    assert (stamped == want).all()
    padded = np.pad(picture, 4)
    for dy, dx, flip in [(0, 0, False), (8, 8, True), (4, 4, False), (4, 4, True), (2, 7, True), (7, 1, False)]:
        got = df.select(T.crop_and_flip(F.col("features"), 8, 4, F.lit(dy), F.lit(dx), F.lit(flip))).first()[0]
        crop = padded[dy : dy + 8, dx : dx + 8]
        assert got == (crop[:, ::-1] if flip else crop).ravel().tolist()


def test_dirichlet_parts_rows_into_placed_and_rejected(spark):
    df = spark.range(120).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") % 12 == 11, None).otherwise(F.col("id") % 12).cast("int").alias("label")
    )
    shares = P.dirichlet_shares(10, 4, 0.5, 1)
    placed, rejected = P.assign_dirichlet(df, shares, 1), P.dirichlet_rejects(df, shares, 1)
    assert placed.count() == 100 and rejected.columns == df.columns
    assert {r.label for r in rejected.collect()} == {10, None} and rejected.count() == 20
    assert rows(placed.select("sample_id").union(rejected.select("sample_id"))) == rows(df.select("sample_id"))
