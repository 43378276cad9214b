import numpy as np
import pytest
from pyspark.sql import functions as F

from fedlens.operators import combine as C
from fedlens.operators import krum as K
from fedlens.operators.ranking import values_at

VECTORS = [(1, 2), (1.2, 1.8), (0.9, 2.1), (1.1, 2.05), (10, -10)]
WEIGHTS = [10, 20, 30, 20, 20]
LONG = "round int, client_id int, layer string, pos int, v double, n bigint"


def frame(spark, vectors, weights=None, layers=("body.weight",)):
    weights = weights or [1] * len(vectors)
    data = [
        (1, c, layers[min(p, len(layers) - 1)], p, float(x), weights[c])
        for c, vec in enumerate(vectors)
        for p, x in enumerate(vec)
    ]
    return spark.createDataFrame(data, LONG)


def vector(df, column="v"):
    return [round(r[column], 6) for r in df.orderBy("pos").collect()]


def model(spark, values):
    return spark.createDataFrame([("body.weight", p, float(x)) for p, x in enumerate(values)], "layer string, pos int, v double")


@pytest.fixture(scope="module")
def updates(spark):
    return frame(spark, VECTORS, WEIGHTS)


def test_worked_example(updates):
    assert vector(C.fedavg(updates)) == [2.83, -0.4]
    assert vector(C.coordinate_median(updates)) == [1.1, 2.0]
    assert vector(C.trimmed_mean(updates, 0.2)) == [1.1, 1.95]


def test_krum_worked_example(updates):
    dist = K.tile_distances(C.to_blocks(updates, ["round", "client_id"]), 5, 2)
    scores = K.krum_scores(dist, 5, 1)
    assert [round(r.score, 6) for r in scores.orderBy("client_id").collect()] == [0.0325, 0.1525, 0.0625, 0.055, 441.0925]
    assert [r.client_id for r in K.krum_select(scores).collect()] == [0]
    chosen = K.krum_select(scores, 3)
    assert sorted(r.client_id for r in chosen.collect()) == [0, 2, 3]
    assert vector(K.multikrum(updates, chosen)) == [1.0, 2.05]


def test_tiles_give_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(23, 40))
    updates = frame(spark, data.tolist())
    monkeypatch.setattr(K, "TILE_BYTES", 5 * 40 * 8)  # about five vectors per tile
    assert K.tile_count(23, 40) == 5
    blocks = C.to_blocks(updates, ["round", "client_id"], 16)
    pairs = K.pairwise_distances(K.tile_distances(blocks, 23, 40)).collect()
    got = {(r.client_a, r.client_b): r.sq_dist for r in pairs}
    assert len(pairs) == len(got) == 23 * 22 // 2
    for (a, b), d in got.items():
        assert d == pytest.approx(np.square(data[a] - data[b]).sum())
    scores = K.krum_scores(K.tile_distances(blocks, 23, 40), 23, 4)
    full = np.square(data[:, None] - data[None]).sum(-1)
    want = np.sort(full, axis=1)[:, 1 : 23 - 4 - 2 + 1].sum(1)
    assert [r.score for r in scores.orderBy("client_id").collect()] == pytest.approx(want.tolist())


def test_median_of_even_count_and_ties(spark):
    df = frame(spark, [(1, 5), (2, 5), (4, 5), (3, 1)])
    assert vector(C.coordinate_median(df)) == [2.5, 5.0]


def test_no_trimming_is_the_plain_mean(spark, updates):
    plain = C.fedavg(updates.withColumn("n", F.lit(1)))
    assert vector(C.trimmed_mean(updates, 0.0)) == vector(plain)


def test_order_of_clients_does_not_matter(spark):
    a, b = frame(spark, VECTORS), frame(spark, VECTORS[::-1])
    assert vector(C.coordinate_median(a)) == vector(C.coordinate_median(b))
    assert vector(C.trimmed_mean(a, 0.2)) == vector(C.trimmed_mean(b, 0.2))


@pytest.mark.parametrize("parts", [1, 16])
def test_partitioning_does_not_matter(updates, parts):
    spread = updates.repartition(parts)
    assert vector(C.fedavg(spread)) == [2.83, -0.4]
    assert vector(C.trimmed_mean(spread, 0.2)) == [1.1, 1.95]


def test_adaptive_first_steps(spark):
    state = C.server_state(model(spark, (1, 1)), ["m", "v"])
    mean = model(spark, (2, 0.5))
    assert vector(C.adam_step(state, mean, 0.1, 0.9, 0.999, 1e-3), "x") == [1.306534, 0.702583]
    yogi = C.yogi_step(state, mean, 0.1, 0.9, 0.999, 1e-3)
    assert vector(yogi) == [0.001, 0.00025]


@pytest.mark.parametrize("rule, moments", [("avgm", ["m"]), ("adam", ["m", "v"]), ("yogi", ["m", "v"])])
def test_stateful_rules_keep_what_a_round_does_not_bring(spark, rule, moments):
    def step(state, mean):
        if rule == "avgm":
            return C.avgm_step(state, mean, 1.0, 0.7)
        return getattr(C, f"{rule}_step")(state, mean, 0.1, 0.9, 0.999, 1e-3)

    started = step(C.server_state(model(spark, (1.0, 2.0)), moments), model(spark, (0.5, 1.0)))
    partly = step(started, model(spark, (0.25,)))
    last = lambda df: [tuple(r) for r in df.select("pos", "x", *moments).orderBy("pos").collect()]
    assert last(partly)[1] == last(started)[1] and last(partly)[0] != last(started)[0]
    assert last(step(started, model(spark, (0.5,)).limit(0))) == last(started)


def test_failed_replies_are_left_out(spark):
    rows = [(1, 0, "a", 0, 1.0, 1, False), (1, 1, "a", 0, 9.0, 1, True)]
    df = spark.createDataFrame(rows, "round int, client_id int, layer string, pos int, v double, n int, has_error boolean")
    assert vector(C.fedavg(df)) == [1.0] and vector(C.coordinate_median(df)) == [1.0] and vector(C.trimmed_mean(df, 0.0)) == [1.0]
    assert vector(C.clip_updates(df, model(spark, (0.0,)).withColumn("layer", F.lit("a")), 0.5)) == [0.5]


def test_momentum_accumulates(spark):
    state = C.server_state(model(spark, (1.0,)), ["m"])
    for _ in range(2):
        state = C.avgm_step(state, model(spark, (0.5,)), 1.0, 0.7)
    # m1 = 0.5, x1 = 0.5; m2 = 0.35 + 0 = 0.35, x2 = 0.15
    assert vector(state, "x") == [0.15] and vector(state, "m") == [0.35]


def test_clipping_bounds_the_norm(spark, updates):
    current = model(spark, (1, 2))
    clipped = C.clip_updates(updates, current, 0.25)
    delta = clipped.join(current.withColumnRenamed("v", "x"), ["layer", "pos"])
    norms = delta.groupBy("client_id").agg(F.sqrt(F.sum((F.col("v") - F.col("x")) ** 2)).alias("d")).collect()
    assert all(r.d <= 0.25 + 1e-9 for r in norms)
    assert vector(clipped.where("client_id = 0")) == [1.0, 2.0]  # a zero update stays zero


def test_noise_has_the_stated_deviation(spark):
    flat = model(spark, [0.0] * 20000)
    noise = C.add_noise(flat, 0.5, 2.0, 10, 7).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(noise[0]) < 0.005 and noise[1] == pytest.approx(0.1, rel=0.03)


def test_blocks_round_trip(spark):
    df = frame(spark, [list(range(50)), list(range(50, 100))])
    blocks = C.to_blocks(df, ["round", "client_id"], 16)
    assert blocks.count() == 8
    back = C.to_long(blocks, ["round", "client_id"], 16)
    assert sorted((r.client_id, r.pos, r.v) for r in back.collect()) == sorted((r.client_id, r.pos, r.v) for r in df.collect())


def test_failed_replies_do_not_count_in_norms(spark):
    df = spark.createDataFrame(
        [(1, 0, "a", 0, [3.0, 4.0], False), (1, 1, "a", 0, [1.0, 1.0], True)],
        "round int, client_id int, layer string, block int, vals array<double>, has_error boolean",
    )
    assert [(r.client_id, r.norm) for r in C.update_norms(df).collect()] == [(0, 5.0)]


def test_carry_forward_and_shared_body(spark):
    current, new = model(spark, (1, 2, 3)), model(spark, (9, 8))
    assert vector(C.carry_forward(current, new)) == [9.0, 8.0, 3.0]
    df = frame(spark, [(1, 2, 3)], layers=("fc1.weight", "fc2.weight", "fc2.bias"))
    assert [r.layer for r in C.shared_body(df).collect()] == ["fc1.weight"]


def test_values_at_ranks_are_those_of_a_sort(spark):
    """Signs, both zeros, subnormals, infinities and ties; NaN and null do not count."""
    odd = [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf"), 1.5, 1.5, -2.25, 1e300, -1e300, 3.0, float("nan"), None]
    rng = np.random.default_rng(4)
    data = [("odd", v) for v in odd] + [("many", float(v)) for v in rng.normal(size=500) * 10.0 ** rng.integers(-9, 9, 500)] + [("one", 7.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    wanted = {"first": lambda k: F.lit(1), "third": lambda k: F.least(k, F.lit(3)), "middle": lambda k: F.floor((k + 1) / 2), "last": lambda k: k}
    for r in values_at(df, "v", wanted, ["g"]).collect():
        own = sorted(v for g, v in data if g == r.g and v is not None and v == v)
        k = len(own)
        assert (r.k, r.first, r.third, r.middle, r.last) == (k, own[0], own[min(k, 3) - 1], own[(k + 1) // 2 - 1], own[-1])


def test_norm_stats_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(rnd, float(v)) for rnd, n in ((1, 1), (2, 2), (3, 37)) for v in rng.gamma(2.0, size=n)]
    found = C.norm_stats(spark.createDataFrame(data, "round int, norm double")).orderBy("round").collect()
    for r in found:
        own = [v for rnd, v in data if rnd == r.round]
        want = [min(own), max(own), np.median(own), np.percentile(own, 90)]
        assert [r.norm_min, r.norm_max, r.norm_median, r.norm_p90] == pytest.approx(want)


def test_far_attackers_take_no_digits(spark):
    """The sum of near distances stays exact beside distances of 1e30, and few replies leave one neighbour."""
    data = [(1e15, 0.0), (0.0, 0.0), (1e-6, 0.0), (0.0, 2e-6), (3e-6, 0.0)]
    updates = frame(spark, data)
    scores = K.krum_scores(K.tile_distances(C.to_blocks(updates, ["round", "client_id"]), 5, 2), 5, 1)
    got = {r.client_id: r.score for r in scores.collect()}
    assert got[1] == pytest.approx(1e-12 + 4e-12) and got[0] == pytest.approx(2e30)
    two = frame(spark, [(0.0, 0.0), (3.0, 4.0)])
    scores = K.krum_scores(K.tile_distances(C.to_blocks(two, ["round", "client_id"]), 2, 2), 2, 0)
    assert [r.score for r in scores.collect()] == [25.0, 25.0]


def test_streamed_scores_send_no_distances(spark, monkeypatch):
    """Tiles and portions of a few clients give the scores of the whole matrix, in one row a client."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(41, 6))
    data[7] = data[3]
    data[5] *= 1e12
    blocks = C.to_blocks(frame(spark, data.tolist()), ["round", "client_id"], 4)
    full = np.square(data[:, None] - data[None]).sum(-1)
    for size, f in ((6 * 8 * 12, 5), (1, 0), (1 << 20, 5), (6 * 8 * 12, 40)):
        monkeypatch.setattr(K, "SCORE_BYTES", size)
        monkeypatch.setattr(K, "TILE_BYTES", 6 * 8 * 7)  # portions of seven
        found = K.streamed_scores(blocks, 41, 6, f).orderBy("client_id")
        assert found.columns == ["round", "client_id", "score"]
        want = np.sort(full, axis=1)[:, 1 : max(1, 41 - f - 2) + 1].sum(1)
        assert [r.score for r in found.collect()] == pytest.approx(want.tolist())
    two = frame(spark, [(0.0, 0.0), (3.0, 4.0)])
    assert [r.score for r in K.streamed_scores(C.to_blocks(two, ["round", "client_id"]), 2, 2, 0).collect()] == [25.0, 25.0]
