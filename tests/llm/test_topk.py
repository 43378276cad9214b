import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from fedlens.llm import queries, topk
from oracle import connect


def brute(vectors, k):
    """``vectors`` are rows (id, vector); every row but the query's own is a candidate."""
    out = []
    for at, (q, v) in enumerate(vectors):
        if q % 20 == 0:
            best = sorted((-int(np.dot(v, w)), c) for i, (c, w) in enumerate(vectors) if i != at)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return sorted(out)


def test_matches_sql(spark, sf):
    got = rows(queries.op6_exact_topk(spark, sf), "query_id", "rank", "vec_id", "score")
    assert got == sorted(connect(sf).execute(queries.TOPK_SQL).fetchall())


@pytest.mark.parametrize("spread", [0, 3, 900])
def test_ties_copies_and_skew(spark, monkeypatch, spread):
    """One vector is most of the table; small blocks, rings and sample force every path."""
    for name, size in (("BLOCK_ROWS", 40), ("RING_ROWS", 7), ("SAMPLE_ROWS", 30), ("QUERY_ROWS", 5), ("PIVOTS", 5)):
        monkeypatch.setattr(topk, name, size)
    random = np.random.default_rng(spread)
    vectors = {i: (np.ones(4) if i % 3 else random.integers(-spread, spread + 1, 4)).astype(int).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>")
    found = topk.top_k(spark, df.union(df), F.col("vec_id") % 20 == 0, 20)
    assert rows(found) == brute(2 * list(vectors.items()), 20)


def test_repeated_rows_and_lengths_as_in_sql(spark, tmp_path):
    """A repeated row is a candidate of its own, and vectors of an unusual length take no part."""
    data = [(0, [0.5, 1.0]), (1, [0.25, 0.0]), (1, [0.25, 0.0]), (0, [0.5, 1.0]), (2, [9.0]), (3, [9.0, 9.0, 9.0]), (20, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = rows(queries.op6_exact_topk(spark, str(tmp_path)), "query_id", "rank", "vec_id", "score")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.TOPK_SQL).fetchall()) and len(got) == 6
    assert got[0] == (0, 1, 0, 5120)


def test_hard_vectors(spark):
    odd = [(0, [0.5, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (None, [1.0, 1.0]), (6, [0.01, -0.01]), (7, [0.5, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in odd], "vec_id long, embedding array<float>, v int, away int")
    whole = topk.whole_vectors(df, "vec_id", "embedding")
    assert rows(whole) == [(0, [32, 64]), (6, [0, -1]), (7, [32, 64])]
    assert rows(topk.top_k(spark, whole, F.col("vec_id") % 20 == 0, 20)) == [(0, 1, 7, 5120), (0, 2, 6, -64)]
    assert topk.top_k(spark, whole.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_a_batch_of_queries_is_routed_in_pieces():
    """What a task holds of a batch does not grow with its queries times the blocks they go to."""
    random = np.random.default_rng(0)
    v, sample, pivots = (random.integers(-30, 31, (n, 8)).astype("float64") for n in (5000, topk.SAMPLE_ROWS, 32))
    batch = pa.record_batch({"vec_id": np.arange(5000), "row": np.arange(5000) + 7, "v": topk.packed(v, "int8")})
    reach = {p: (0.0, 1e9, 50) for p in range(32)}
    radius2 = float((v * v).sum(1).max())
    tracemalloc.start()
    n, met = 0, np.zeros(5000, int)
    for out in topk.routes(batch, "int8", "float32", sample.astype("float32"), np.arange(len(sample)), topk.lengthened(pivots, 1e6), reach, radius2, 20):
        assert out.num_rows <= topk.ROUTED_ROWS
        n += out.num_rows
        met += np.bincount(out["row"].to_numpy() - 7, minlength=5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5000 * 32 * 50 and (met == 1600).all()
    assert peak < 80e6


def test_candidates_are_merged_before_they_pile_up(spark, monkeypatch):
    """Equal scores everywhere, with fewer kept waiting than a query meets; the greatest id is a candidate as any other."""
    for name, size in (("HELD", 30), ("RING_ROWS", 11), ("SCORED_ROWS", 3), ("ROUTED_ROWS", 4), ("SAMPLE_ROWS", 5), ("BLOCK_ROWS", 60), ("QUERY_ROWS", 7)):
        monkeypatch.setattr(topk, name, size)
    vectors = [(i, [1, 300, -2]) for i in range(200, 0, -1)] + [(2**63 - 1, [2, 300, -2]), (40, [1, 300, -2])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    assert rows(topk.top_k(spark, df, F.col("vec_id") % 20 == 0, 20)) == brute(vectors, 20)
    wide = [(i, [x * 70_000, 5]) for i, x in enumerate(range(-30, 30))]
    df = spark.createDataFrame(wide, "vec_id long, v array<long>")
    assert rows(topk.top_k(spark, df, F.col("vec_id") % 20 == 0, 20)) == brute(wide, 20)
