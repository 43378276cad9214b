"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more component that makes all lengths equal (queries get a zero), so the greatest inner product is the
least distance. Every
vector is keyed by its nearest pivot and its distance from it. A query knows its own distance from the pivot; by the
triangle inequality a ring of vectors further than the k-th best distance away in that one number can't hold a better one.
So each task walks the rings of one pivot outwards from the query's own distance, and stops on both sides at that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fedlens.llm.common import stored

#: Rows the pivots and first bounds are fitted on, at most; every row is indexed and searched whatever the sample.
SAMPLE_ROWS = 4096
PIVOTS = 32
#: Vectors and queries of a tile. Vectors travel once for each QUERY_ROWS queries, queries once for each BLOCK_ROWS vectors.
BLOCK_ROWS = 16384
QUERY_ROWS = 16384
RING_ROWS = 256
#: What a task holds beside its tile: queries that are scored at once, routed rows of a batch, candidates not yet merged.
SCORED_ROWS = 1024
ROUTED_ROWS = 8192
HELD = 1 << 20
#: Tasks that tiles are dealt over, at most.
TILE_TASKS = 2000
FOUND = "query_row long, query_id long, vec_id long, score long"
INDEXED = pa.schema([("vec_id", pa.int64()), ("row", pa.int64()), ("asks", pa.bool_()), ("v", pa.binary()), ("pivot", pa.int32()), ("away", pa.float64())])
ROUTED = pa.schema([("vec_id", pa.int64()), ("row", pa.int64()), ("v", pa.binary()), ("pivot", pa.int32()), ("part", pa.int32()), ("away", pa.float64()), ("floor", pa.float64())])


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, factor: int = 64) -> DataFrame:
    """``vec_id`` and ``v``, every component turned into floor(factor * x).

    Null ids, null vectors, and vectors that hold null, NaN or infinity take no part, nor do empty ones.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * factor).cast("long"))
    return vectors.where(usable & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column) -> np.ndarray:
    return np.array(list(column), "float64").reshape(len(column), -1 if len(column) else 0)


def narrowest(most: int) -> str:
    """The shortest whole numbers that hold ``most`` and its negative."""
    return next((f"int{n}" for n in (8, 16, 32) if most < 1 << n - 1), "int64")


def packed(v: np.ndarray, kind: str) -> pa.Array:
    """A binary value a row of whole numbers."""
    data = np.ascontiguousarray(v.astype(kind))
    ends = np.arange(len(v) + 1, dtype="int32") * (data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(values, kind: str, exact: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(exact)


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Spread-out rows of the sample: each next pivot is the row furthest from those before."""
    if not len(sample):
        return np.zeros((0, 0))
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lengthened(v: np.ndarray, radius2: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(radius2 - (v * v).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query the ``k`` other rows with the highest integer inner product.

    ``vectors`` has ``vec_id`` and ``v`` (``whole_vectors``), with components below 2**26 / sqrt(length) so that products
    are exact. Vectors of another length than the commonest (of equally common ones the least) take no part. Ties go to the
    smaller ``vec_id``. Every row but the query's own is a candidate: repeated rows are candidates each, also for each
    other, and a query row that is repeated is answered as often. A query with fewer candidates gets all. No queries or an
    empty table give no rows.
    """
    usual = vectors.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.min_by("n", F.struct(-F.col("c"), "n"))).first()[0]
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    rows = vectors.where(F.size("v") == (usual or 0)).select("vec_id", "v", asks).withColumn("row", F.monotonically_increasing_id())
    rows = stored(spark, rows, "vectors")  # written, so a row keeps its number
    squares = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c))
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    limits = rows.agg(squares, largest, F.count(F.when(F.col("asks"), 1))).first()
    radius2, kind, n_queries = float(limits[0] or 0), narrowest(limits[1] or 0), limits[2]
    # no sum of products is beyond radius2, so it is exact in the shorter numbers below 2**24
    exact = "float32" if radius2 < 1 << 24 else "float64"
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE_ROWS).select("row", "v").toPandas()
    sample, sample_rows = _matrix(picked["v"]), picked["row"].to_numpy()
    pivots = lengthened(fit_pivots(sample, PIVOTS), radius2) if len(sample) else sample

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
            d = distances(lengthened(v.astype("float64"), radius2), pivots)
            nearest = d.argmin(1)
            more = [packed(v, kind), pa.array(nearest.astype("int32")), pa.array(d[np.arange(len(v)), nearest])]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["row"], batch["asks"], *more], schema=INDEXED)

    keyed = rows.mapInArrow(key, "vec_id long, row long, asks boolean, v binary, pivot int, away double")
    indexed = stored(spark, keyed, "pivot-index")
    shells = indexed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).toPandas()
    reach = {int(r.pivot): (r.low, r.high, -(-int(r.n) // BLOCK_ROWS)) for r in shells.itertuples()}
    query_parts = max(1, -(-int(n_queries) // QUERY_ROWS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from routes(batch, kind, exact, sample.astype(exact), sample_rows, pivots, reach, radius2, k)

    block = F.lit(0)
    for p, (_, _, n) in reach.items():
        if n > 1:
            block = F.when(F.col("pivot") == p, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).otherwise(block)
    every = F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))) if query_parts > 1 else F.lit(0)
    blocks = indexed.drop("asks").withColumn("part", block.cast("int")).withColumn("query_part", every)
    routed = indexed.where("asks").select("vec_id", "row", "v").mapInArrow(route, "vec_id long, row long, v binary, pivot int, part int, away double, floor double")
    routed = routed.withColumn("query_part", F.pmod(F.xxhash64("row"), F.lit(query_parts)).cast("int"))

    def search(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return search_rings(queries, found, radius2, k, kind, exact)

    keys = ["pivot", "part", "query_part"]
    # tiles are small for the work that they are, so their number and not their size says how many tasks there are
    tasks = min(TILE_TASKS, max(1, query_parts * sum(n for _, _, n in reach.values())))
    sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (routed, blocks)]
    found = sides[0].cogroup(sides[1]).applyInPandas(search, FOUND)
    rank = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_score(q: np.ndarray, gap: np.ndarray, radius2: float) -> np.ndarray:
    """Greatest inner product at a distance of at least ``gap``; half a unit covers rounding, as scores are whole."""
    return ((q * q).sum(1) + radius2 - gap**2) / 2 + 0.5


def routes(batch: pa.RecordBatch, kind: str, exact: str, sample: np.ndarray, sample_rows: np.ndarray, pivots: np.ndarray, reach: dict[int, tuple[float, float, int]], radius2: float, k: int) -> Iterator[pa.RecordBatch]:
    """A query goes to every block of each pivot whose shell may hold a better vector than the sample's k-th.

    ``reach`` has the least and greatest distance of a pivot's vectors and the number of its blocks. Queries are scored
    SCORED_ROWS at a time and leave in batches of ROUTED_ROWS, whatever the number of blocks.
    """
    names, shells = np.array(list(reach)), np.array(list(reach.values())).reshape(-1, 3)
    parts = shells[:, 2].astype("int64")
    for start in range(0, batch.num_rows, SCORED_ROWS):
        some = batch.slice(start, SCORED_ROWS)
        q, own = unpacked(some["v"].to_pylist(), kind, exact), some["row"].to_numpy()
        scores = q @ sample.T
        scores[own[:, None] == sample_rows[None, :]] = -np.inf
        floor = np.partition(scores, -k, axis=1)[:, -k].astype("float64") if len(sample) >= k else np.full(len(q), -np.inf)
        q = q.astype("float64")
        d = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)[:, names]
        gap = np.maximum(np.maximum(shells[:, 0] - d, d - shells[:, 1]), 0)
        able = best_score(q, gap.T, radius2).T >= floor[:, None]
        for few in np.array_split(np.arange(len(q)), max(1, -(-len(q) * int(parts.sum()) // ROUTED_ROWS))):
            at, shell = np.nonzero(able[few])
            if not len(at):
                continue
            times = parts[shell]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, shell = few[np.repeat(at, times)], np.repeat(shell, times)
            for cut in range(0, len(at), ROUTED_ROWS):
                a, p = at[cut : cut + ROUTED_ROWS], shell[cut : cut + ROUTED_ROWS]
                sent = some.take(pa.array(a))
                more = [names[p].astype("int32"), part[cut : cut + ROUTED_ROWS].astype("int32"), d[a, p], floor[a]]
                yield pa.RecordBatch.from_arrays([sent["vec_id"], sent["row"], sent["v"], *map(pa.array, more)], schema=ROUTED)


def search_rings(queries: pd.DataFrame, found: pd.DataFrame, radius2: float, k: int, kind: str, exact: str) -> pd.DataFrame:
    """Best ``k`` of one block of one pivot for each query that came to it, as far as they reach the sample's k-th."""
    empty = pd.DataFrame({c: np.zeros(0, "int64") for c in ("query_row", "query_id", "vec_id", "score")})
    if not len(queries) or not len(found):
        return empty
    found, queries = found.sort_values(["away", "vec_id"]), queries.sort_values("away")
    v, ids, away, rows = unpacked(found["v"], kind, exact), found["vec_id"].to_numpy(), found["away"].to_numpy(), found["row"].to_numpy()
    cuts = np.arange(0, len(v), RING_ROWS)
    ends = np.append(cuts[1:], len(v))
    low, high = away[cuts], away[ends - 1]
    out = []
    for start in range(0, len(queries), SCORED_ROWS):  # queries that are about as far away walk the same rings
        some = queries.iloc[start : start + SCORED_ROWS]
        q, q_rows, own = unpacked(some["v"], kind, exact), some["row"].to_numpy(), some["away"].to_numpy()
        q2 = q.astype("float64")
        gap = np.maximum(np.maximum(low[None, :] - own[:, None], own[:, None] - high[None, :]), 0)
        order = np.argsort(gap, axis=1, kind="stable")
        best = Best(len(q), k, some["floor"].to_numpy())
        alive = np.arange(len(q))
        for step in range(len(cuts)):
            ring = order[alive, step]
            alive = alive[best_score(q2[alive], gap[alive, ring], radius2) >= best.floor[alive]]  # later rings are further still
            if not len(alive):
                break
            ring = order[alive, step]
            for r in np.unique(ring):
                at, ring_ids = alive[ring == r], ids[cuts[r] : ends[r]]
                scores = q[at] @ v[cuts[r] : ends[r]].T
                floor = best.floor[at].astype(exact)[:, None]
                i, j = np.nonzero(scores >= floor)
                level = scores[i, j] == floor[i, 0]
                keep = ~(level & best.full[at[i]] & (ring_ids[j] >= best.last[at[i]])) & (q_rows[at[i]] != rows[cuts[r] + j])
                i, j = i[keep], j[keep]
                best.add(at[i], scores[i, j], ring_ids[j])
        best.merge()
        out.append(pd.DataFrame({"query_row": q_rows[best.at], "query_id": some["vec_id"].to_numpy()[best.at], "vec_id": best.ids, "score": best.scores.astype("int64")}))
    return pd.concat(out)


class Best:
    """The best ``k`` candidates of each query, merged once HELD of them wait.

    ``floor`` is the least score that counts, and once a query is ``full``, ``last`` is the id below which it does.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.full, self.last = k, floor.astype("float64"), np.zeros(n, bool), np.zeros(n, "int64")
        self.at, self.scores, self.ids = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((at, scores, ids))
        self.n += len(at)
        if self.n >= HELD:
            self.merge()

    def merge(self) -> None:
        at, scores, ids = map(np.concatenate, zip((self.at, self.scores, self.ids), *self.waiting))
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, "int64")
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        whole = place == self.k - 1
        self.floor[at[whole]], self.full[at[whole]], self.last[at[whole]] = scores[whole], True, ids[whole]
        near = place < self.k
        self.at, self.scores, self.ids = at[near], scores[near], ids[near]
        self.waiting, self.n = [], 0
