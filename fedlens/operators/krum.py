"""Distance-based selection of client updates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.functions.hashing import draw
from fedlens.operators.combine import COORD
from fedlens.operators.ranking import rank_by_draw
from fedlens.session import cut_lineage

TILE_BYTES = 32 * 1024 * 1024  # vectors of one tile held by a task
TILE_CLIENTS = 256
SCORE_CLIENTS = 1024
SCORE_BYTES = 64 * 1024 * 1024  # vectors and greatest distances of the clients that one task scores

DISTANCE_SCHEMA = "round int, client_id int, other_ids array<int>, sq_dist array<double>"


def tile_size(n_params: int) -> int:
    """Clients of one tile: their vectors stay within ``TILE_BYTES``, and a corner of the matrix is a task's work."""
    return max(1, min(TILE_CLIENTS, TILE_BYTES // (8 * n_params)))


def tile_count(total_nodes: int, n_params: int) -> int:
    """Tiles that hold ``total_nodes`` clients."""
    return max(1, math.ceil(total_nodes / tile_size(n_params)))


def _stack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["client_id", "layer", "block"])
    ids, vectors = [], []
    for client, rows in pdf.groupby("client_id", sort=True):
        ids.append(client)
        vectors.append(np.concatenate(rows["vals"].to_list()))
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("client updates differ in size")
    return np.array(ids), np.stack(vectors)


def _dealt(updates: DataFrame, size: int) -> DataFrame:
    """``round, client_id, tile``: runs of ``size`` clients by their rank among those that replied."""
    replied = updates.select("round", "client_id").distinct()
    ranked = rank_by_draw(replied, draw(0, "tile", "round", "client_id"), "client_id", ["round"], bits=6)
    dealt = ranked.select("round", "client_id", F.floor((F.col("rank") - 1) / F.lit(size)).cast("int").alias("tile"))
    return cut_lineage(updates.sparkSession, dealt, "tiles")  # a row a client, of known size where vectors are joined to it


def tile_distances(updates: DataFrame, total_nodes: int, n_params: int) -> DataFrame:
    """Squared distances of every client to the clients of one tile per row.

    The distance matrix is cut into tile pairs. Tiles are runs of ``tile_size`` clients by their rank among those that
    replied, so none holds more; a task has the vectors of two tiles and returns its corner of the matrix as arrays.
    ``updates`` are blocked rows, ``total_nodes`` an upper bound on the clients of a round.
    """
    size, tiles = tile_size(n_params), tile_count(total_nodes, n_params)
    pairs = (
        updates.select("round", "client_id", "layer", "block", "vals")
        .join(_dealt(updates, size), ["round", "client_id"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    )

    def corner(pdf: pd.DataFrame) -> pd.DataFrame:
        rnd, lo, hi = int(pdf["round"].iloc[0]), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        sides = [pdf[pdf["tile"] == t] for t in (lo, hi)]
        if any(side.empty for side in sides):
            return pd.DataFrame(columns=["round", "client_id", "other_ids", "sq_dist"])
        (a_ids, a), (b_ids, b) = (_stack(side) for side in sides)
        dist = np.stack([np.square(b - row).sum(axis=1) for row in a])
        rows = [(rnd, int(c), b_ids[b_ids != c].tolist(), dist[i][b_ids != c].tolist()) for i, c in enumerate(a_ids)]
        if lo != hi:
            rows += [(rnd, int(c), a_ids.tolist(), dist[:, j].tolist()) for j, c in enumerate(b_ids)]
        return pd.DataFrame(rows, columns=["round", "client_id", "other_ids", "sq_dist"])

    return pairs.groupBy("round", "lo", "hi").applyInPandas(corner, DISTANCE_SCHEMA)


def pairwise_distances(distances: DataFrame) -> DataFrame:
    """One row per unordered pair of clients."""
    return (
        distances.select("round", "client_id", F.inline(F.arrays_zip("other_ids", "sq_dist")))
        .where(F.col("client_id") < F.col("other_ids"))
        .select("round", F.col("client_id").alias("client_a"), F.col("other_ids").alias("client_b"), "sq_dist")
    )


def _far_count(n_clients: int, n_malicious: int) -> int:
    """How many of a client's distances do not count: all but the n - f - 2 smallest (at least one)."""
    return max(0, n_clients - 1 - max(1, n_clients - n_malicious - 2))


def krum_scores(distances: DataFrame, n_clients: int, n_malicious: int) -> DataFrame:
    """Sum of the n - f - 2 smallest squared distances of each of ``n_clients`` clients (at least one).

    All but the f + 1 greatest count, so a client's state is one sum and its greatest distances so far. Corners are cut to
    that form where they are made and merged as arrays: no row per pair, and sums only ever add, so far-off attackers
    take no digits from the others.
    """
    far = _far_count(n_clients, n_malicious)
    near = F.greatest(F.size("_d") - far, F.lit(0))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    corner = distances.select("round", "client_id", F.array_sort("sq_dist").alias("_d"))
    corner = corner.select("round", "client_id", total(F.slice("_d", F.lit(1), near)).alias("_near"), F.slice("_d", near + 1, F.lit(far)).alias("_far"))
    merged = corner.groupBy("round", "client_id").agg(F.sum("_near").alias("_near"), F.array_sort(F.flatten(F.collect_list("_far"))).alias("_d"))
    score = F.col("_near") + total(F.slice("_d", F.lit(1), near))
    return merged.select("round", "client_id", score.alias("score"))


class _Scorer:
    """Scores of one tile's clients; the vectors of a round are added in portions, so no distances but the greatest are held."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, far: int):
        self.ids, self.vectors, self.far = ids, vectors, far
        self.near, self.kept = np.zeros(len(ids)), [np.zeros(0)] * len(ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if vectors.shape[1] != self.vectors.shape[1]:
            raise ValueError("client updates differ in size")
        columns = np.ascontiguousarray(vectors.T)  # sums over short rows take ten times as long
        gap = np.empty_like(columns)
        for i, (own, vector) in enumerate(zip(self.ids, self.vectors)):
            np.subtract(columns, vector[:, None], out=gap)
            np.multiply(gap, gap, out=gap)
            held = np.concatenate([self.kept[i], gap.sum(axis=0)[ids != own]])
            near = len(held) - self.far
            if near > 0:
                if self.far:
                    held = np.partition(held, near)
                self.near[i] += held[:near].sum()
                held = held[near:].copy()
            self.kept[i] = held

    def rows(self, rnd: int) -> pd.DataFrame:
        return pd.DataFrame({"round": rnd, "client_id": self.ids, "score": self.near})


def streamed_scores(updates: DataFrame, total_nodes: int, n_params: int, n_malicious: int) -> DataFrame:
    """``round, client_id, score`` as ``krum_scores`` has them for ``total_nodes`` clients, without a distance leaving a task.

    A client's greatest distances are a share of all (f + 1 of n - 1), so partial scores of tile pairs would be as large as the
    matrix. Here a task scores one tile and meets every vector of the round once, as a stream: it holds the tile, the
    greatest distances of its clients so far (``SCORE_BYTES``), and a portion of the others.
    """
    far = _far_count(total_nodes, n_malicious)
    size = max(1, min(SCORE_CLIENTS, SCORE_BYTES // (8 * (n_params + far))))
    portion = max(1, min(max(far, 4096), TILE_BYTES // (8 * n_params)))
    tiles = max(1, math.ceil(total_nodes / size))
    whole = updates.groupBy("round", "client_id").agg(F.array_sort(F.collect_list(F.struct("layer", "block", "vals"))).alias("_b"))
    vectors = whole.select("round", "client_id", F.flatten("_b.vals").alias("v")).join(_dealt(updates, size), ["round", "client_id"])
    sent = vectors.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    sent = sent.select("round", "of", (F.col("tile") != F.col("of")).alias("other"), "client_id", "v")

    def portions(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """Runs of rows with the same round, tile and side; other clients come in portions."""
        key, ids, held = None, [], []
        for pdf in frames:
            for rnd, of, other, client, v in zip(pdf["round"], pdf["of"], pdf["other"], pdf["client_id"], pdf["v"]):
                if (rnd, of, other) != key or (other and len(ids) == portion):
                    if ids:
                        yield key, np.array(ids), np.stack(held)
                    key, ids, held = (rnd, of, other), [], []
                ids.append(client)
                held.append(v)
        if ids:
            yield key, np.array(ids), np.stack(held)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, own = None, None
        for (rnd, of, other), ids, held in portions(frames):
            if not other:
                if own:
                    yield own.rows(tile[0])
                tile, own = (int(rnd), of), _Scorer(ids, held, far)
            if tile == (rnd, of):  # else a tile without clients of its own
                own.add(ids, held)
        if own:
            yield own.rows(tile[0])

    dealt = sent.repartition(2 * tiles, "round", "of").sortWithinPartitions("round", "of", "other", "client_id")
    return dealt.mapInPandas(score, "round int, client_id int, score double")


def krum_select(scores: DataFrame, n_select: int = 1, keys: Sequence[str] = ("round",)) -> DataFrame:
    """The ``n_select`` lowest scores of each round, client id breaking ties."""
    order = W.partitionBy(*keys).orderBy("score", "client_id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_select)


def multikrum(updates: DataFrame, selected: DataFrame, keys: Sequence[str] = COORD) -> DataFrame:
    """Plain mean of the selected clients' vectors."""
    return updates.join(selected, ["round", "client_id"], "left_semi").groupBy(*keys).agg(F.avg("v").alias("v"))
