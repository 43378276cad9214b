"""Scoring and fitting of a multinomial linear head on feature arrays.

A head is one model: classes x positions weights, a size the configuration fixes. A shared head goes
from the driver to the tasks the way a server sends its model to its clients; heads of single clients
meet their rows by chunks, one copy a chunk. Rows never leave the executors; inside a task, whole
batches are scored with one matrix product, and gradients leave it as matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedlens.functions.hashing import draw
from fedlens.operators.ranking import rank_by_draw
from fedlens.session import cut_lineage, workspace

CHUNK_ROWS = 50_000  # rows of one client that meet in a task
HELD_MATRICES = 2048  # gradient matrices a task sums before it hands them on

SCORE_TYPE = "struct<predicted:int, loss:double>"


def head_from_long(head: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cls, pos, w) rows -> one row per key holding the head as an array of class vectors."""
    ordered = lambda items, field: F.transform(F.array_sort(items), lambda s: s[field])
    by_class = head.groupBy(*keys, "cls").agg(ordered(F.collect_list(F.struct("pos", "w")), "w").alias("weights"))
    return by_class.groupBy(*keys).agg(ordered(F.collect_list(F.struct("cls", "weights")), "weights").alias("head"))


def head_matrix(head: DataFrame) -> np.ndarray:
    """(cls, pos, w) rows of one model -> matrix on the driver, to be sent with the tasks."""
    cells = head.select("cls", "pos", "w").toPandas()
    return cells.pivot(index="cls", columns="pos", values="w").sort_index().sort_index(axis=1).to_numpy()


def _matrix(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(features), -1)


def _judge(logits: np.ndarray, labels: np.ndarray) -> pa.StructArray:
    """Predicted class (lowest on ties) and cross-entropy, null for a label that is no class."""
    top = logits.max(axis=1)
    norm = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    valid = (labels >= 0) & (labels < logits.shape[1])
    rows, own = np.arange(len(labels)), np.where(valid, labels, 0).astype(int)
    loss = pa.array(norm - logits[rows, own], mask=~valid)
    return pa.StructArray.from_arrays([pa.array(logits.argmax(axis=1).astype(np.int32)), loss], ["predicted", "loss"])


def _judged(rows: DataFrame, head: np.ndarray) -> DataFrame:
    """``rows`` with ``_s``: their judgement under one head, a matrix product per Arrow batch."""

    @F.arrow_udf(SCORE_TYPE)
    def score(features: pa.Array, labels: pa.Array) -> pa.Array:
        return _judge(_matrix(features) @ head.T, labels.to_numpy(zero_copy_only=False))

    return rows.withColumn("_s", score("features", "label"))


def in_chunks(rows: DataFrame, keys: Sequence[str], chunk_rows: int, id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Rows with ``_chunk``, about ``chunk_rows`` of a key in each, and the number of chunks of every key."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("_chunks"))
    sizes = cut_lineage(rows.sparkSession, sizes, "chunks")  # of known size where rows are joined to it
    chunk = F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int")
    return rows.join(sizes, list(keys)).withColumn("_chunk", chunk).drop("_chunks"), sizes


def with_own_head(
    rows: DataFrame, heads: DataFrame, work: Callable[[tuple, pa.Table, np.ndarray], pa.Table], schema: T.StructType,
    keys: Sequence[str] = ("client_id",), chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``work`` on every chunk of a key's rows with the key's head; rows of keys without a head are left out.

    A head travels once a chunk and never on a row, and a key with most of the rows is spread over its chunks.
    """
    chunked, sizes = in_chunks(rows, keys, chunk_rows)
    each = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    sent = heads.select(*keys, "head").join(sizes, list(keys)).withColumn("_chunk", each).drop("_chunks")
    both = [*keys, "_chunk"]
    empty = pa.schema(_arrow_fields(schema)).empty_table()

    def on_chunk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return work(key, left, np.array(right["head"][0].as_py(), float))

    return chunked.groupBy(*both).cogroup(sent.groupBy(*both)).applyInArrow(on_chunk, schema)


def _schema_of(spark: SparkSession, text: str) -> T.StructType:
    return spark.createDataFrame([], text).schema


def _arrow_fields(schema: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema]


def predict(rows: DataFrame, head: np.ndarray) -> DataFrame:
    """Adds ``predicted`` and the cross-entropy ``loss`` under one shared head."""
    return _judged(rows, head).select(*rows.columns, "_s.predicted", "_s.loss")


def predict_personal(rows: DataFrame, heads: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As ``predict``, every row under the head of its own client."""
    kept = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("predicted", T.IntegerType()), T.StructField("loss", T.DoubleType())])

    def score(key: tuple, left: pa.Table, head: np.ndarray) -> pa.Table:
        logits = _matrix(left["features"].combine_chunks()) @ head.T
        judged = _judge(logits, left["label"].to_numpy())
        own = left.select(kept)
        return own.append_column("predicted", judged.field("predicted")).append_column("loss", judged.field("loss"))

    return with_own_head(rows, heads, score, schema, chunk_rows=chunk_rows)


def with_head(clients: DataFrame, head: DataFrame) -> DataFrame:
    """Adds the one-row ``head`` to every client as a scalar subquery: no join."""
    return clients.withColumn("head", head.scalar())


def personal_heads(clients: DataFrame, saved: DataFrame, shared: DataFrame) -> DataFrame:
    """The saved head of each client, or the shared one where none was saved."""
    return (
        with_head(clients, shared)
        .join(saved.withColumnRenamed("head", "_saved"), "client_id", "left")
        .select(*clients.columns, F.coalesce("_saved", "head").alias("head"))
    )


def clients_without_head(clients: DataFrame, saved: DataFrame) -> DataFrame:
    return clients.join(saved, "client_id", "left_anti")


def head_to_long(heads: DataFrame, *keys: str) -> DataFrame:
    """Array heads -> (keys, cls, pos, w) rows."""
    return heads.select(*keys, F.posexplode("head").alias("cls", "_row")).select(
        *keys, "cls", F.posexplode("_row").alias("pos", "w")
    )


def _sums(features: np.ndarray, labels: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Summed gradient matrix, summed cross-entropy and number of rows."""
    logits = features @ head.T
    top = logits.max(axis=1)
    norm = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    residual = np.exp(logits - norm[:, None])
    at = np.flatnonzero((labels >= 0) & (labels < len(head)))
    own = labels[at].astype(int)
    residual[at, own] -= 1.0
    return residual.T @ features, float((norm[at] - logits[at, own]).sum()), len(labels)


def gradient_sums(
    rows: DataFrame, head: np.ndarray | DataFrame, keys: Sequence[str] = ("client_id",), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Partial sums (keys, g, loss, n) under one head or the keys' own: ``g`` is residual^T features, class by class.

    Tasks hand on one matrix a key (a chunk, with own heads), not a row a feature.
    """
    keys = list(keys)
    rows = rows.select(*keys, "sample_id", "label", "features")
    summed = [T.StructField("g", T.ArrayType(T.DoubleType())), T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType())]
    schema = T.StructType([*[rows.schema[k] for k in keys], *summed])
    fields = pa.schema(_arrow_fields(schema))
    table_of = lambda found: pa.Table.from_arrays(
        [pa.array(c, f.type) for c, f in zip(list(zip(*found)) or [[]] * len(fields), fields)], schema=fields
    )
    if isinstance(head, DataFrame):

        def on_chunk(key: tuple, left: pa.Table, own: np.ndarray) -> pa.Table:
            g, loss, n = _sums(_matrix(left["features"].combine_chunks()), left["label"].to_numpy(), own)
            return table_of([(*(k.as_py() for k in key[:-1]), g.ravel(), loss, n)])

        return with_own_head(rows, head, on_chunk, schema, keys, chunk_rows)

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            x, y = _matrix(batch["features"]), batch["label"].to_numpy(zero_copy_only=False)
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(batch[k].to_pylist() for k in keys))):
                places.setdefault(key, []).append(at)
            for key, at in places.items():
                found = _sums(x[at], y[at], head)
                held[key] = [a + b for a, b in zip(held[key], found)] if key in held else list(found)
            if len(held) >= HELD_MATRICES:
                yield from table_of([(*k, g.ravel(), loss, n) for k, (g, loss, n) in held.items()]).to_batches()
                held = {}
        yield from table_of([(*k, g.ravel(), loss, n) for k, (g, loss, n) in held.items()]).to_batches()

    return rows.mapInArrow(on_batches, schema)


def summed_by_cell(sums: DataFrame, n_classes: int, keys: Sequence[str] = ("client_id",)) -> DataFrame:
    """Partial matrices -> (keys, cls, pos, g, loss, n) with mean gradient, summed loss and number of rows of the key."""
    width = (F.size("g") / F.lit(n_classes)).cast("int").alias("_width")
    cells = sums.select(*keys, "loss", "n", width, F.posexplode("g").alias("_at", "g"))
    place = [F.expr("_at div _width").cast("int").alias("cls"), (F.col("_at") % F.col("_width")).alias("pos")]
    total = cells.groupBy(*keys, *place).agg(F.sum("g").alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    return total.withColumn("g", F.col("g") / F.col("n"))


def client_gradient(rows: DataFrame, n_classes: int, head: np.ndarray | DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean cross-entropy gradient of every client under ``head``, or under its own of a frame: (client_id, cls, pos, g, n)."""
    cells = summed_by_cell(gradient_sums(rows, head, chunk_rows=chunk_rows), n_classes)
    return cells.select("client_id", "cls", "pos", "g", "n")


def proximal_step(gradient: DataFrame, local: DataFrame, shared: DataFrame, lr: float, mu: float) -> DataFrame:
    """One descent step of every client with the pull mu (w - w_shared) towards the shared head."""
    w, x = F.col("w"), F.col("_x")
    return (
        gradient.join(local, ["client_id", "cls", "pos"])
        .join(shared.select("cls", "pos", F.col("w").alias("_x")), ["cls", "pos"])
        .select("client_id", "cls", "pos", (w - F.lit(lr) * (F.col("g") + F.lit(mu) * (w - x))).alias("w"), "n")
    )


def _sgd_chunk(
    features: np.ndarray, labels: np.ndarray, weights: np.ndarray, velocity: np.ndarray, start: np.ndarray, batch_size: int,
    lr: float, momentum: float, mu: float,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Minibatch descent with momentum over consecutive batches: the head, its velocity and the summed loss."""
    loss_sum = 0.0
    for lo in range(0, len(labels), batch_size):
        x, y = features[lo : lo + batch_size], labels[lo : lo + batch_size]
        gradient, loss, n = _sums(x, y, weights)
        loss_sum += loss + 0.5 * mu * float(np.square(weights - start).sum()) * n
        velocity = momentum * velocity + gradient / n + mu * (weights - start)
        weights = weights - lr * velocity
    return weights, velocity, loss_sum


UNIT = ["client_id", "unit"]
MATRIX = "array<array<double>>"
FIT_SCHEMA = f"client_id int, unit bigint, weights {MATRIX}, train_loss double, num_examples bigint"
FOLD_SCHEMA = f"client_id int, unit bigint, weights {MATRIX}, velocity {MATRIX}, start {MATRIX}, loss_sum double, seen bigint"


def fit_units(
    rows: DataFrame, head: np.ndarray | DataFrame, *, seed: int | Column, epochs: int = 1, batch_size: int | None = 32,
    lr: float = 0.01, momentum: float = 0.9, mu: float = 0.0, workers: int = 1, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Local minibatch training of every client by ``workers`` workers.

    ``head`` is the shared head, or a frame with one head per client. A row's seeded draw decides
    its worker and its place in the order, so the result hangs neither on partitioning nor on
    ``chunk_rows``, and the same rule holds for clients of every size. With one worker a client is
    trained as on a single machine; several start from the same head, and ``merge_units`` averages
    them by examples, which is another training rule. Without a ``batch_size`` a step takes all rows
    of the worker. No task ever holds more than about ``chunk_rows`` rows of a worker.
    """
    order = draw(seed, "fit", "sample_id")
    rows = rows.select("client_id", F.pmod(order, F.lit(workers)).cast("bigint").alias("unit"), order.alias("_order"), "sample_id", "label", "features")
    if isinstance(head, DataFrame):
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(workers - 1).cast("bigint")))
        head = head.select("client_id", "head").withColumn("unit", each)
    if batch_size is None:
        return _fit_full_batch(rows, head, epochs, lr, momentum, mu, chunk_rows)
    return _fit_chained(rows, head, epochs, batch_size, lr, momentum, mu, chunk_rows)


def _fit_chained(
    rows: DataFrame, head: np.ndarray | DataFrame, epochs: int, batch_size: int, lr: float, momentum: float, mu: float, chunk_rows: int
) -> DataFrame:
    """Folds the chunks of every worker in order: what chunk k leaves, a small table, starts chunk k + 1.

    Workers run side by side; a chunk has whole batches. Where every worker has one chunk there is nothing to rank or write.
    """
    spark = rows.sparkSession
    per_chunk = max(1, chunk_rows // batch_size) * batch_size
    largest = rows.groupBy(*UNIT).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    chunks = max(1, -(-largest // per_chunk))
    dealt = rows.withColumn("_chunk", F.lit(0))
    if chunks > 1:
        ranked = rank_by_draw(rows, F.col("_order"), "sample_id", UNIT)
        number = F.floor((F.col("rank") - 1) / F.lit(per_chunk)).cast("int")
        path = workspace(spark, "fit-chunks")
        ranked.select(*rows.columns, number.alias("_chunk")).repartition(*UNIT, "_chunk").write.partitionBy("_chunk").parquet(path)
        dealt = spark.read.schema(T.StructType([*rows.schema, T.StructField("_chunk", T.IntegerType())])).parquet(path)
    shared = None if isinstance(head, DataFrame) else head  # a task must not carry a frame

    fields = pa.schema(_arrow_fields(_schema_of(spark, FOLD_SCHEMA)))

    def fold(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or (not right.num_rows and shared is None):
            return pa.Table.from_pylist(right.to_pylist(), schema=fields)  # none left of this worker
        if right.num_rows:
            last = right.to_pylist()[0]
            weights, velocity, start = (np.array(last[c], float) for c in ("weights", "velocity", "start"))
            loss_sum, seen = last["loss_sum"], last["seen"]
        else:
            weights, velocity, start, loss_sum, seen = shared, np.zeros_like(shared), shared, 0.0, 0
        left = left.sort_by([("_order", "ascending"), ("sample_id", "ascending")])
        x, y = _matrix(left["features"].combine_chunks()), left["label"].to_numpy()
        weights, velocity, loss = _sgd_chunk(x, y, weights, velocity, start, batch_size, lr, momentum, mu)
        row = (*(k.as_py() for k in key), weights.tolist(), velocity.tolist(), start.tolist(), loss_sum + loss, seen + len(y))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields)], schema=fields)

    if shared is None:
        still = F.transform("head", lambda row: F.transform(row, lambda w: F.lit(0.0)))
        state = head.select(*UNIT, F.col("head").alias("weights"), still.alias("velocity"), F.col("head").alias("start"), F.lit(0.0).alias("loss_sum"), F.lit(0).cast("bigint").alias("seen"))
    else:
        state = spark.createDataFrame([], FOLD_SCHEMA)
    steps = [chunk for _ in range(epochs) for chunk in range(chunks)]
    for at, chunk in enumerate(steps):
        now = dealt.where(F.col("_chunk") == chunk) if chunks > 1 else dealt
        state = now.groupBy(*UNIT).cogroup(state.groupBy(*UNIT)).applyInArrow(fold, FOLD_SCHEMA)
        if at + 1 < len(steps):
            state = cut_lineage(spark, state, "fit-state")
    n = (F.col("seen") / F.lit(epochs)).cast("bigint")
    return state.where("seen > 0").select(*UNIT, "weights", (F.col("loss_sum") / n).alias("train_loss"), n.alias("num_examples"))


def _fit_full_batch(
    rows: DataFrame, head: np.ndarray | DataFrame, epochs: int, lr: float, momentum: float, mu: float, chunk_rows: int
) -> DataFrame:
    """A step takes all rows of a worker: its gradient is summed from matrices, so its rows never meet."""
    spark, shared = rows.sparkSession, None if isinstance(head, DataFrame) else head
    cell = [*UNIT, "cls", "pos"]
    long = lambda heads: head_to_long(heads.withColumnRenamed("weights", "head"), *UNIT)
    first = None if shared is not None else head
    n_classes = len(shared) if shared is not None else head.select(F.size("head")).head()[0]
    state = None  # cells of every worker: start, weight, velocity, summed loss
    for _ in range(epochs):
        heads = shared if shared is not None and state is None else first if state is None else _heads_of(state)
        found = cut_lineage(spark, summed_by_cell(gradient_sums(rows, heads, UNIT, chunk_rows), n_classes, UNIT), "fit-gradient")
        if state is None:
            if shared is not None:
                # one weight of the shared head per cell, looked up in a literal of the model's size
                start = F.lit(shared.ravel().tolist())[F.col("cls") * shared.shape[1] + F.col("pos")]
                cells = found.select(*cell, start.alias("start"))
            else:
                cells = found.join(long(first).withColumnRenamed("w", "start"), cell).select(*cell, "start")
            state = cells.select(*cell, "start", F.col("start").alias("w"), F.lit(0.0).alias("v"), F.lit(0.0).alias("loss_sum"))
        pull = F.col("w") - F.col("start")
        drift = state.groupBy(*UNIT).agg(F.sum(pull * pull).alias("_far"))
        stepped = found.join(state.drop("n"), cell).join(drift, UNIT)
        velocity = F.lit(momentum) * F.col("v") + F.col("g") + F.lit(mu) * pull
        loss = F.col("loss_sum") + F.col("loss") + F.lit(0.5 * mu) * F.col("_far") * F.col("n")
        stepped = stepped.select(*cell, "start", "w", velocity.alias("v"), loss.alias("loss_sum"), "n")
        stepped = stepped.withColumn("w", F.col("w") - F.lit(lr) * F.col("v"))
        state = cut_lineage(spark, stepped, "fit-state")
    totals = state.groupBy(*UNIT).agg((F.first("loss_sum") / F.first("n")).alias("train_loss"), F.first("n").alias("num_examples"))
    return _heads_of(state).withColumnRenamed("head", "weights").join(totals, UNIT).select(*UNIT, "weights", "train_loss", "num_examples")


def _heads_of(state: DataFrame) -> DataFrame:
    return head_from_long(state.select(*UNIT, "cls", "pos", "w"), UNIT)


def merge_units(fitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units -> (client weights as (client_id, cls, pos, w), replies per client)."""
    long = fitted.select("client_id", "num_examples", F.posexplode("weights").alias("cls", "row")).select(
        "client_id", "num_examples", "cls", F.posexplode("row").alias("pos", "w")
    )
    n = F.col("num_examples")
    weights = long.groupBy("client_id", "cls", "pos").agg(
        (F.sum(n * F.col("w")) / F.sum(n)).alias("w"), F.sum(n).alias("n")
    )
    replies = fitted.groupBy("client_id").agg(
        (F.sum(n * F.col("train_loss")) / F.sum(n)).alias("train_loss"), F.sum(n).alias("num_examples")
    )
    return weights, replies
