"""Class-based bigram language model with exchange clustering, learnt from the corpus and applied to every document.

Words are counted first. Then documents that one task reads in turn make a block: the HEAD most frequent words go by rank,
the others get numbers of their block; blocks hold a bounded number of words and tokens. A block's other words are dealt over
buckets by hash and sent in their order, with the ranks before and after each training occurrence; what comes back are numbers
in the same order. Every pass over documents is over arrays of numbers.

Head words are clustered by exchange, all other words standing for one more class: each pass counts, for every word, the
classes before and after it; then words move to the class under which their neighbours are likeliest, half of them a pass so
that they don't all run to the same place. Every other word meets its contexts of all blocks by shuffle and moves, by the same
rule, to the likeliest class; a block gets back class and count of each of its words. Transitions are counted once more with
all words in their classes. Unknown words are a class of their own, for which half of each word met once stands in. A token's
probability is the transition between classes times the word's share of its class; all of it is a proper distribution over
the vocabulary and one unknown word.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import rows_of, stored

HEAD = 8192
CLASSES = 32
BANDS = 32
TOTAL = CLASSES + BANDS + 1
UNKNOWN = TOTAL - 1
PASSES = 4
BLOCK_WORDS, BLOCK_TOKENS = 1 << 17, 1 << 22
PIECE_TOKENS = 1 << 20
#: Shorter than any word, so it stands for the end of a document.
END = b""
BLOCKS = "block long, doc_id long, held_out boolean, ids array<int>, bucket int, words binary, uses binary, contexts binary"
BUCKET_TOKENS = 1 << 21


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of the training data; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def words_of_model(text: str | None) -> list[bytes]:
    """Lower-cased words and the end."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def word_counts(docs: DataFrame) -> DataFrame:
    """Training count of every word of the training documents."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)

        for doc_id, text in rows_of(batches):
            if not held_out(doc_id):
                held.update(words_of_model(text))
            if len(held) >= 2 * BLOCK_WORDS:
                yield sent()
                held.clear()
        if held:
            yield sent()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def in_blocks(docs: DataFrame, head: list[bytes], buckets: int) -> DataFrame:
    """Rows of documents (``ids``: ranks of head words, HEAD plus the number in the block of others) and of a block's other words.

    Both come from the same task, so a task that runs again replaces both. Other words are numbered by bucket, then in
    order. A bucket's row has its words, the training uses of each, and for each use the ranks before and after it, all
    compressed; HEAD stands for every word that is not of the head.
    """
    types = {"block": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "ids": pa.list_(pa.int32()), "bucket": pa.int32()}
    types |= {x: pa.binary() for x in ("words", "uses", "contexts")}
    schema = pa.schema(list(types.items()))

    def batch(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, t) for x, t in types.items()], schema=schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3).compress
        ranks = {w: i for i, w in enumerate(head)}
        numbers = lambda: defaultdict(count(HEAD).__next__, ranks)
        own, tokens, rows = numbers(), 0, []

        def sent() -> Iterator[pa.RecordBatch]:
            words = list(own)[len(head) :]
            of = np.fromiter(map(zlib.crc32, words), "int64", len(words)) % buckets
            order = np.array(sorted(range(len(words)), key=words.__getitem__), "int64")
            order = order[np.argsort(of[order], kind="stable")]
            place = np.arange(HEAD + len(words), dtype="int32")
            place[HEAD + order] = place[HEAD:].copy()
            ids = [place[r[2]] for r in rows]
            first = 0
            while first < len(rows):
                last, n = first, 0
                while last < len(rows) and n < PIECE_TOKENS:
                    last, n = last + 1, n + len(ids[last])
                ends = pa.array(np.cumsum([0, *map(len, ids[first:last])]), pa.int32())
                columns = {"block": pa.array(np.full(last - first, block)), "doc_id": pa.array([r[0] for r in rows[first:last]], pa.int64())}
                columns |= {"held_out": pa.array([r[1] for r in rows[first:last]]), "ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids[first:last])))}
                yield batch(last - first, columns)
                first = last
            # a document ends with the end of rank 0, which also stands before the next one
            flat = np.concatenate([np.zeros(1, "int32"), *(i for i, r in zip(ids, rows) if not r[1])])
            rank = np.minimum(flat, HEAD).astype("<u2")
            at = np.flatnonzero(flat >= HEAD)
            at = at[np.argsort(flat[at], kind="stable")]
            uses = np.bincount(flat[at] - HEAD, minlength=len(words))
            ends = np.append(0, np.cumsum(uses))
            edges = np.append(np.flatnonzero(np.append(True, np.diff(of[order]) != 0)), len(order)) if len(order) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                near = at[ends[i] : ends[j]]
                row = [block, None, None, None, int(of[order[i]]), squeeze(b" ".join([words[k] for k in order[i:j].tolist()])), squeeze(uses[i:j].astype("<u4").tobytes())]
                row.append(squeeze(np.concatenate([rank[near - 1], rank[near + 1]]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types.values())], schema=schema)

        for doc_id, text in rows_of(batches):
            words = words_of_model(text)
            ids = np.fromiter(map(own.__getitem__, words), "int32", len(words))
            rows.append((doc_id, held_out(doc_id), ids))
            tokens += len(ids)
            if len(own) >= len(head) + BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                yield from sent()
                block, own, tokens, rows = block + 1, numbers(), 0, []
        if rows:
            yield from sent()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(number, BLOCKS)


def coded(blocks: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, codes`` of every document; the words beyond the head get their classes on the way.

    A code is the rank of a head word, else HEAD plus CLASSES times the count plus the class, and HEAD of an unknown word.
    """

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        number: dict[bytes, int] = defaultdict(count().__next__)
        words = [np.array([number[w] for w in unpack(x).split(b" ")]) for x in rows["words"]]
        uses = [np.frombuffer(unpack(x), "<u4") for x in rows["uses"]]
        sides = [np.frombuffer(unpack(x), "<u2").reshape(2, -1).astype("int64") for x in rows["contexts"]]
        word = np.repeat(np.concatenate(words), np.concatenate(uses))
        codes = other_codes(model, word, *np.concatenate(sides, axis=1), len(number))
        return pd.DataFrame({"of": rows["block"], "bucket": rows["bucket"], "codes": [codes[w] for w in words]})

    others = blocks.where(F.col("words").isNotNull()).select("block", "bucket", "words", "uses", "contexts")
    tables = others.groupBy("bucket").applyInPandas(move, "of long, bucket int, codes array<long>")

    def look_up(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        code = np.concatenate([np.arange(HEAD), *table.sort_values("bucket")["codes"]]).astype("int64")
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "codes": [code[i] for i in docs["ids"]]})

    documents = blocks.where(F.col("ids").isNotNull()).select("block", "doc_id", "held_out", "ids")
    return documents.groupBy("block").cogroup(tables.groupBy("of")).applyInPandas(look_up, "doc_id long, held_out boolean, codes array<long>")


def other_codes(model: Model, word: np.ndarray, before: np.ndarray, after: np.ndarray, n_words: int) -> np.ndarray:
    """Codes of words by the ranks around their uses: each moves to the class under which it and its neighbours are likeliest.

    Contexts are counted before they are weighed, so their order changes nothing.
    """
    of = np.append(model.classes[:HEAD], CLASSES)  # the others are one class here
    uses = np.bincount(word, minlength=n_words)
    met, n = np.unique(np.concatenate([2 * word * TOTAL + of[before], (2 * word + 1) * TOTAL + of[after]]), return_counts=True)
    gain = np.concatenate([model.step[:, 1:CLASSES], model.step[1:CLASSES].T])
    found = np.zeros(len(uses), "int64")
    loss = np.log10(np.maximum(model.by_class[1:CLASSES], 0.5))
    first = np.flatnonzero(np.append(True, met[1:] // (2 * TOTAL) != met[:-1] // (2 * TOTAL))) if len(met) else np.zeros(0, "int64")
    for some in np.array_split(first, 1 + len(met) // 200_000):
        if not len(some):
            continue
        last = first[np.searchsorted(first, some[-1]) + 1] if some[-1] != first[-1] else len(met)
        part = slice(some[0], last)
        value = np.add.reduceat(n[part, None] * gain[met[part] % (2 * TOTAL)], some - some[0])
        at = met[some] // (2 * TOTAL)
        found[at] = 1 + (value - uses[at, None] * loss).argmax(1)
    return HEAD + CLASSES * uses + found


def units_of(codes: np.ndarray) -> np.ndarray:
    """Head words stand for themselves; the others for the size of their count, in powers of two; unknown ones come last."""
    rare = np.maximum(codes - HEAD, 0)
    band = np.where(rare > 0, np.minimum(np.frexp(rare.astype("float64"))[1] - 1, BANDS - 1), BANDS)
    return np.where(codes < HEAD, codes, HEAD + band)


def first_classes() -> np.ndarray:
    """Classes of all units: the end of a document alone, other head words in turn by rank, bands, unknown."""
    head = 1 + np.arange(HEAD) % (CLASSES - 1)
    head[0] = 0
    return np.concatenate([head, CLASSES + np.arange(BANDS + 1)])


def head_units(ids: np.ndarray) -> np.ndarray:
    """Head words stand for themselves, all others for one unit."""
    return np.minimum(ids, HEAD)


def context_counts(codes: DataFrame, classes: np.ndarray, units_of: Callable = units_of) -> np.ndarray:
    """How often each unit stands before and after each class, over all training documents: units x 2 x classes.

    Tasks send sums, and Spark adds them up; the result has a fixed number of entries.
    """
    n_units = len(classes)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_units * 2 * TOTAL, "int64")

        def add(docs: list[np.ndarray]) -> None:
            units = units_of(np.concatenate(docs))
            first = np.cumsum([0, *map(len, docs[:-1])])
            before = np.empty_like(units)
            before[1:], before[first] = units[:-1], 0
            size = n_units * 2 * TOTAL
            total[:] += np.bincount(units * 2 * TOTAL + classes[before], minlength=size)
            total[:] += np.bincount(before * 2 * TOTAL + TOTAL + classes[units], minlength=size)

        held, n = [], 0
        for pdf in frames:
            for doc in pdf["codes"]:
                held.append(np.asarray(doc))
                n += len(doc)
                if n >= PIECE_TOKENS:
                    add(held)
                    held, n = [], 0
        if held:
            add(held)
        at = np.flatnonzero(total)
        for some in np.array_split(at, max(1, len(at) // 50_000)):
            yield pd.DataFrame({"at": some, "n": total[some]})

    sums = codes.where(~F.col("held_out")).select("codes").mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(n_units * 2 * TOTAL, "int64")
    sums = sums.toArrow()  # rows of Python objects would take the driver several hundred MB
    total[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return total.reshape(n_units, 2, TOTAL)


def class_table(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Transitions: class before x class."""
    table = np.zeros((TOTAL, TOTAL))
    np.add.at(table, classes, counts[:, 1].astype(float))
    return table


def likelihood(table: np.ndarray) -> float:
    """Of the classes, up to a constant: what exchange makes greater."""
    log = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return log(table) - log(table.sum(0)) - log(table.sum(1))


def exchanged(counts: np.ndarray, classes: np.ndarray, turn: int) -> np.ndarray:
    """Head words move to the class that makes their neighbours likeliest; a word's own counts are left out of its class."""
    table = class_table(counts, classes)
    n = CLASSES
    before, after = counts[1:HEAD, 0].astype(float), counts[1:HEAD, 1].astype(float)
    uses = before.sum(1)
    own = classes[1:HEAD]
    rows, columns = table[1:n], table[:, 1:n]
    smooth = 0.5
    to_next = after @ np.log(rows + smooth).T - after.sum(1)[:, None] * np.log(rows.sum(1) + smooth * TOTAL)
    from_last = before @ np.log(columns + smooth) - uses[:, None] * np.log(columns.sum(0) + smooth * TOTAL)
    score = to_next + from_last
    less_row, less_column = np.maximum(table[own] - after, 0), np.maximum(table.T[own] - before, 0)
    at_home = (after * np.log(less_row + smooth)).sum(1) - after.sum(1) * np.log(less_row.sum(1) + smooth * TOTAL)
    at_home += (before * np.log(less_column + smooth)).sum(1) - uses * np.log(less_column.sum(1) + smooth * TOTAL)
    score[np.arange(len(own)), own - 1] = at_home
    moves = (np.arange(1, HEAD) % 2 == turn % 2) & (uses > 0)
    new = classes.copy()
    new[1:HEAD] = np.where(moves, 1 + score.argmax(1), own)
    return new


@dataclass
class Model:
    """``step``: log10 of class transitions; ``share``: log10 of a head word's share of its class; ``by_class``: tokens a class."""

    classes: np.ndarray
    step: np.ndarray
    share: np.ndarray
    by_class: np.ndarray
    head_counts: np.ndarray
    tokens: int
    words: int


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class after each; few counts lean on those of single classes."""
    single = (table.sum(0) + 0.5) / (table.sum() + 0.5 * len(table))
    weight = 4.0
    return np.log10((table + weight * single) / (table.sum(1, keepdims=True) + weight))


def fitted(counts: np.ndarray, classes: np.ndarray, head_counts: np.ndarray, tokens: int, words: int) -> Model:
    table = class_table(counts, classes)
    once = CLASSES  # words met once stand in for unknown ones: half their places go to those
    table[:, UNKNOWN] = table[:, once] / 2
    table[:, once] /= 2
    table[UNKNOWN] = table[once] / 2
    table[once] /= 2
    uses = counts[:, 0].sum(1)
    by_class = np.bincount(classes, weights=uses, minlength=TOTAL)
    with np.errstate(divide="ignore"):
        share = np.log10(uses[:HEAD]) - np.log10(np.maximum(by_class[classes[:HEAD]], 1))
    return Model(classes, transitions(table), share, by_class, head_counts, tokens, words)


def counts_and_classes(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training count and class of each token; unknown words have the class after the last."""
    head = codes < HEAD
    rank, other = np.minimum(codes, HEAD - 1), codes - HEAD
    counts = np.where(head, model.head_counts[rank], other // CLASSES)
    return counts, np.where(head, model.classes[rank], np.where(other > 0, other % CLASSES, CLASSES))


def refitted(codes: DataFrame, model: Model) -> Model:
    """The model of all words in their classes: transitions between CLASSES classes and one of unknown words.

    Half of each word met once stands in for unknown words, as a place and as a neighbour. Tasks send sums of fixed size.
    """
    size = 2 * CLASSES

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size * size, "int64")
        for pdf in frames:
            for docs in grouped(pdf["codes"]):
                codes = np.concatenate(docs)
                counts, classes = counts_and_classes(model, codes)
                states = 2 * classes + ((counts == 1) & (codes > 0))  # the end is never a word met once
                before = np.append(0, states[:-1])
                before[first_of(docs)] = 0
                total += np.bincount(before * size + states, minlength=size * size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    sums = codes.where(~F.col("held_out")).select("codes").mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size * size)
    total[sums["at"].to_numpy()] = sums["n"].to_numpy()
    total = total.reshape(size, size)
    parts = np.zeros((size, CLASSES + 1))
    parts[np.arange(0, size, 2), np.arange(CLASSES)] = 1
    parts[np.arange(1, size, 2), np.arange(CLASSES)] = parts[1::2, CLASSES] = 0.5
    return replace(model, step=transitions(parts.T @ total @ parts), by_class=total.sum(0) @ parts)


def log_probability(model: Model, codes: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
    """log10 probability of each token of the documents that begin at ``first``, in order."""
    counts, classes = counts_and_classes(model, codes)
    weight = np.where((counts <= 1) & (codes > 0), 0.5, np.maximum(counts, 0.5))
    share = np.where(classes < CLASSES, np.log10(weight / np.maximum(model.by_class[classes], 0.5)), 0.0)
    before = np.append(0, classes[:-1])
    before[first] = 0
    return model.step[before, classes] + share


def grouped(docs: pd.Series) -> Iterator[list[np.ndarray]]:
    """Documents in groups of about PIECE_TOKENS, which are worked on at once."""
    held, n = [], 0
    for doc in docs:
        held.append(np.asarray(doc))
        n += len(doc)
        if n >= PIECE_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def first_of(docs: list[np.ndarray]) -> np.ndarray:
    """Where each of some documents begins; none is without its end."""
    return np.cumsum([0, *map(len, docs[:-1])])


def score_rows(model: Model, docs: list[np.ndarray]) -> Iterator[tuple]:
    """Tokens, known tokens, training tokens, base and score of every document; each is summed by itself."""
    scale = np.log10(model.tokens + 0.1 * (model.words + 1))
    codes, first = np.concatenate(docs), first_of(docs)
    counts = counts_and_classes(model, codes)[0]
    known, base, score = np.add.reduceat(counts > 0, first, dtype="int64"), np.log10(counts + 0.1), log_probability(model, codes, first)
    for at, n, n_known in zip(first.tolist(), map(len, docs), known.tolist()):
        yield n, n_known, model.tokens, float(base[at : at + n].sum() - n * scale), float(score[at : at + n].sum())


def learn(ids: DataFrame, head_counts: np.ndarray, tokens: int, words: int) -> Model:
    """The classes of head words of the pass with the greatest likelihood."""
    classes, best = first_classes(), None
    for turn in range(PASSES + 1):
        counts = context_counts(ids, classes, head_units)
        value = likelihood(class_table(counts, classes))
        if best is None or value > best[0]:
            best = value, counts, classes
        classes = exchanged(counts, classes, turn)
    return fitted(best[1], best[2], head_counts, tokens, words)


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Score row of every document, under the unigram base and the class model.

    A null text is empty, so it has the end alone. Repeated rows count and are scored each. An empty table gives no rows.
    Only ``doc_id`` and ``text`` are read.
    """
    counts = stored(spark, word_counts(docs), "lm-words")
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    head = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.col("word") != END, F.desc("n"), "word").limit(HEAD).collect()]
    if not head:  # no training document
        head = [(END, 0)]
    head_counts = np.zeros(HEAD, "int64")
    head_counts[: len(head)] = [n for _, n in head]
    buckets = 1 + int(total["tokens"] or 0) // BUCKET_TOKENS
    blocks = stored(spark, in_blocks(docs, [w for w, _ in head], buckets), "lm-blocks")
    ids = blocks.where(F.col("ids").isNotNull()).select("held_out", F.col("ids").alias("codes"))
    model = learn(ids, head_counts, int(total["tokens"] or 0), int(total["words"] or 0))
    codes = stored(spark, coded(blocks, model), "lm-codes")
    shared = spark.sparkContext.broadcast(refitted(codes, model))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [row for docs in grouped(pdf["codes"]) for row in score_rows(shared.value, docs)]
            found = pd.DataFrame(rows, columns=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
            yield pd.concat([pdf[["doc_id", "held_out"]].reset_index(drop=True), found], axis=1)

    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return codes.mapInPandas(score, columns)
