"""Ranked lexical search by pipelined owners of terms.

Terms are dealt to owners by how many documents hold them, rarest first. Every item goes through the owners one after
another as a bundle per block of documents, which holds the documents met so far and their partial sums. At each owner
bundles meet the posting lists of its terms by cogroup and take on integer contributions. Between two owners the k-th best
partial sum of an item is known, which no final score of its k best can be below: documents that can't reach it any more
leave the bundle, and once the owners still to come can't lift a new document to it, no new one enters. So rare terms fill
the bundles and frequent ones only finish them. Results are exact.

Blocks are runs of BLOCK_DOCS documents of one task, so no group grows with the table. Items are taken in rounds whose
terms are bounded, so that a round's terms can be sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.llm.common import batches_of, lower_ascii, rows_of, stored

TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that part terms become spaces, A-Z lower case; bytes beyond ASCII stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
BLOCK_DOCS = 2048
#: Terms and repeats of a round of items; the terms of one round are sent to all tasks.
ROUND_TERMS = 100_000
#: Owners hold the terms found in up to this share of documents; the last holds the rest.
OWNERS = (0.001, 0.01, 0.1)
POSTINGS = "block long, term int, docs array<int>, counts array<int>"
BUNDLES = "block long, item int, docs array<int>, scores array<long>"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """``item`` (own number of the row), ``item_id``, ``term`` and ``times``, how often the item has it."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM_SQL), F.lit(0))
    return items.select("item", "item_id", F.explode(words).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def in_rounds(terms: DataFrame) -> list[DataFrame]:
    """The items' terms in rounds that have at most ROUND_TERMS terms each, or one item alone."""
    rounds = 1
    while True:
        of = F.pmod(F.xxhash64("item"), F.lit(rounds))
        dealt = terms.groupBy(of.alias("r")).agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))
        if not dealt.where((F.col("n") > ROUND_TERMS) & (F.col("items") > 1)).head(1):
            return [terms.where(of == r) for r in sorted(x.r for x in dealt.select("r").collect())]
        rounds *= 2


def postings_of(spark: SparkSession, docs: DataFrame, vocabulary) -> DataFrame:
    """One row per block and term of ``vocabulary``: the places of documents within the block and their counts.

    Term -1 lists the lengths of all documents of the block that have a term, term -2 the ids of all of them.
    """
    schema = pa.schema([("block", pa.int64()), ("term", pa.int32()), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        number_of = vocabulary.value.get
        task = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            block, place = task, 0
            lists: dict[int, tuple[list, list]] = {}
            ids = []

            def done() -> Iterator[tuple]:
                yield block, -2, None, None, ids
                for term, (places, counts) in lists.items():
                    yield block, term, places, counts, None

            for doc_id, text in rows_of(batches):
                words = terms_of(text)
                if words:
                    found = Counter(map(number_of, words))
                    found.pop(None, None)
                    found[-1] = len(words)
                    for term, n in found.items():
                        places, counts = lists.setdefault(term, ([], []))
                        places.append(place)
                        counts.append(n)
                ids.append(doc_id)
                place += 1
                if place == BLOCK_DOCS:
                    yield from done()
                    block, place, lists, ids = block + 1, 0, {}, []
            if place:
                yield from done()

        yield from batches_of(rows(), schema, weight=lambda r: len(r[2] or r[4]) * 4)

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return stored(spark, texts.mapInArrow(index, POSTINGS + ", ids array<long>"), "search-postings")


def impact(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * norms)


def norm(length: int, n_docs: int, n_terms: int) -> int:
    return 100 - 75 + 75 * length * n_docs // n_terms


def term_limits(postings: DataFrame) -> DataFrame:
    """``df`` of every term and its greatest count in a document."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64()), ("most", pa.int64())])

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = batch["counts"].offsets.to_numpy(), batch["counts"].values.to_numpy()
            if len(batch):
                most = np.maximum.reduceat(values, ends[:-1])
                columns = [batch["term"], pa.array(np.diff(ends), pa.int64()), pa.array(most, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    each = postings.where("term >= 0").select("term", "counts").mapInArrow(limits, "term int, df long, most long")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


def peak(most: int, n_docs: int, n_terms: int) -> int:
    """No document's impact is above this for a term found at most ``most`` times in one: it is at least so long, rounding
    takes less than 1 from its norm, and the quotient grows with the count."""
    return 1_000_000_000 * most * n_terms // (1000 * most * n_terms + 8 * (24 * n_terms + 75 * most * n_docs))


class Round:
    """What a task needs of a round: the items' terms with weight and repeats by owner, and what later owners can add."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]], n_docs: int, n_terms: int):
        # rows: item, term, times, weight, owner, peak
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = sorted({r[0] for r in rows})
        self.place = {item: k for k, item in enumerate(self.items)}
        self.of_term: dict[int, list[tuple[int, int]]] = {}
        self.to_come = np.zeros((len(OWNERS) + 2, len(self.items)), np.int64)
        for item, term, times, weight, owner, peak in rows:
            self.of_term.setdefault(term, []).append((self.place[item], times * weight))
            self.to_come[: owner + 1, self.place[item]] += times * weight * peak


def visit(bundles: DataFrame, postings: DataFrame, shared, owner: int, least: dict[int, int]) -> DataFrame:
    """Bundles after one owner; ``least`` has an item's k-th best partial sum so far."""

    def add(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        query: Round = shared.value
        block = key[0].as_py()
        lists = {t: (d, c) for t, d, c in zip(right["term"].to_pylist(), _arrays(right["docs"]), _arrays(right["counts"]))}
        schema = pa.schema([("block", pa.int64()), ("item", pa.int32()), ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64()))])
        if -1 not in lists:
            return schema.empty_table()
        places, lengths = lists.pop(-1)
        # exact also where 75 * length * n_docs passes 64 bits
        norms = np.zeros(int(places[-1]) + 1, np.int64)
        norms[places] = [norm(n, query.n_docs, query.n_terms) for n in lengths.tolist()]
        sums: dict[int, np.ndarray] = {}
        carried = {}
        for item, docs, scores in zip(left["item"].to_pylist(), _arrays(left["docs"]), _arrays(left["scores"])):
            at = query.place[item]
            sums[at] = np.zeros(len(norms), np.int64)
            sums[at][docs] = scores
            carried[at] = docs
        bar = np.array([least.get(item, 0) for item in query.items], np.int64)
        open_ = query.to_come[owner] >= bar
        for term, (docs, counts) in lists.items():
            added = None
            for at, weight in query.of_term.get(term, ()):
                if at not in sums:
                    if not open_[at]:
                        continue
                    sums[at] = np.zeros(len(norms), np.int64)
                if added is None:
                    added = impact(counts.astype(np.int64), norms[docs])
                sums[at][docs] += weight * added
        rows = []
        for at, total in sums.items():
            if not open_[at]:
                seen = np.zeros(len(norms), bool)
                seen[carried[at]] = True
                total = np.where(seen, total, 0)
            kept = np.flatnonzero((total > 0) & (total + query.to_come[owner + 1, at] >= bar[at]))
            if len(kept):
                rows.append((block, query.items[at], kept, total[kept]))
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return bundles.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(add, BUNDLES)


def _arrays(lists: pa.ChunkedArray) -> list[np.ndarray]:
    return [values for part in lists.chunks for values in _split(part)]


def _split(part: pa.ListArray) -> Iterator[np.ndarray]:
    ends, values = part.offsets.to_numpy(), part.values.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:]))


def kth_best(bundles: DataFrame, k: int) -> dict[int, int]:
    """The k-th best partial sum of every item that has so many documents; one number an item of the round."""
    best = F.slice(F.reverse(F.array_sort("scores")), 1, k)
    each = bundles.select("item", F.explode(best).alias("score"))
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= k)
    return {r.item: r.score for r in ranked.where(F.col("r") == k).select("item", "score").collect()}


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every row of ``items``: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Only documents with a score above 0 are returned; equal scores go by ascending ``doc_id``, a null one last. A null text
    has no terms. Repeated rows of ``docs`` are documents of their own; repeated rows of ``items`` are answered each. Either
    table may be empty, which gives no rows. Of ``docs`` only ``doc_id`` and ``text`` are read, of ``items`` only
    ``item_id`` and ``text``.
    """
    numbered = items.select(F.col("item_id").cast("long"), "text").withColumn("item", F.monotonically_increasing_id())
    terms = stored(spark, item_terms(stored(spark, numbered, "search-items")), "search-terms")
    answers = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in in_rounds(terms):
        answers = answers.unionByName(search_round(spark, docs, some, k))
    return answers


def search_round(spark: SparkSession, docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Answers for the items of one round."""
    asked = terms.select("item", "item_id", "term", "times").toArrow().to_pylist()
    items = {x: n for n, x in enumerate(sorted({r["item"] for r in asked}))}
    number = {x: n for n, x in enumerate(sorted({r["term"].encode() for r in asked}))}
    postings = postings_of(spark, docs, spark.sparkContext.broadcast(number))
    of_all = postings.where("term = -1").select(F.size("counts").alias("n"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    totals = of_all.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).head()
    n_docs, n_terms = totals.n, totals.l
    limits = {r["term"]: (r["df"], peak(r["most"], n_docs, n_terms)) for r in term_limits(postings).toArrow().to_pylist()}
    owners = {t: sum(df > share * n_docs for share in OWNERS) for t, (df, _) in limits.items()}
    weight = lambda df: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    rows = [
        (items[r["item"]], t, r["times"], weight(limits[t][0]), owners[t], limits[t][1])
        for r in asked
        if (t := number[r["term"].encode()]) in limits
    ]
    shared = spark.sparkContext.broadcast(Round(rows, n_docs, n_terms))
    small = lambda rows, columns: stored(spark, spark.createDataFrame(rows, columns), "search-round")  # of known size when joined
    held = small(list(owners.items()), "term int, owner int")
    lists = postings.where("term >= 0").join(held, "term")
    lengths = postings.where("term = -1").select("block", "term", "docs", "counts")
    bundles = spark.createDataFrame([], BUNDLES)
    least: dict[int, int] = {}
    for owner in range(len(OWNERS) + 1):
        owned = lists.where(F.col("owner") == owner).select("block", "term", "docs", "counts")
        bundles = stored(spark, visit(bundles, owned.unionByName(lengths), shared, owner, least), "search-bundles")
        least |= kth_best(bundles, k)
    names = {items[r["item"]]: r["item_id"] for r in asked}
    named = small(list(names.items()), "item int, item_id long")
    reach = small(list(least.items()), "item int, bar long")
    pairs = bundles.select("block", "item", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("block", "item", "x.*")
    good = pairs.join(reach, "item", "left").where(F.col("scores") >= F.coalesce("bar", F.lit(1).cast("long")))
    ids = postings.where("term = -2").select("block", "ids")
    placed = good.join(ids, "block").select("item", F.get("ids", F.col("docs")).alias("doc_id"), F.col("scores").alias("score"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")
