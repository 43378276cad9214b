"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

Texts that are equal word for word are one text, owned by its smallest document. Every run of SPAN words has an anchor, the
least hash among its short word groups; equal runs have equal anchors, so only runs whose anchor stands in two texts can
repeat. Around such anchors a document sends pieces of a few words more than a run. Pieces with one anchor meet in one
shard. The shard's distinct pieces become a suffix automaton whose states know the smallest document they occur in; pieces
are streamed through it for matching statistics, and a run is marked where its state's document is smaller than its own.

A shard takes at most about HOT texts of one anchor: the texts of a more frequent one are salted over several shards.
There a run is marked if its own shard holds a smaller document; what is left is at most one document a run and shard, and
those runs meet once more, by their content, in a second round of the same matching.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.llm.common import batches_of, rows_of, stored
from fedlens.llm.shingles import windows

GROUP = 4
HOT = 2000
SHARD_WORDS = 60_000
#: Bytes of texts whose anchors are found at once.
TEXT_BYTES = 1 << 19
NEVER = np.iinfo("int64").max


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows the smallest document among its occurrences."""

    def __init__(self, pieces: dict[bytes, int]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NEVER]
        for piece, doc in pieces.items():
            last = 0
            for word in piece.split(b" "):
                last = self._extended(last, word)
                self.first[last] = min(self.first[last], doc)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            self.first[above] = min(self.first[above], self.first[state])

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(NEVER)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, target: int) -> int:
        """The state of the word after ``at``; a longer target is parted so that its length fits."""
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extended(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.next[at][word])
        return new

    def first_documents(self, piece: bytes, span: int) -> np.ndarray:
        """For every run of ``span`` words of a piece: the smallest document that holds it, or the largest number."""
        state = matched = 0
        found = []
        for i, word in enumerate(piece.split(b" ")):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while matched >= span and self.length[self.link[state]] >= span:
                state = self.link[state]
                matched = self.length[state]
            if i + 1 >= span:
                found.append(self.first[state] if matched >= span else NEVER)
        return np.array(found, "int64")


#: Bytes that part words become spaces.
PLAIN = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))


def spaced_once(text: str | None) -> bytes:
    """The words of a text, joined by one space."""
    data = (text or "").encode().translate(PLAIN)
    return data if b"  " not in data and data[:1] != b" " and data[-1:] != b" " else b" ".join(data.split())


def count(data: bytes) -> int:
    return data.count(b" ") + 1 if data else 0


def text_key(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_words, sha256`` of every row: the key and digest of its words."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                data = spaced_once(text)
                yield doc_id, text_key(data), count(data), hashlib.sha256(data).hexdigest()

        yield from batches_of(rows(), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, key long, n_words long, sha256 string")


def least_places(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of every ``size`` values, the first of equals; from halves that overlap, so in log(size) steps."""
    place, least, width = np.arange(len(values)), values, 1
    while width < size:
        step = min(width, size - width)
        left, right = least[:-step], least[step:]
        place = np.where(right < left, place[step:], place[:-step])
        least, width = np.minimum(left, right), width + step
    return place


class WordSums:
    """Places and hashes of the words of joined texts, from one running sum over their bytes."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.zeros(0, "uint64")

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(data, "uint8")
        if len(codes) >= len(self.up):
            self.up = np.cumprod(np.full(2 * len(codes) + 2, self.BASE, "uint64"))
            self.down = np.cumprod(np.full(2 * len(codes) + 2, self.INVERSE, "uint64"))
        gaps = np.flatnonzero(codes == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(codes))
        sums = np.zeros(len(codes) + 1, "uint64")
        np.cumsum((codes + np.uint64(1)) * self.up[: len(codes)], out=sums[1:])
        return starts, ends, (sums[ends] - sums[starts]) * self.down[starts]


def text_groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose last column is a joined text, in groups of about TEXT_BYTES; empty texts are left out."""
    held, size = [], 0
    for row in rows:
        if row[-1]:
            held.append(row)
            size += len(row[-1])
        if size >= TEXT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Anchors:
    """Anchors of a group of joined texts: for each stretch of runs with one anchor its text, first run, end and hash."""

    def __init__(self, texts: list[bytes], sums: WordSums, span: int):
        self.data, group = b" ".join(texts), min(GROUP, span)
        self.starts, self.ends, hashes = sums(self.data)
        words = list(map(count, texts))
        self.begins = np.cumsum([0, *words])
        owner = np.repeat(np.arange(len(texts)), words)
        runs = np.flatnonzero(owner[: 1 - span or None] == owner[span - 1 :])  # those within one text
        groups = windows(hashes, group)
        place = least_places(groups, span - group + 1)[runs] if len(runs) else runs
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (np.diff(runs) != 1))) if len(runs) else runs
        self.first, self.end = runs[new], runs[np.append(new[1:], len(runs)) - 1] + 1 if len(runs) else runs
        self.text, self.hash = owner[self.first], groups[place[new]].view("int64")


def anchor_rows(docs: DataFrame, span: int) -> DataFrame:
    """``anchor, key``: the distinct anchors of each text."""
    schema = pa.schema([("anchor", pa.int64()), ("key", pa.int64())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = WordSums()
        for held in text_groups((spaced_once(text),) for _, text in rows_of(batches)):
            texts = [data for data, in held]
            found = Anchors(texts, sums, span)
            order = np.lexsort((found.hash, found.text))
            text, anchor = found.text[order], found.hash[order]
            other = np.append(True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]))[: len(order)]
            keys = np.array(list(map(text_key, texts)), "int64")[text[other]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[other]), pa.array(keys)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(post, "anchor long, key long")


def candidates(spark: SparkSession, docs: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """``key, doc_id, packed, anchors, salts``: texts with shared anchors, at their owner; ``packed`` is the compressed text.

    ``salts`` says over how many shards the texts of each anchor are spread.
    """
    same = W.partitionBy("anchor")
    posted = anchor_rows(docs.where(F.col("doc_id").isNotNull()), span).select(
        "anchor", "key", F.min("key").over(same).alias("low"), F.max("key").over(same).alias("high"), F.count(F.lit(1)).over(same).alias("uses")
    )
    salts = F.ceil(F.col("uses") / HOT).cast("int").alias("salts")
    shared = posted.where("low <> high").groupBy("key").agg(F.collect_set(F.struct("anchor", salts)).alias("found"))
    owners = shared.join(texts, "key").select("key", F.col("owner").alias("doc_id"), F.col("found.anchor").alias("anchors"), F.col("found.salts").alias("salts"))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("packed", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rows = ((d, text_key(w), squeeze(w)) for d, w in ((d, spaced_once(t)) for d, t in rows_of(batches)) if count(w) >= span)
        yield from batches_of(rows, schema, weight=lambda r: len(r[2]))

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "doc_id long, key long, packed binary")
    return packed.join(owners, ["key", "doc_id"]).dropDuplicates(["key", "doc_id"])


def pieces(held: DataFrame, span: int) -> DataFrame:
    """``anchor, salt, salts, key, doc_id, start, piece``: the words around each shared anchor of a text."""
    names = ("anchor", "salt", "salts", "key", "doc_id", "start")
    schema = pa.schema([*((x, pa.int64()) for x in names), ("piece", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, unpack = WordSums(), zstandard.ZstdDecompressor().decompress

        def rows() -> Iterator[tuple]:
            for held in text_groups((*row[:-1], unpack(row[-1])) for row in rows_of(batches)):
                found = Anchors([row[-1] for row in held], sums, span)
                bounds = np.searchsorted(found.text, np.arange(len(held) + 1)).tolist()
                begin, end = found.starts[found.first], found.ends[found.end + span - 2]
                for k, (key, doc_id, wanted, salts, _) in enumerate(held):
                    wanted = dict(zip(wanted, salts))
                    own = slice(bounds[k], bounds[k + 1])
                    places = (found.first[own] - found.begins[k]).tolist()
                    for a, i, x, y in zip(found.hash[own].tolist(), places, begin[own].tolist(), end[own].tolist()):
                        n = wanted.get(a)
                        if n:
                            yield a, key % n, n, key, doc_id, i, found.data[x:y]

        yield from batches_of(rows(), schema, weight=lambda r: len(r[6]))

    columns = ", ".join(f"{x} long" for x in names) + ", piece binary"
    return held.select("key", "doc_id", "anchors", "salts", "packed").mapInArrow(cut, columns)


MARKS = "key long, first long, last long, doc_id long, run binary"


def marked(rows: pa.Table, span: int) -> pa.Table:
    """``key, first, last``: stretches of runs that a smaller document of these rows holds; with ``doc_id, run`` one run still
    open, of an anchor whose other texts are in other shards."""
    anchor, key, doc_id, start, salts = (rows[x].to_numpy() for x in ("anchor", "key", "doc_id", "start", "salts"))
    coded = rows["piece"].combine_chunks().dictionary_encode()
    code, pieces_met = coded.indices.to_numpy(), coded.dictionary
    n_runs = pc.count_substring(pieces_met, " ").to_numpy().astype("int64") + 2 - span
    least, of = np.full(len(pieces_met), NEVER), np.zeros(len(pieces_met), "int64")
    np.minimum.at(least, code, doc_id)
    of[code] = anchor  # equal pieces have equal anchors
    _, sort, uses = np.unique(of, return_inverse=True, return_counts=True)
    several = uses[sort] > 1
    # of a piece that is alone with its anchor, every run is first in the least document that holds the piece
    firsts = np.repeat(least, n_runs)
    begins = np.append(0, np.cumsum(n_runs))
    shared = np.flatnonzero(several)
    texts = pieces_met.take(pa.array(shared)).to_pylist()
    automaton = SuffixAutomaton(dict(zip(texts, least[shared].tolist())))
    for k, text in zip(shared.tolist(), texts):
        firsts[begins[k] : begins[k + 1]] = automaton.first_documents(text, span)
    told = np.flatnonzero(several[code] | (least[code] < doc_id) | (salts > 1))
    many = n_runs[code[told]]
    row, offset = np.repeat(told, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    earlier = firsts[begins[code[row]] + offset] < doc_id[row]
    held = np.flatnonzero(earlier)
    apart = np.append(True, (np.diff(held) != 1) | (row[held[1:]] != row[held[:-1]]))[: len(held)]
    begin, end = held[apart], held[np.append(apart[1:], True)[: len(held)]]
    open_ = np.flatnonzero(~earlier & (salts[row] > 1))
    runs, words, at = [], [], -1
    for k, i in zip(row[open_].tolist(), offset[open_].tolist()):
        if k != at:
            words, at = pieces_met[code[k]].as_py().split(b" "), k
        runs.append(b" ".join(words[i : i + span]))
    none = pa.nulls(len(begin), pa.int64())
    place = start[row] + offset
    columns = [
        np.append(key[row[begin]], key[row[open_]]), np.append(place[begin], place[open_]), np.append(place[end], place[open_]),
        pa.concat_arrays([none, pa.array(doc_id[row[open_]], pa.int64())]),
        pa.concat_arrays([pa.nulls(len(begin), pa.binary()), pa.array(runs, pa.binary())]),
    ]
    return pa.table(columns, names=["key", "first", "last", "doc_id", "run"])


def repeated_runs(spark: SparkSession, held: DataFrame, span: int) -> DataFrame:
    """``key, first, last``: stretches of runs that start in a smaller document too."""
    size = held.agg(F.sum(F.length("packed"))).first()[0] or 0
    shards = F.lit(max(1, int(size) // SHARD_WORDS))
    rows = pieces(held, span).withColumn("shard", F.pmod(F.xxhash64("anchor", "salt"), shards))
    rows = rows.drop("salt")
    found = stored(spark, rows.groupBy("shard").applyInArrow(lambda table: marked(table, span), MARKS), "marked-runs")
    again = found.where(F.col("run").isNotNull()).select(
        F.xxhash64("run").alias("anchor"), F.lit(1).cast("long").alias("salts"), "key", "doc_id", F.col("first").alias("start"), F.col("run").alias("piece")
    )
    second = again.withColumn("shard", F.pmod("anchor", shards)).groupBy("shard").applyInArrow(lambda table: marked(table, span), MARKS)
    return found.where(F.col("run").isNull()).select("key", "first", "last").union(second.select("key", "first", "last"))


def changed(spark: SparkSession, docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """The measures of all rows with ``owner``, and ``key, n_removed, kept`` of the owners' texts that lose words."""
    rows = stored(spark, measured(docs), "word-digests")
    owners = rows.where(F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("owner"))
    owners = stored(spark, owners, "text-owners")
    held = stored(spark, candidates(spark, docs, owners, span), "candidates")
    marks = (F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    starts = repeated_runs(spark, held, span).groupBy("key").agg(*marks)
    schema = pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def kept() -> Iterator[tuple]:
            for key, packed, first, last in rows_of(batches):
                words = unpack(packed).split(b" ")
                edge = np.zeros(len(words) + 1, "int64")
                np.add.at(edge, np.array(first), 1)
                np.add.at(edge, np.array(last) + span, -1)
                gone = np.cumsum(edge[:-1]) > 0
                yield key, int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g).decode()

        yield from batches_of(kept(), schema, weight=lambda r: len(r[2]))

    lost = held.select("key", "packed").join(starts, "key").select("key", "packed", "first", "last").mapInArrow(remove, "key long, n_removed long, kept string")
    return rows.join(owners, "key", "left"), stored(spark, lost, "kept-words")


def _copy(span: int):
    return (F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= span)


def deduplicated(spark: SparkSession, docs: DataFrame, span: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    A word goes if a run of ``span`` words that covers it also starts in a document with a smaller id; runs are judged on the
    input. Null and short texts lose nothing. Rows without an id neither lose words nor count as earlier. Rows that repeat an
    id are not earlier than each other. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    rows, lost = changed(spark, docs, span)
    lost = lost.select("key", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    joined = rows.join(lost, "key", "left")
    own = F.col("doc_id") == F.col("owner")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(_copy(span), F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(_copy(span), F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.coalesce("kept_sha256", "sha256")).otherwise(F.col("sha256")).alias("kept_sha256"),
    )


def without_repeats(spark: SparkSession, docs: DataFrame, span: int) -> DataFrame:
    """``docs`` without repeated passages; a text that loses words is its kept words, joined by one space.

    Rows of which nothing is left are dropped; all others keep their columns, ``n_chars`` follows the new text.
    """
    rows, lost = changed(spark, docs, span)
    own = F.col("doc_id") == F.col("owner")
    news = rows.join(lost, "key", "left").where(_copy(span) | (own & F.col("kept").isNotNull()))
    news = news.select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), F.when(_copy(span), F.lit("")).otherwise(F.col("kept")).alias("new_text")).distinct()

    @F.pandas_udf("long")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_key(spaced_once(t)) for t in texts], dtype="int64")

    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"), key_of(F.col("text")).alias("own_key"))
    joined = held.join(news, (F.col("id") == F.col("of_id")) & (F.col("own_key") == F.col("of_key")), "left").where(F.col("new_text").isNull() | (F.col("new_text") != ""))
    fresh = {"text": F.coalesce("new_text", F.col("doc.text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("new_text").isNotNull(), F.length("new_text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(fresh.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
