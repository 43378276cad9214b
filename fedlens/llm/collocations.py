"""Phrase collocations, mined by shards first and counted globally afterwards.

A phrase with the wanted support in the whole has at least its proportional share of it in one shard. So every shard is
mined completely at that lowered support, level by level (words, pairs, then longer phrases whose pairs are frequent
there); what is frequent in some shard is a candidate, and candidates are counted exactly over everything. The number of
shards is fixed, so the lowered support does not fall with the size of the corpus; a shard is spread over many tasks, and
its counts are partial sums by hash. Sets that filter are bit tables of fixed size: a full one only lets more phrases
through to the exact count. Hashes never decide a result: final counts are by language and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fedlens.llm.common import batches_of, rows_of, stored

NO_LANG = "und"
LONGEST = 4
SHARDS = 4
SIEVE_BITS = 27
#: Words whose phrases are counted together in a task, and words whose hashes are remembered.
BUFFER_WORDS = 1_000_000
REMEMBERED = 250_000
#: Ends a piece; no lower-cased word holds this letter.
MARK = b"A"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SHARD_SALT = 0x0123_4567_89AB_CDE
SCALE = 2_000_000


def pieces_of(text: str | None) -> bytes:
    """Lower-cased text with MARK between pieces."""
    return text.encode().translate(FOLD).replace(b"\n", b" A ") if text else b""


class Hashes(dict):
    """Hash of every word of one language; 0 for the end of a piece."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh3_64_intdigest(lang)
        self[MARK] = 0

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return found


class Numbered(dict):
    """A number for every word met, in order."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found

    def read(self, words: bytes) -> np.ndarray:
        parts = words.split()
        parts.append(MARK)
        return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the word after it."""
    x = a * MIX_1 + b
    x ^= x >> np.uint64(32)
    x *= MIX_2
    return x ^ (x >> np.uint64(29))


def in_sieve(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a bit table may hold the hashes: the two places are taken from the first bits and those after them."""
    found = np.ones(len(hashes), bool)
    for skip in (0, SIEVE_BITS):
        at = (hashes << np.uint64(skip)) >> np.uint64(64 - SIEVE_BITS)
        found &= (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return found


def sieve_of(spark: SparkSession, hashes: DataFrame):
    """Broadcast bit table of a column ``h``. It has 2 ** SIEVE_BITS bits whatever the input; cells are or-ed by Spark."""
    at = lambda skip: F.shiftrightunsigned(F.shiftleft("h", skip), 64 - SIEVE_BITS)
    places = hashes.select(F.explode(F.array(at(0), at(SIEVE_BITS))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    cells = places.groupBy(F.shiftright("p", 6).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << SIEVE_BITS - 6, np.int64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return spark.sparkContext.broadcast(table.view(np.uint64))


def salted(shard: Column | int) -> Column | int:
    """Xor-ed to a hash, it tells the shards' sets apart within one bit table."""
    return shard * SHARD_SALT


def sharded(spark: SparkSession, docs: DataFrame, shards: int) -> DataFrame:
    """``lang``, ``shard`` and the pieces of every text, written once; a task's rows belong to one shard."""
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("words", pa.binary())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        rows = ((lang, shard, pieces_of(text)) for lang, text in rows_of(batches))
        yield from batches_of(rows, schema, weight=lambda r: len(r[2]))

    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    return stored(spark, texts.mapInArrow(fold, "lang string, shard int, words binary"), "phrase-pieces")


def count_words(pieces: DataFrame) -> DataFrame:
    """``lang``, ``shard``, ``word``, ``f`` and the hash of the word."""
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("word", pa.string()), ("h", pa.int64()), ("f", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter, defaultdict

        held: dict[tuple[str, int], Counter] = defaultdict(Counter)

        def flush() -> Iterator[tuple]:
            for (lang, shard), words in held.items():
                words.pop(MARK, None)
                hashes = Hashes(lang)
                for word, f in words.items():
                    yield lang, shard, word.decode(), _signed(hashes.__missing__(word)), f
            held.clear()

        def rows() -> Iterator[tuple]:
            for lang, shard, words in rows_of(batches):
                held[lang, shard].update(words.split())
                if sum(map(len, held.values())) > REMEMBERED:
                    yield from flush()
            yield from flush()

        yield from batches_of(rows(), schema)

    counted = pieces.mapInArrow(count, "lang string, shard int, word string, h long, f long")
    return counted.groupBy("lang", "shard", "word").agg(F.first("h").alias("h"), F.sum("f").alias("f"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def lowered(words: DataFrame, support: int) -> DataFrame:
    """``need`` of every language and shard: its share of ``support`` by words, rounded up."""
    mass = words.groupBy("lang", "shard").agg(F.sum("f").alias("w"))
    total = mass.groupBy("lang").agg(F.sum("w").alias("_n"))
    share = F.expr(f"cast((cast({support} as decimal(20, 0)) * w + _n - 1) div _n as bigint)")
    return mass.join(total, "lang").select("lang", "shard", share.alias("need"))


class Phrases:
    """Hashes of the phrases of buffered documents: one array of words, 0 between pieces, and their phrases by length."""

    def __init__(self) -> None:
        self.hashes: dict[str, Hashes] = {}

    def of(self, lang: str) -> Hashes:
        if sum(map(len, self.hashes.values())) > REMEMBERED:
            self.hashes.clear()
        if lang not in self.hashes:
            self.hashes[lang] = Hashes(lang)
        return self.hashes[lang]

    def read(self, lang: str, words: bytes) -> np.ndarray:
        parts = words.split()
        parts.append(MARK)
        return np.fromiter(map(self.of(lang).__getitem__, parts), np.uint64, len(parts))


def _buffered(batches: Iterator[pa.RecordBatch], reader: Phrases) -> Iterator[tuple[tuple, list, list]]:
    """Groups of documents of one key (all columns but the last): their word hashes and their words."""
    held: dict[tuple, list] = {}
    size = 0
    for *key, words in rows_of(batches):
        x = reader.read(key[0], words)
        held.setdefault(tuple(key), []).append((x, words))
        size += len(x)
        if size >= BUFFER_WORDS:
            for k, docs in held.items():
                yield k, [d[0] for d in docs], [d[1] for d in docs]
            held, size = {}, 0
    for k, docs in held.items():
        yield k, [d[0] for d in docs], [d[1] for d in docs]


COUNTED = pa.schema([("h", pa.int64()), ("shard", pa.int32()), ("need", pa.int64()), ("n", pa.int64())])


def mine(pieces: DataFrame, sieve, lengths: tuple[int, int]) -> DataFrame:
    """Hashes of the phrases of a range of lengths that meet their shard's ``need``.

    ``sieve`` holds the shards' frequent words where pairs are mined, and their frequent pairs where longer phrases are:
    only phrases whose parts are all frequent in the shard are counted.
    """
    first, last = lengths

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, shard, need), arrays, _ in _buffered(batches, Phrases()):
            words = np.concatenate(arrays)
            salt = np.uint64(salted(shard))
            phrase, good = words, words != 0
            if first == 2:
                good &= in_sieve(sieve.value, words ^ salt)
            for n in range(2, last + 1):
                good = good[:-1] & good[1:]
                if n == 2 and first > 2:
                    pairs = joined(words[:-1], words[1:])
                    good[good] = in_sieve(sieve.value, pairs[good] ^ salt)
                    phrase = pairs
                    continue
                phrase = joined(phrase[:-1], words[n - 1 :])
                found, counts = np.unique(phrase[good], return_counts=True)
                for at in range(0, len(found), 1 << 16):
                    some = found[at : at + (1 << 16)].view(np.int64)
                    same = lambda value, kind: pa.array(np.full(len(some), value), kind)
                    columns = [pa.array(some), same(shard, pa.int32()), same(need, pa.int64()), pa.array(counts[at : at + (1 << 16)])]
                    yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)

    counted = pieces.mapInArrow(count, "h long, shard int, need long, n long").groupBy("h", "shard")
    return counted.agg(F.sum("n").alias("n"), F.first("need").alias("need")).where("n >= need").select("h", "shard")


def count_candidates(pieces: DataFrame, sieve, longest: int) -> DataFrame:
    """Exact number of occurrences of every phrase whose hash the sieve holds: ``lang``, ``phrase``, ``a``.

    A sieve lets all occurrences of a phrase through or none, so counts are whole. Within a task, occurrences of one hash
    are compared word by word with the first of them.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (lang,), arrays, texts in _buffered(batches, Phrases()):
                words = np.concatenate(arrays)
                codes = Numbered()
                exact = np.concatenate([codes.read(text) for text in texts])
                names = list(codes)
                phrase, good = words, words != 0
                for n in range(2, longest + 1):
                    phrase = joined(phrase[:-1], words[n - 1 :])
                    good = good[:-1] & good[1:]
                    good[good] = in_sieve(sieve.value, phrase[good])
                    places = np.flatnonzero(good)
                    _, first, of = np.unique(phrase[places], return_index=True, return_inverse=True)
                    first = places[first]
                    like = np.ones(len(places), bool)
                    for k in range(n):
                        like &= exact[places + k] == exact[first[of] + k]
                    counts = np.bincount(of[like], minlength=len(first))
                    for at, a in zip(first.tolist(), counts.tolist()):
                        yield lang, b" ".join([names[c] for c in exact[at : at + n].tolist()]).decode(), a
                    for at in places[~like].tolist():  # phrases that share a hash
                        yield lang, b" ".join([names[c] for c in exact[at : at + n].tolist()]).decode(), 1

        yield from batches_of(rows(), schema)

    counted = pieces.select("lang", "words").mapInArrow(count, "lang string, phrase string, a long")
    return counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """``l``, ``r`` and ``score`` of the lowest cut of every phrase; ``parts`` has ``f`` of all that a cut can leave.

    Sums and products are decimals of 38 digits, so they are exact for counts up to 64 bits.
    """
    words, k = F.split("phrase", " "), F.col("k")
    side = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = (
        phrases.withColumn("w", words)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
        .select("lang", "phrase", "a", "k", side(F.lit(1), k).alias("_l"), side(k + 1, F.size("w") - k).alias("_r"))
    )
    of = lambda name: parts.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    both = cuts.join(of("l"), ["lang", "_l"]).join(of("r"), ["lang", "_r"])
    score = F.expr(f"cast({SCALE} as decimal(7, 0)) * a div (cast(l as decimal(19, 0)) + r)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_c")
    return both.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")


def outermost(phrases: DataFrame, percent: int, longest: int) -> DataFrame:
    """Phrases without those that occur in a longer one at least ``percent`` in 100 times."""
    words, n = F.split("phrase", " "), F.size("w")

    def runs(size: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))
        return F.when(n > size, each).otherwise(F.array().cast("array<string>"))

    longer = phrases.withColumn("w", words).where(n > 2)
    inner = F.concat(F.array().cast("array<string>"), *[runs(size) for size in range(2, longest)])
    inside = longer.select("lang", "a", F.explode(inner).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    kept = F.expr(f"_most IS NULL OR cast(100 as decimal(5, 0)) * _most < cast({percent} as decimal(5, 0)) * a")
    return phrases.join(most, ["lang", "phrase"], "left").where(kept).drop("_most")


def collocations(
    spark: SparkSession, docs: DataFrame, support: int = 30, longest: int = LONGEST, inside_percent: int = 80,
    top: int = 2000, shards: int = SHARDS,
) -> DataFrame:
    """The ``top`` phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases have 2 to ``longest`` words and ``support`` or more occurrences within pieces. A null text has no words, a
    null language is ``und``; repeated rows count each; languages without such a phrase give no rows, nor does an empty
    table. Only ``lang`` and ``text`` are read. The result hangs neither on ``shards`` nor on partitioning.
    """
    pieces = sharded(spark, docs, shards)
    words = stored(spark, count_words(pieces), "phrase-words")
    needs = stored(spark, lowered(words, support), "phrase-needs")
    due = pieces.join(needs, ["lang", "shard"]).select("lang", "shard", "need", "words")
    of_shard = lambda rows: rows.select(F.col("h").bitwiseXOR(salted(F.col("shard").cast("long"))).alias("h"))
    frequent = words.join(needs, ["lang", "shard"]).where("f >= need")
    pairs = stored(spark, mine(due, sieve_of(spark, of_shard(frequent)), (2, 2)), "phrase-pairs")
    found = pairs
    if longest > 2:
        found = pairs.union(stored(spark, mine(due, sieve_of(spark, of_shard(pairs)), (3, longest)), "phrase-longer"))
    counted = count_candidates(pieces, sieve_of(spark, found.select("h")), longest)
    phrases = stored(spark, counted.where(F.col("a") >= support), "phrases")
    single = words.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("f").alias("f"))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = single.where(F.col("f") >= support).union(phrases.select("lang", "phrase", F.col("a").alias("f")))
    chosen = outermost(scored(phrases, parts), inside_percent, longest)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["phrase", "a", "l", "r", "n", "score"]
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), *columns)
