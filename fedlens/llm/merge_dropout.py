"""Subword encoding by merges with seeded dropout, and decoding.

Symbols of a chunk are merged best score first from an agenda. Each candidate taken from the agenda is skipped where a hash
keyed by seed, document, place in the text and piece falls below the dropout rate, so the same seed always gives the same
ids, and every occurrence of a word is drawn on its own. Tables are encoded in groups of texts, whose chunks are merged side
by side (``merge_rows``). ``Encoder`` takes one text at a time; what it remembers of a chunk are its candidates in turn and
its ids when none of them is skipped, and the same again after each skip that was met; no draw is ever remembered. Characters
outside the vocabulary become byte pieces; decoding concatenates pieces and bytes and gives back the text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import in_groups, rows_of
from fedlens.llm.merge_rows import GroupEncoder, Pairs

#: Paths of chunks that an encoder keeps, in two generations, and the length from which chunks are merged anew each time.
REMEMBERED, LONG = 500_000, 64
#: Bytes that the paths of both generations may take, and about what a path takes besides its ids and candidates.
ROOM, PATH_BYTES = 64 << 20, 480
#: Chunks up to this length keep their agenda as a short list, longer ones as a heap.
SHORT = 48


class Vocabulary:
    """Pieces with a space for the mark of a word start, their costs (best is least), byte pieces, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[int, int]] = {}
        self.bytes = [0] * 256
        self.table = [b""] * len(model)
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.scores[piece] = (-model.get_score(i), i)
                self.table[i] = piece.encode()
        order = {c: k for k, c in enumerate(sorted({c for c, _ in self.scores.values()}))}
        self.scores = {p: (order[c], i) for p, (c, i) in self.scores.items()}
        #: No piece goes from another character to a space, so text may be cut there; checked for every vocabulary.
        self.cut = not any(" " in p.lstrip(" ") for p in self.scores)


def merged(vocabulary: Vocabulary, chunk: str, skip) -> list[int]:
    """Ids of a chunk. ``skip(place, id)`` tells whether a candidate taken from the agenda is passed over."""
    parts = (_merged_short if len(chunk) <= SHORT else _merged_long)(vocabulary.scores, chunk, skip)
    scores, ids = vocabulary.scores, []
    for p in parts:
        if p in scores:
            ids.append(scores[p][1])
        else:
            ids += [vocabulary.bytes[b] for b in p.encode()]
    return ids


NONE = 1 << 30


def _merged_short(scores: dict, chunk: str, skip) -> list[str]:
    """The agenda is a list beside the parts and their places: the cost of each neighbouring pair; the first of equals is taken."""
    get, far = scores.get, (NONE, 0)
    parts, places = list(chunk), list(range(len(chunk)))
    agenda = [get(a + b, far)[0] for a, b in zip(parts, parts[1:])]
    while agenda and (best := min(agenda)) < NONE:
        i = agenda.index(best)
        pair = parts[i] + parts[i + 1]
        if skip(places[i], scores[pair][1]):
            agenda[i] = NONE
            continue
        parts[i] = pair
        del parts[i + 1], places[i + 1], agenda[i]
        if i:
            agenda[i - 1] = get(parts[i - 1] + pair, far)[0]
        if i < len(agenda):
            agenda[i] = get(pair + parts[i + 1], far)[0]
    return parts


def _merged_long(scores: dict, chunk: str, skip) -> list[str]:
    """The agenda is a heap; entries whose parts have changed are stale and fall out when they are taken."""
    part: list[str | None] = list(chunk)
    after = list(range(1, len(part))) + [-1]
    before = list(range(-1, len(part) - 1))
    agenda: list[tuple[float, int, int, str]] = []

    def propose(left: int, right: int) -> None:
        if left >= 0 and right >= 0:
            whole = part[left] + part[right]
            if whole in scores:
                heapq.heappush(agenda, (scores[whole][0], left, right, whole))

    for i in range(len(part) - 1):
        propose(i, i + 1)
    while agenda:
        _, left, right, whole = heapq.heappop(agenda)
        if part[left] is None or part[right] is None or after[left] != right or part[left] + part[right] != whole:
            continue
        if skip(left, scores[whole][1]):
            continue
        part[left], part[right] = whole, None
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        propose(before[left], left)
        propose(left, after[left])
    return [p for p in part if p is not None]


WORD = 2**64 - 1
PLACE_BITS = 20


def mixed(keys: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    keys = (keys ^ keys >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ keys >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return keys ^ keys >> np.uint64(31)


class Variant:
    """The dropout of one document: a candidate is skipped where the hash of document, place and piece is low."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int, doc_id: int | None):
        self.vocabulary, self.limit = vocabulary, int(rate * 2**32)
        self.start = xxhash.xxh64_intdigest(f"{seed}:{doc_id}")

    def skipped(self, keys: np.ndarray) -> np.ndarray:
        """Of many candidates, given as place in the text and piece in one number."""
        return mixed(keys + np.uint64(self.start)) >> np.uint64(32) < np.uint64(self.limit)

    def dropout(self, chunk: str, at: int = 0):
        """The same for the candidates of one chunk at a place, one by one; the chunk itself is no part of the key."""
        start, limit = self.start + (at << PLACE_BITS), self.limit

        def skip(place: int, piece: int) -> bool:
            key = start + (place << PLACE_BITS) + piece & WORD
            key = (key ^ key >> 30) * 0xBF58476D1CE4E5B9 & WORD
            key = (key ^ key >> 27) * 0x94D049BB133111EB & WORD
            return (key ^ key >> 31) >> 32 < limit

        return skip


class Path:
    """A chunk after given skips: the candidates from there on in turn, and the ids if none of those is skipped."""

    __slots__ = ("chunk", "skips", "known", "ids", "steps", "after")

    def __init__(self, vocabulary: Vocabulary, chunk: str, skips: tuple[int, ...] = (), known: int = 0):
        taken: list[int] = []

        def skip(place: int, piece: int) -> bool:
            taken.append((place << PLACE_BITS) + piece)
            return len(taken) - 1 in skips

        self.ids = array("I", merged(vocabulary, chunk, skip)).tobytes()
        self.steps = array("Q", taken[known:]).tobytes()
        self.chunk, self.skips, self.known = chunk, skips, known
        self.after: dict[int, Path] | None = None

    def bytes(self) -> int:
        return PATH_BYTES + len(self.ids) + len(self.steps) + 8 * len(self.skips)

    def size(self) -> tuple[int, int]:
        """Paths from here on, and the bytes they take."""
        sizes = [p.size() for p in (self.after or {}).values()]
        return 1 + sum(n for n, _ in sizes), self.bytes() + sum(b for _, b in sizes)


class Encoder:
    """Encodes texts one by one. ``remembered`` bounds the paths that are kept and ``room`` their bytes; they change no result."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int, remembered: int = REMEMBERED, room: int = ROOM):
        self.vocabulary, self.rate, self.seed, self.half, self.room = vocabulary, rate, seed, remembered // 2, room // 2
        self.paths: dict[str, Path] = {}
        self.older: dict[str, Path] = {}
        self.held = self.taken = 0
        self.chunks = re.compile(r" *[^ ]+| +").findall if vocabulary.cut else lambda text: [text]
        self.table = vocabulary.table

    def path(self, chunk: str) -> Path:
        """Of a chunk without skips, made or taken over from the older generation."""
        if self.held >= self.half or self.taken >= self.room:
            self.older, self.paths, self.held, self.taken = self.paths, {}, 0, 0
        path = self.older.pop(chunk, None) or Path(self.vocabulary, chunk)
        paths, taken = path.size()
        self.held += paths
        self.taken += taken
        self.paths[chunk] = path
        return path

    def further(self, path: Path, at: int) -> Path:
        """The path after a skip of the candidate ``at``, once it and those before it are settled."""
        if path.after is None:
            path.after = {}
        found = path.after.get(at)
        if found is None:
            at_all = path.known + at
            found = path.after[at] = Path(self.vocabulary, path.chunk, (*path.skips, at_all), at_all + 1)
            self.held += 1
            self.taken += found.bytes()
        return found

    def encode(self, doc_id: int | None, text: str | None) -> bytes:
        if not text:
            return b""
        variant = Variant(self.vocabulary, self.rate, self.seed, doc_id)
        chunks = self.chunks(" " + text)
        sizes = list(map(len, chunks))
        places = np.cumsum([0, *sizes[:-1]])
        get, make = self.paths.get, self.path
        if max(sizes) < LONG:
            short, parts = range(len(chunks)), [b""] * len(chunks)
        else:
            short, parts = [], []
            for i, chunk in enumerate(chunks):
                if sizes[i] < LONG:
                    short.append(i)
                    parts.append(b"")
                else:
                    parts.append(array("I", merged(self.vocabulary, chunk, variant.dropout(chunk, int(places[i])))).tobytes())
        paths = []
        for i in short:
            path = get(chunks[i])
            if path is None:
                path = make(chunks[i])
                get = self.paths.get  # a new generation may have begun
            paths.append(path)
        if len(paths) < len(chunks):
            places = places[np.array(short, "int64")]
        self._dropped(variant, paths, places.astype("uint64") << np.uint64(PLACE_BITS))
        if len(paths) == len(chunks):
            return b"".join([p.ids for p in paths])
        for i, path in zip(short, paths):
            parts[i] = path.ids
        return b"".join(parts)

    def _dropped(self, variant: Variant, paths: list[Path], places: np.ndarray) -> None:
        """Puts in place of each path the one that the draws of its occurrence lead to: one skip of each in a round."""
        if not variant.limit:
            return
        open_ = np.arange(len(paths))
        while len(open_):
            steps = [paths[i].steps for i in open_.tolist()]
            n = np.array(list(map(len, steps))) >> 3
            keys = np.frombuffer(b"".join(steps), "uint64") + np.repeat(places[open_], n)
            hits = np.flatnonzero(variant.skipped(keys))
            owners = np.repeat(np.arange(len(open_)), n)[hits]
            first = np.flatnonzero(np.diff(owners, prepend=-1))
            owners, hits = owners[first], hits[first]
            hits = hits - (np.cumsum(n) - n)[owners]
            open_ = open_[owners]
            for i, at in zip(open_.tolist(), hits.tolist()):
                paths[i] = self.further(paths[i], at)

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()[1:]


def grouped(vocabulary: Vocabulary, pairs: Pairs, rate: float, seed: int) -> GroupEncoder:
    """The encoder of groups of texts, with the draws of ``Variant``."""
    any_text = Variant(vocabulary, rate, seed, None)
    any_text.start = 0  # the keys already have the start of their document

    def alone(chunk: str, doc_id: int | None, at: int) -> list[str]:
        return _merged_long(vocabulary.scores, chunk, Variant(vocabulary, rate, seed, doc_id).dropout(chunk, at))

    return GroupEncoder(vocabulary, pairs, seed, any_text.skipped, alone, PLACE_BITS)


def encode_documents(
    spark: SparkSession, docs: DataFrame, model: str, rate: float = 0.1, seed: int = 0
) -> DataFrame:
    """``doc_id``, ``text``, ``ids`` and ``ids_crc32`` (of their little-endian 32-bit words) of every row.

    A null or empty text has no ids. A literal word-start mark in a text becomes its bytes, so it comes back as itself. The
    same seed, document id and text always give the same ids. Repeated rows are encoded each; an empty table gives no rows.
    """
    vocabulary = Vocabulary(model)
    shared = spark.sparkContext.broadcast((vocabulary, Pairs(vocabulary.scores)))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = grouped(*shared.value, rate, seed)
        for rows in in_groups(rows_of(batches)):
            ids, ends = encoder.many(rows)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            data, at = memoryview(ids.astype("<i4")).cast("B"), (4 * ends).tolist()
            sums = pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])], pa.int64())
            doc_ids, texts = zip(*rows)
            columns = [pa.array(doc_ids, pa.int64()), pa.array(texts, pa.string()), lists, sums]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    columns = "doc_id long, text string, ids array<int>, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, columns)


def decode(spark: SparkSession, model: str):
    """A column function: the text that an array of ids stands for."""
    shared = spark.sparkContext.broadcast(Vocabulary(model))

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        table = shared.value.table
        ends, values = ids.offsets.to_pylist(), ids.values.to_numpy()
        texts = (b"".join([table[i] for i in values[a:b].tolist()])[1:] for a, b in zip(ends[:-1], ends[1:]))
        return pa.array(texts, pa.binary()).cast(pa.string())

    return decoded


def digests(spark: SparkSession, encoded: DataFrame, model: str) -> DataFrame:
    """Pieces, their CRC-32 and whether decoding gives back the text, of every document."""
    text = F.coalesce("text", F.lit(""))
    return encoded.select(
        "doc_id",
        F.length(text).cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_pieces"),
        "ids_crc32",
        (decode(spark, model)("ids") == text).alias("lossless"),
    )
