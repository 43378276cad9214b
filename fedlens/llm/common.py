"""Helpers that several operators share."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.merge_rows import Pairs, merge_chunks
from fedlens.llm.piece_table import PieceTable, by_pieces_or
from fedlens.session import cut_lineage
from fedlens.sources.tables import table

#: White space that parts words; bytes.split() parts at the same six.
WORD_SQL = r"[^\x20\x09-\x0D]+"
END_ID = 1
BATCH_CHARS = 1 << 20
#: White space outside ASCII, or characters that only some libraries count as such.
ODD_SPACE = r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage and is computed once."""
    return cut_lineage(spark, df, purpose)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; a null text has none."""
    return text.encode().split() if text else []


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, every other character untouched."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches one by one, so that only one batch is held."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, weight=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, or of about BATCH_CHARS where ``weight`` gives a row's size."""
    held: list[tuple] = []
    heavy = 0
    for row in rows:
        held.append(row)
        heavy += weight(row) if weight else 0
        if len(held) >= size or heavy >= BATCH_CHARS:
            yield _batch(held, schema)
            held, heavy = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def in_groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (id, text) in groups of about BATCH_CHARS characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if size >= BATCH_CHARS or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


# Fixed value: the split of the word vocabulary that chunks are proven for.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SYMBOLS = [chr(b) if b in SHOWN else chr(256 + b - sum(x < b for x in SHOWN)) for b in range(256)]


def byte_symbols(text: str) -> str:
    return "".join([SYMBOLS[b] for b in text.encode()])


class Merges:
    """Ids of pieces by the merges of a byte-level vocabulary, without a remembered word."""

    def __init__(self, model, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.model, self.pairs = model, Pairs.of_merges(vocab, merges)
        self.inner = np.array([vocab[c] for c in SYMBOLS], "int32")
        self.last = np.array([vocab[c + end] for c in SYMBOLS], "int32")

    def many(self, characters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that stand one after another, a byte a character, and the number of ids of each."""
        data = np.frombuffer(characters.tobytes().decode("latin-1").encode(), "uint8")
        ends = np.append(0, np.cumsum(1 + (characters >= 0x80)))[np.cumsum(lengths)]
        starts = np.append(0, ends[:-1])
        parts = self.inner[data]
        parts[ends - 1] = self.last[data[ends - 1]]
        long = merge_chunks(self.pairs, parts, starts, ends - starts, lambda chunk, place, ids: np.zeros(len(ids), bool))
        for k in long.tolist():
            found = [t.id for t in self.model.tokenize(byte_symbols(data[starts[k] : ends[k]].tobytes().decode()))]
            parts[starts[k] : ends[k]] = -1
            parts[starts[k] : starts[k] + len(found)] = found
        whole = parts >= 0
        return parts[whole], np.diff(np.append(0, np.cumsum(whole))[ends], prepend=0)


class ChunkEncoder(dict):
    """Token ids of text as little-endian unsigned 32-bit bytes, remembered by chunk.

    No piece of the two supported kinds of vocabulary reaches from a character that is not white space to one that is, nor
    from a letter to punctuation, so a text may be cut there and its chunks encoded apart; of other files, texts are encoded
    whole. ``words`` says that white space is dropped altogether. Texts with white space outside ASCII, or with characters
    that only some libraries call white space, are encoded whole. At most ``bound`` chunks are remembered, in two generations:
    what was not met while the younger filled up is forgotten. Chunks of plain letters, and with ``words`` those of printable
    ASCII and Latin letters, need no normalising but lower case: they go to the merges directly, by the pieces that WORD_SPLIT
    makes of them. The others of a group of texts go to the library in one call.

    Texts of ASCII and Latin letters alone take no chunks: their pieces are found and looked up by arrays (``piece_table``).
    """

    def __init__(self, path: str, words: bool, bound: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.words, self.half = Tokenizer.from_file(path), words, bound // 2
        self.older: dict[str, bytes] = {}
        letters = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?=[,.;:!?|)])"
        self.cut = str.split if words else re.compile(rf"\s*{letters}|\s*\S+|\s+", re.ASCII).findall
        # "<" begins the added tokens, which are looked for before anything else
        self.plain = re.compile(r"[!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+" if words else " ?[A-Za-z]+").fullmatch
        self.pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall
        self.odd = re.compile(ODD_SPACE).search
        self.known = self._known(path)

    def _known(self, path: str) -> bool:
        """Whether the file's rules are those that the cuts hold for."""
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        before = rules["pre_tokenizer"] or {}
        model, end = rules["model"], rules["model"].get("end_of_word_suffix") or ""
        self.added = [token["content"] for token in rules["added_tokens"]]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "ignore_merges") if model.get(k)]
        shown = all(c + x in model["vocab"] for c in SYMBOLS for x in ("", end)) if model["type"] == "BPE" else False
        self.pieced = shown and not odd
        if self.pieced:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merges = Merges(self.tokenizer.model, model["vocab"], merges, end)
            # the table must not hold the encoder, or what a task remembered would outlive it
            self.table = PieceTable(self.words, self.merges.many)
        if self.words:
            first = before.get("pretokenizers", [{}])[0]
            if not self.pieced or any("<" not in name for name in self.added):
                return False
            return first.get("pattern") == {"Regex": WORD_SPLIT} and first["behavior"] == "Removed" and first["invert"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        return plain and rules["normalizer"] is None

    def chunks(self, text: str | None) -> list[str]:
        return [] if not text else self.cut(text) if self.known and not self.odd(text) else [text]

    def learn(self, chunks: set[str]) -> None:
        """Remembers the ids of all ``chunks``."""
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        rest, plain = [], []
        for chunk in chunks.difference(self):
            if (ids := self.older.get(chunk)) is not None:
                self[chunk] = ids
            elif self.known and self.plain(chunk):
                plain.append(chunk)
            else:
                rest.append(chunk)
        if self.words:
            self.learn_words(plain)
        else:
            tokenize = self.tokenizer.model.tokenize
            self.update((c, array("I", [t.id for t in tokenize(c.replace(" ", "\u0120"))]).tobytes()) for c in plain)
        for chunk, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self[chunk] = array("I", found.ids).tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Words of printable ASCII and Latin letters; their pieces are words themselves and remembered as such."""
        split = list(map(self.pieces, "\n".join(words).lower().split("\n"))) if words else []
        new = list(set().union(*split).difference(self))
        if new:
            found, counts = self.merges.many(np.frombuffer("".join(new).encode("latin-1"), "uint8"), np.array(list(map(len, new))))
            at, ids = np.append(0, 4 * np.cumsum(counts)).tolist(), found.astype("<u4").tobytes()
            self.update(zip(new, [ids[a:b] for a, b in zip(at, at[1:])]))
        get = self.__getitem__
        self.update(zip(words, [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in split]))

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; pieces and chunks that are new to the task are encoded once for all of them."""
        if not (self.known and self.pieced):
            return self.by_chunks(texts)
        return by_pieces_or(self.table, texts, self.added, self.by_chunks)

    def by_chunks(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; chunks that are new to the task are encoded once for all of them."""
        chunked = [self.chunks(t) for t in texts]
        met = set().union(*chunked)
        self.learn(met)
        found = [b"".join(map(self.__getitem__, chunks)) for chunks in chunked]
        for chunk in met:
            if len(chunk) >= 64:
                del self[chunk]
        return found

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


def crc(data: bytes) -> int:
    return zlib.crc32(data)
