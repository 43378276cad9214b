"""Byte-pair encoding of distinct words along their trie.

The encoding of a prefix is that of a shorter prefix and one last token, so one state a node is enough: which token ends
there. Distinct words are taken in sorted order, which walks their trie depth first; the states of the current path are
kept, and what words share is computed once. A token may follow another if no merge reaches across them at any time while
both are made; that is asked along the two inner edges of their merge trees. A word's ids are read back from its last node.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import ODD_SPACE, SYMBOLS, WORD_SPLIT, batches_of, in_groups, rows_of
from fedlens.llm.piece_table import PieceTable, by_pieces_or, ragged

ENCODED = "doc_id long, ids array<int>, ids_sha256 string"
#: Added to the last character of a word: it stands for the symbol with the end mark.
CLOSED = 0x1000
NEVER = 1 << 62
SYMBOL_POINTS = np.array([ord(c) for c in SYMBOLS], "<u4")
#: Ids that are decoded at once.
DECODED = 1 << 18
#: Bytes of the bound that stand for one word of the table.
WORD_BYTES = 256
REMEMBERED_BYTES = 128 << 20
REMEMBERED_PAIRS = 250_000
#: Cuts that hold for files with WORD_SPLIT; others are cut nowhere.
#: The same split for lower-case printable ASCII, whose bytes are their own symbols.
ASCII_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+", re.ASCII).findall
CUT = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?=[,.;:!?|)])|\\S+", re.ASCII)


class MergeTable:
    """Merges of a byte-level word tokenizer file, checked for what the walk needs: every token is made by one merge, of
    parts that were made before it, and every byte is a symbol."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"not a plain merge vocabulary: {odd or model['type']}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand for themselves")
        spec["truncation"] = spec["padding"] = None
        self.json = Tokenizer.from_str(json.dumps(spec)).to_str()
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"]["type"] == "Sequence" else {}
        self.cuts = split.get("pattern") == {"Regex": WORD_SPLIT} and split["behavior"] == "Removed" and split["invert"]
        self.pieces = {i: p for p, i in (model["vocab"] | self.added).items()}
        ids = {self._symbols(p): i for p, i in model["vocab"].items()}
        alphabet = pre_tokenizers.ByteLevel.alphabet()
        if not all(b in ids and (not self.end or self.closed(b) in ids) for b in alphabet):
            raise ValueError("a byte has no symbol")
        self.left, self.right, self.rank = {}, {}, dict.fromkeys(ids.values(), -1)
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (ids[self._symbols(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[self._symbols(self.pieces[a] + self.pieces[b])]
            if whole in self.left or any(x not in self.left and len(self.symbols_of(x)) > 1 for x in (a, b)):
                raise ValueError(f"merge {rank} is out of order")
            self.left[whole], self.right[whole], self.rank[whole], self.merges[a, b] = a, b, rank, rank
        sound: dict[str, int] = {}
        for text, token in sorted(ids.items(), key=lambda item: self.rank[item[1]]):
            if token in self.left:
                a, b = self.left[token], self.right[token]
                if self.symbols_of(a) not in sound or self.symbols_of(b) not in sound or not self._apart(a, b, self.rank[token]):
                    continue  # its own letters merge otherwise, so it is never made
            elif len(text) > 1:
                continue
            sound[text] = token
        self._find_endings(sound)
        self.known: dict[tuple[int, int], bool] = {}

    def _find_endings(self, sound: dict[str, int]) -> None:
        """``edges``: node of the tokens' own trie and symbol to node; ``link``: node of the longest proper ending; ``ending``:
        the tokens that end at a node with their lengths, longest first."""
        nodes = {"": 0}
        for text in sorted({t[:k] for t in sound for k in range(1, len(t) + 1)}, key=len):
            nodes[text] = len(nodes)
        self.edges = {(nodes[t[:-1]], t[-1]): node for t, node in nodes.items() if t}
        self.link, self.ending = [0] * len(nodes), [()] * len(nodes)
        for text, node in nodes.items():
            if len(text) > 1:
                self.link[node] = self.step(self.link[nodes[text[:-1]]], text[-1])
            own = ((sound[text], len(text)),) if text in sound else ()
            self.ending[node] = own + self.ending[self.link[node]]

    def step(self, node: int, symbol: str) -> int:
        """The node of the longest ending of what was read, after one more symbol."""
        while (after := self.edges.get((node, symbol))) is None and node:
            node = self.link[node]
        return after or 0

    def symbols_of(self, token: int) -> str:
        return self._symbols(self.pieces[token])

    def _symbols(self, piece: str) -> str:
        if any(ord(c) >= CLOSED for c in piece):
            raise ValueError(f"not byte-level: {piece!r}")
        whole = len(piece) - len(self.end)
        return self.closed(piece[:whole]) if self.end and whole > 0 and piece.endswith(self.end) else piece

    def closed(self, word: str) -> str:
        """A word as symbols, one character each."""
        return word[:-1] + chr(ord(word[-1]) + CLOSED) if self.end else word

    def _apart(self, a: int, b: int, own: int = -1) -> bool:
        """Whether no merge but ``own`` joins a piece at the end of ``a`` to one at the start of ``b``.

        The two pieces that meet are followed back in time. A merge across would come first if its rank is below those
        at which the two go into larger pieces; of equal merges the left one comes first.
        """
        until_a = until_b = NEVER
        rank, merges = self.rank, self.merges
        while True:
            across = merges.get((a, b), NEVER)
            if across < until_a and across <= until_b and across != own:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until_a, a = rank[a], self.right[a]
            else:
                until_b, b = rank[b], self.left[b]

    def follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may stand after ``a``; remembered."""
        if len(self.known) >= REMEMBERED_PAIRS:
            self.known.clear()
        found = self.known[a, b] = self._apart(a, b)
        return found

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of every word (given as symbols), by one walk over the trie of all of them."""
        known, follows, ending, edges, step = self.known, self.follows, self.ending, self.edges, self.step
        tokens: list[int] = []  # the last token at every node of the current path, how many symbols it has, and the place
        sizes: list[int] = []  # in the tokens' trie
        nodes: list[int] = [0]
        done, before = {}, ""
        for word in sorted(words):
            at = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                at += 1
            del tokens[at:], sizes[at:], nodes[at + 1 :]
            node = nodes[at]
            for end in range(at + 1, len(word) + 1):
                symbol = word[end - 1]
                node = edges.get((node, symbol)) or step(node, symbol)
                for token, n in ending[node]:
                    if n == end:
                        break
                    pair = tokens[end - n - 1], token
                    if known[pair] if pair in known else follows(*pair):
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                tokens.append(token)
                sizes.append(n)
                nodes.append(node)
            ids, at = [], len(word)
            while at:
                ids.append(tokens[at - 1])
                at -= sizes[at - 1]
            done[word], before = ids[::-1], word
        return done

    def encode_rows(self, characters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that stand one after another, a byte a character, and the number of ids of each."""
        ends = np.append(0, np.cumsum(1 + (characters >= 0x80)))[np.cumsum(lengths)]
        symbols = SYMBOL_POINTS[np.frombuffer(characters.tobytes().decode("latin-1").encode(), "uint8")]
        symbols[ends - 1] += CLOSED if self.end else 0
        whole, at = symbols.tobytes().decode("utf-32-le"), [0, *ends.tolist()]
        words = [whole[a:b] for a, b in zip(at, at[1:])]
        found = list(map(self.encode(words).__getitem__, words))
        counts = np.fromiter(map(len, found), "int64", len(found))
        return np.fromiter(chain.from_iterable(found), "int32", counts.sum()), counts


class Encoder:
    """Ids of whole texts. Words of texts of ASCII and Latin letters are looked up by arrays and walked once a task; of other
    texts, what chunks came to is remembered by bytes, in two generations."""

    def __init__(self, table: MergeTable, bound: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        rules = Tokenizer.from_str(table.json)
        self.normal, self.split = rules.normalizer, rules.pre_tokenizer
        self.table, self.half, self.held = table, bound // 2, 0
        self.rows = PieceTable(True, table.encode_rows, bound // WORD_BYTES)
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = re.compile("[A-Za-z]+").fullmatch if table.cuts else lambda chunk: None
        self.odd = re.compile(ODD_SPACE).search
        names = sorted(map(re.escape, table.added), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(names)})" if names else "((?!))")

    def chunks(self, text: str) -> list[str]:
        return CUT.findall(text) if self.table.cuts and not self.odd(text) else [text] if text else []

    def words(self, chunk: str) -> list[str | int]:
        """Words of a chunk as symbols; an added token is its id."""
        if self.plain(chunk):
            return [self.table.closed(chunk.lower())]
        found: list[str | int] = []
        for k, part in enumerate(self.special.split(chunk)):
            if k % 2:
                found.append(self.table.added[part])
            elif part and self.table.cuts and part.isascii() and part.isprintable():
                found += [self.table.closed(w) for w in ASCII_SPLIT(part.lower())]
            elif part:
                normal = self.normal.normalize_str(part) if self.normal else part
                found += [self.table.closed(w) for w, _ in self.split.pre_tokenize_str(normal) if w]
        return found

    def learn(self, chunks: set[str]) -> None:
        """Remembers the ids of all ``chunks``; those of the group before last are forgotten when the bound is met."""
        if self.held >= self.half:
            self.older, self.young, self.held = self.young, {}, 0
        young, older = self.young, self.older
        parts = {}
        for chunk in chunks:
            if chunk not in young:
                if (ids := older.get(chunk)) is not None:
                    self._keep(chunk, ids)
                else:
                    parts[chunk] = self.words(chunk)
        coded = self.table.encode({w for words in parts.values() for w in words if isinstance(w, str)})
        packed = {w: b"".join([i.to_bytes(4, "little") for i in ids]) for w, ids in coded.items()}
        for chunk, words in parts.items():
            self._keep(chunk, b"".join([packed[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in words]))

    def _keep(self, chunk: str, ids: bytes) -> None:
        self.young[chunk] = ids
        self.held += len(chunk) + len(ids) + 200

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text; the words of all are walked together."""
        if not self.table.cuts:
            return self.by_chunks(texts)
        return by_pieces_or(self.rows, texts, list(self.table.added), self.by_chunks)

    def by_chunks(self, texts: list[str | None]) -> list[bytes]:
        chunked = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*chunked))
        return [b"".join(map(self.young.__getitem__, chunks)) for chunks in chunked]


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encoded(table: MergeTable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) to batches of IDS."""
    encoder = Encoder(table)

    def rows() -> Iterator[tuple]:
        for group in in_groups(rows_of(batches)):
            for (doc_id, _), ids in zip(group, encoder.encode([text for _, text in group])):
                yield doc_id, np.frombuffer(ids, "<i4"), hashlib.sha256(ids).hexdigest()

    yield from batches_of(rows(), IDS, weight=lambda r: len(r[1]))


class Decoder:
    """Texts of lists of ids: pieces joined by spaces, as a file without decoder has it."""

    def __init__(self, table: MergeTable):
        pieces = {i: p.encode() + b" " for i, p in table.pieces.items()}
        self.sizes = np.zeros(max(pieces) + 1, "int64")
        self.sizes[list(pieces)] = list(map(len, pieces.values()))
        self.places = np.zeros(len(self.sizes), "int64")
        self.places[list(pieces)] = np.cumsum([0, *map(len, pieces.values())])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces.values()), "uint8")

    def __call__(self, ids: pa.ListArray) -> Iterator[bytes]:
        """UTF-8 of the text of every list."""
        ends, values = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
        at = 0
        while at + 1 < len(ends):
            to = at + 1
            while to + 1 < len(ends) and ends[to + 1] - ends[at] <= DECODED:
                to += 1
            part = values[ends[at] : ends[to]]
            if len(part) and (part.min() < 0 or part.max() >= len(self.sizes) or not self.sizes[part].all()):
                raise ValueError("an id has no piece")
            sizes = self.sizes[part]
            text = self.bytes[ragged(self.places[part], sizes)].tobytes()
            cuts = np.append(0, np.cumsum(sizes))[np.array(ends[at : to + 1]) - ends[at]].tolist()
            yield from (text[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:]))
            at = to


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``ids_sha256`` (of little-endian 32-bit words) of every row's whole text.

    A null or empty text has no ids. Names of added tokens in a text become these tokens, as the library has it. Repeated
    rows are encoded each; an empty table gives no rows; other columns are not read. The table of merges is broadcast: its
    size is that of the vocabulary. No shuffle.
    """
    shared = spark.sparkContext.broadcast(MergeTable(tokenizer))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(lambda batches: encoded(shared.value, batches), ENCODED)


def decode_documents(spark: SparkSession, ids: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id`` and ``text``, what every row's ``ids`` decode to."""
    shared = spark.sparkContext.broadcast(MergeTable(tokenizer))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = Decoder(shared.value)
        for batch in batches:
            texts = pa.array([text.decode() for text in decoded(batch["ids"])], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], texts], schema=schema)

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def digests(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of what they decode to; ids stay in the task."""
    shared = spark.sparkContext.broadcast(MergeTable(tokenizer))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = Decoder(shared.value)
        for batch in encoded(shared.value, batches):
            sizes = pa.array(batch["ids"].value_lengths().to_pylist(), pa.int64())
            shas = pa.array([hashlib.sha256(text).hexdigest() for text in decoded(batch["ids"])], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, batch["ids_sha256"], shas], schema=DIGESTS)

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
