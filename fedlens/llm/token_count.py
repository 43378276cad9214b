"""Token counts by greedy longest match, in one pass over the bytes of a word.

The vocabulary becomes a trie whose nodes carry a failure link and the number of pieces that following the link completes.
A word is read byte by byte; where the trie has no edge, the count grows by the node's number and reading goes on at its
link. No piece is ever built, and a word takes time linear in its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import batches_of, rows_of, words_of

COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """``edges``: node and byte to node; ``link``: failure link, -1 for none; ``pops``: pieces that the link completes;
    ``rest``: pieces from a node to the end of the word, -1 where the rest can't be cut into pieces."""

    def __init__(self, vocabulary: Iterable[bytes]):
        edges: dict[int, int] = {}
        below: list[list[tuple[int, int]]] = [[]]
        ends = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(ends)
                    below[node].append((byte, len(ends)))
                    below.append([])
                    ends.append(False)
                node = edges[key]
            ends[node] = node > 0
        link, pops, rest = [-1] * len(ends), [0] * len(ends), [0] * len(ends)
        level = [0]
        while level:
            deeper = []
            for node in level:
                for byte, child in below[node]:
                    deeper.append(child)
                    if ends[child]:
                        link[child], pops[child] = 0, 1
                    else:
                        at, n = link[node], pops[node]
                        while at >= 0 and at << 8 | byte not in edges:
                            at, n = link[at], n + pops[at]
                        if at >= 0:
                            link[child], pops[child] = edges[at << 8 | byte], n
                    known = link[child] >= 0 and rest[link[child]] >= 0
                    rest[child] = pops[child] + rest[link[child]] if known else -1
            level = deeper
        self.edges, self.link, self.pops, self.rest = edges, link, pops, rest

    def count(self, word: bytes) -> int:
        """Number of pieces, -1 where the greedy cut gets stuck."""
        edges, link, pops = self.edges.get, self.link, self.pops
        node = n = 0
        for byte in word:
            while (after := edges(node << 8 | byte)) is None:
                n, node = n + pops[node], link[node]
                if node < 0:
                    return -1
            node = after
        return n + self.rest[node] if self.rest[node] >= 0 else -1


class Remembered(dict):
    """Counts by word, at most REMEMBERED of them; long words are not kept."""

    def __init__(self, automaton: Automaton, prefix: bytes):
        super().__init__()
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(self.prefix + word)
        if len(word) < 64:
            self[word] = n
        return n


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: Iterable[bytes], prefix: bytes = b" ") -> DataFrame:
    """Words, tokens and unknown words of every whole text.

    ``prefix`` stands before each word, so tokens that begin with it are word-initial. A word that can't be cut counts as
    one unknown token. A null or text without words has 0 of each; repeated rows are counted each; an empty table gives no
    rows. Only ``doc_id`` and ``text`` are read. The automaton is broadcast: its size is that of the vocabulary.
    """
    shared = spark.sparkContext.broadcast(Automaton(vocabulary))
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_words", "n_tokens", "n_unknown")])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Remembered(shared.value, prefix)

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                each = [pieces[w] for w in words_of(text)]
                unknown = each.count(-1)
                yield doc_id, len(each), sum(each) + 2 * unknown, unknown

        yield from batches_of(rows(), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, COUNTS)
