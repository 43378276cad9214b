"""Ids of the pieces of a group of texts, cut and looked up side by side.

Texts of ASCII and Latin letters have a byte a character, so they are cut by arrays at the places where the library's pattern
cuts them, and a piece of up to 16 characters is a key of two numbers. What pieces came to is remembered in a table of open
addressing; those that a group has for the first time are encoded together, each once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

BETWEEN, SPACE, LETTER, DIGIT, OTHER, ODD = range(6)
#: White space, printable ASCII and Latin letters; any other character takes its text out.
ODD_CHARACTER = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]").search
KIND = np.full(256, ODD, "uint8")
KIND[0], KIND[32], KIND[9:14] = BETWEEN, SPACE, SPACE
for _c in map(chr, [*range(33, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]):
    KIND[ord(_c)] = LETTER if _c.isalpha() else DIGIT if _c.isdigit() else OTHER
LOWER = np.array([ord(chr(b).lower()) for b in range(256)], "uint8")
#: Characters of a key, and the numbers that leave so many of eight.
KEY = 16
LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], "uint64")
#: Texts longer than this are encoded by chunks, which take less memory.
MOST_CHARS = 1 << 22


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every place of the stretches, one stretch after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def joined(texts: list[str]) -> np.ndarray | None:
    """Texts as a byte a character with a zero before, between and three after them, or None if one has an odd character."""
    try:
        data = np.frombuffer(("\0" + "\0".join(texts) + "\0" * 3).encode("latin-1"), "uint8")
    except UnicodeEncodeError:
        return None
    kinds = KIND[data]
    return None if (kinds == ODD).any() or np.count_nonzero(kinds == BETWEEN) != len(texts) + 3 else data


def cut(data: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the pieces. With ``words``, of lower-case text, white space is dropped and digits are single;
    without, pieces have the space before them, and the last of more white space stands alone if it is no space."""
    kinds = KIND[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    if words:
        first |= kinds == DIGIT
    else:
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] >= LETTER))
        first[last] = True
        first[last[data[last] == 32] + 1] = False
    marks = np.flatnonzero(data == 39)
    if len(marks):  # 's, 't, 're, 've, 'm, 'll and 'd, where a piece begins with them
        marks = marks[kinds[marks - 1] != OTHER]
        if not words:
            marks = marks[data[marks - 1] != 32]
        one, two = data[marks + 1], data[marks + 2]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = (one == ord("l")) & (two == ord("l")) | ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        first[marks[short | long] + 1] = False
        first[marks[short] + 2] = True
        first[marks[long] + 3] = True
    at = np.flatnonzero(first)
    lengths = np.diff(at, append=len(data))
    chosen = kinds[at] >= (LETTER if words else SPACE)
    return at[chosen], lengths[chosen]


class PieceTable:
    """Remembers ids by piece. ``encode(characters, lengths)`` gives ids of pieces that stand one after another, a byte a
    character, and the number of ids of each. When ``bound`` pieces are met the table begins anew."""

    def __init__(self, words: bool, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bound: int = 500_000):
        self.words, self.encode, self.bound = words, encode, bound
        self._clear(12)

    def _clear(self, bits: int) -> None:
        self.bits, self.held, self.used = bits, 0, 0
        self.rows = np.zeros((1 << bits, 4), "uint64")  # key, place in the pool and number of ids; no key is 0
        self.pool = np.empty(1 << 16, "int32")
        self.long: dict[bytes, tuple[int, int]] = {}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - self.bits)).astype("int64")

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place and number of the ids of every key; the number of a new one is 0."""
        at = self._slots(keys)
        rows = self.rows[at]
        same = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1])
        found = rows[:, 2:].astype("int64")
        rest = np.flatnonzero(~same & (rows[:, 0] > 0))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            rows, wanted = self.rows[at[rest]], keys[rest]
            same = (rows[:, 0] == wanted[:, 0]) & (rows[:, 1] == wanted[:, 1])
            done = same | (rows[:, 0] == 0)
            found[rest[done]] = rows[done, 2:].astype("int64")
            rest = rest[~done]
        return found

    def _add(self, rows: np.ndarray) -> None:
        """Adds rows whose keys are new and differ."""
        if 2 * (self.held + len(rows)) > 1 << self.bits:
            old = self.rows[self.rows[:, 0] > 0]
            self.bits, self.held = (4 * (self.held + len(rows))).bit_length(), 0
            self.rows = np.zeros((1 << self.bits, 4), "uint64")
            rows = np.concatenate([old, rows])
        self.held += len(rows)
        at = self._slots(rows)
        while len(rows):  # the first of those that want a free slot gets it, the others go one on
            free = np.flatnonzero(self.rows[at, 0] == 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.rows[at[placed]] = rows[placed]
            rest = np.ones(len(rows), bool)
            rest[placed] = False
            rows, at = rows[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces into the pool; tells where the ids of each are and how many."""
        ids, counts = self.encode(data[ragged(starts, lengths)], lengths)
        if self.used + len(ids) > len(self.pool):
            pool = np.empty(2 * (self.used + len(ids)), "int32")
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool
        self.pool[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return places, counts

    def many(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``joined`` data, one text after another, and how many there are before each and in all."""
        if self.held + len(self.long) >= self.bound or self.used >= 8 * self.bound:
            self._clear(12)
        if self.words:
            data = LOWER[data]
        starts, lengths = cut(data, self.words)
        padded = np.append(data, np.zeros(KEY, "uint8"))
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        keys = np.empty((len(starts), 2), "uint64")
        keys[:, 0] = eight[starts] & LEFT[np.minimum(lengths, 8)]
        keys[:, 1] = eight[starts + 8] & LEFT[np.clip(lengths - 8, 0, 8)]
        found = self._find(keys)
        short = lengths <= KEY
        if not short.all():
            self._long(data, starts, lengths, found, np.flatnonzero(~short))
        new = np.flatnonzero((found[:, 1] == 0) & short)
        if len(new):
            order = new[np.lexsort((keys[new, 1], keys[new, 0]))]
            differs = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1))
            each = order[differs]
            places, counts = self._learn(data, starts[each], lengths[each])
            self._add(np.column_stack([keys[each], places.astype("uint64"), counts.astype("uint64")]))
            found[order] = np.column_stack([places, counts])[np.cumsum(differs) - 1]
        ids = self.pool[ragged(found[:, 0], found[:, 1])]
        texts = np.flatnonzero(data == 0)[:-2]
        return ids, np.append(0, np.cumsum(found[:, 1]))[np.searchsorted(starts, texts)]

    def _long(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, found: np.ndarray, chosen: np.ndarray) -> None:
        """Fills in ``found`` for pieces that are too long for a key."""
        pieces = [data[a : a + n].tobytes() for a, n in zip(starts[chosen].tolist(), lengths[chosen].tolist())]
        new = {p: k for p, k in zip(pieces, chosen.tolist()) if p not in self.long}
        if new:
            each = np.array(list(new.values()))
            places, counts = self._learn(data, starts[each], lengths[each])
            self.long.update(zip(new, zip(places.tolist(), counts.tolist())))
        found[chosen] = [self.long[p] for p in pieces]
        for piece in new:
            if len(piece) >= 64:
                del self.long[piece]


def by_pieces(table: PieceTable, texts: list[str], added: list[str]) -> list[bytes] | None:
    """Ids of every text as little-endian 32-bit bytes, or None if one has other characters, an added token or great length."""
    if any(len(t) > MOST_CHARS or any(name in t for name in added) for t in texts) or (data := joined(texts)) is None:
        return None
    found, ends = table.many(data)
    ids, at = found.astype("<u4").tobytes(), (4 * ends).tolist()
    return [ids[a:b] for a, b in zip(at, at[1:])]


def by_pieces_or(table: PieceTable, texts: list[str | None], added: list[str], others: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Ids of every text; ``others`` encodes those that can't go by pieces."""
    texts = [t or "" for t in texts]
    if (found := by_pieces(table, texts, added)) is not None:
        return found
    odd = [ODD_CHARACTER(t) is not None or len(t) > MOST_CHARS or any(name in t for name in added) for t in texts]
    pieced = iter(by_pieces(table, [t for t, is_odd in zip(texts, odd) if not is_odd], added) or ())
    rest = iter(others([t for t, is_odd in zip(texts, odd) if is_odd]))
    return [next(rest if is_odd else pieced) for is_odd in odd]
