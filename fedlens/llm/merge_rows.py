"""Merges with seeded dropout of all chunks of a group of texts at once.

The same agenda as in ``merge_dropout``, kept as a column of candidate costs beside each chunk: in every step each chunk takes
its best candidate, the leftmost of equals, draws by place and piece, and merges it or passes it over. Nothing is remembered
from one text to the next.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: A candidate is its cost, its place in the chunk and its piece in one number, so the least is the next in turn.
PLACE_AT, COST_AT = 20, 32
NONE = np.int64(1) << np.int64(62)
#: Lengths that chunks are padded to, and chunks that are merged side by side.
LENGTHS = np.array([2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64])
ROWS = 1 << 14


class Pairs:
    """Pieces and single characters as numbers, pieces first, and the candidate that each pair of them makes."""

    def __init__(self, scores: dict[str, tuple[int, int]]):
        known = {p: n for n, p in enumerate(scores)}
        self.pieces = len(known)
        for c in sorted({c for p in scores for c in p}):
            known.setdefault(c, len(known))
        self.other = len(known)
        if self.other >= 1 << PLACE_AT:
            raise ValueError(f"{self.other} pieces and characters are too many")
        self.ids = np.array([i for _, i in scores.values()], "int64")
        self.of_char = np.full(0x110000, self.other, "int32")
        for p, n in known.items():
            if len(p) == 1:
                self.of_char[ord(p)] = n
        made = {}
        for p, (cost, _) in scores.items():
            for k in range(1, len(p)):
                left, right = known.get(p[:k]), known.get(p[k:])
                if left is not None and right is not None:
                    made[left << PLACE_AT | right] = cost << COST_AT | known[p]
        self._hold(made)

    @classmethod
    def of_merges(cls, ids: dict[str, int], merges: list[tuple[str, str]]) -> Pairs:
        """Pieces by their ids, of which only the pairs of a list merge, the first of the list first."""
        self = cls.__new__(cls)
        self.pieces = self.other = max(ids.values()) + 1
        self.ids = np.arange(self.pieces)
        self._hold({ids[a] << PLACE_AT | ids[b]: rank << COST_AT | ids[a + b] for rank, (a, b) in enumerate(merges)})
        return self

    def _hold(self, made: dict[int, int]) -> None:
        self.bits = max(10, (4 * len(made)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, "int64"), np.full(1 << self.bits, NONE)
        keys, values = np.array(list(made), "int64"), np.array(list(made.values()), "int64")
        at = self._slot(keys)
        while len(keys):  # the first of those that want a free slot gets it, the others go one on
            wanted, first = np.unique(at, return_index=True)
            first = first[self.keys[wanted] < 0]
            self.keys[at[first]], self.made[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype("int64")

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Cost and piece of each pair, or NONE."""
        keys = left.astype("int64") << PLACE_AT | right
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.made[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            held, wanted = self.keys[at[open_]], keys[open_]
            same = held == wanted
            found[open_[same]] = self.made[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return found


def merge_rows(pairs: Pairs, parts: np.ndarray, skipped) -> None:
    """Merges chunks, given as columns of numbers that end in ``other``; what is merged into a part before it becomes -1.

    ``skipped(columns, places, ids)`` tells which candidates are passed over.
    """
    length, n = parts.shape
    length -= 1  # the last row stands for what is before the first part and after the last one
    flat = parts.reshape(-1)
    after = np.repeat(np.arange(1, length + 2, dtype="int64"), n)
    before = np.repeat(np.append(length, np.arange(length)), n)
    agenda = np.full((length + 1, n), NONE)
    for place in range(length - 1):
        agenda[place] = pairs.find(parts[place], parts[place + 1]) + (place << PLACE_AT)
    columns = np.arange(n)
    while True:
        best = agenda.min(axis=0)
        at = np.flatnonzero(best < NONE)
        if not len(at):
            return
        if 4 * len(at) < 3 * len(columns):
            agenda, columns, best, at = agenda[:, at], columns[at], best[at], np.arange(len(at))
        column, best = columns[at], best[at]
        place = best >> PLACE_AT & (1 << COST_AT - PLACE_AT) - 1
        piece = best & (1 << PLACE_AT) - 1
        passed = skipped(column, place, pairs.ids[piece])
        agenda[place[passed], at[passed]] = NONE
        at, column, place, piece = at[~passed], column[~passed], place[~passed], piece[~passed]
        here = place * n + column
        gone = after[here]
        there = gone * n + column
        following, previous = after[there], before[here]
        flat[here], flat[there] = piece, -1
        after[here] = following
        before[following * n + column] = place
        agenda[gone, at] = NONE
        left, right = flat[previous * n + column], flat[following * n + column]
        news = pairs.find(np.concatenate([left, piece]), np.concatenate([piece, right]))
        agenda[previous, at] = news[: len(at)] + (previous << PLACE_AT)
        agenda[place, at] = news[len(at) :] + (place << PLACE_AT)


def merge_chunks(pairs: Pairs, parts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, skipped) -> np.ndarray:
    """Merges chunks that stand one after another in ``parts``; tells which are longer than all LENGTHS and left as they are.

    ``skipped(chunks, places, ids)`` tells which candidates are passed over.
    """
    least = 1
    for length in LENGTHS.tolist():
        chosen = np.flatnonzero((lengths > least) & (lengths <= length))
        for at in range(0, len(chosen), ROWS):
            tile = chosen[at : at + ROWS]
            places = np.arange(length)[:, None]
            inside = places < lengths[tile]
            where = (starts[tile] + places)[inside]
            held = np.full((length + 1, len(tile)), pairs.other, "int32")
            held[:-1][inside] = parts[where]
            merge_rows(pairs, held, lambda column, place, ids: skipped(tile[column], place, ids))
            parts[where] = held[:-1][inside]
        least = length
    return np.flatnonzero(lengths > least)


class GroupEncoder:
    """Encodes groups of texts; every text gets the ids that ``merge_dropout.Encoder`` gives it.

    ``vocabulary`` has ``scores``, ``bytes`` and ``cut``; ``drawn(keys)`` tells of many candidates whether they are
    passed over, and ``alone(chunk, doc_id, place)`` gives the parts of a chunk that is longer than all LENGTHS.
    """

    def __init__(self, vocabulary, pairs: Pairs, seed: int, drawn, alone, place_bits: int):
        self.pairs, self.cut, self.seed, self.drawn, self.alone = pairs, vocabulary.cut, seed, drawn, alone
        self.number = {p: n for n, p in enumerate(vocabulary.scores)}
        self.bytes, self.place_bits = np.array(vocabulary.bytes, "int32"), place_bits

    def many(self, rows: list[tuple[int | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where those of each text begin and end."""
        whole = "".join([" " + t if t else "" for _, t in rows])
        sizes = [len(t) + 1 if t else 0 for _, t in rows]
        begins = np.cumsum([0, *sizes])
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        parts = self.pairs.of_char[points]
        first = np.zeros(len(points) + 1, bool)
        first[begins] = True
        if self.cut:
            space = points == 32
            first[1:-1] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(first)
        lengths, starts = np.diff(starts), starts[:-1]
        owner = np.searchsorted(begins, starts, "right") - 1
        hashes = np.array([xxhash.xxh64_intdigest(f"{self.seed}:{d}") for d, _ in rows], "uint64")
        keys = hashes[owner] + ((starts - begins[owner]).astype("uint64") << np.uint64(self.place_bits))
        shift = np.uint64(self.place_bits)

        def skipped(chunk: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
            return self.drawn(keys[chunk] + (place.astype("uint64") << shift) + ids.astype("uint64"))

        for k in merge_chunks(self.pairs, parts, starts, lengths, skipped).tolist():
            at = int(starts[k])
            chunk = whole[at : at + int(lengths[k])]
            found = self.alone(chunk, rows[owner[k]][0], at - int(begins[owner[k]]))
            parts[at : at + len(chunk)] = -1
            for p in found:
                parts[at] = self.number[p] if p in self.number else self.pairs.of_char[ord(p)]
                at += len(p)
        return self._ids(parts, points, begins)

    def _ids(self, parts: np.ndarray, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as their ids, characters that are no piece as those of their bytes."""
        plain = parts < self.pairs.pieces
        widths = (parts >= 0).astype("int64")
        odd = points[~plain]
        widths[~plain] += (odd > 0x7F).astype("int64") + (odd > 0x7FF) + (odd > 0xFFFF)
        ends = np.append(0, np.cumsum(widths))[begins]
        ids = np.empty(ends[-1], "int32")
        from_bytes = np.repeat(~plain, widths)
        ids[~from_bytes] = self.pairs.ids[parts[plain & (parts >= 0)]]
        ids[from_bytes] = self.bytes[np.frombuffer(odd.tobytes().decode("utf-32-le").encode(), "uint8")]
        return ids, ends
