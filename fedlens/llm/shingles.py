"""Hashed word shingles of texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of more bytes are hashed one by one.
LONG_WORD = 64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a number that belong to a word of which so many are left.
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], "uint64")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, by place in the text; none where the text is shorter."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    total = np.zeros(n, "uint64")
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[k : k + n] + np.uint64(k))
    return mixed(total)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data`` and where they start; eight bytes of all words are taken in at once."""
    whole = np.frombuffer(data + bytes(8), "uint8")
    edges = np.flatnonzero(np.diff(~SPACE[whole[: len(data)]], prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) + 1, "<u8", whole.data, strides=(1,))
    hashes = lengths.astype("uint64")
    at, from_, left = np.arange(len(starts)), starts, lengths
    for _ in range(LONG_WORD // 8):
        if not len(at):
            break
        hashes[at] = mixed(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + (eight[from_] & KEPT[np.minimum(left, 8)]))
        more = left > 8
        at, from_, left = at[more], from_[more] + 8, left[more] - 8
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + lengths[k]])
    return hashes, starts


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Distinct shingles of each lower-cased text, sorted; a shorter text is one shingle; without words, none."""
    parts = [t.encode().lower() if t else b"" for t in texts]
    hashes, starts = word_hashes(b"\n".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    bounds = np.append(0, np.searchsorted(starts, ends)).tolist()
    runs = windows(hashes, size)
    found = []
    for a, b in zip(bounds, bounds[1:]):
        tokens = np.sort(runs[a : b - size + 1] if b - a >= size else windows(hashes[a:b], b - a) if b > a else runs[:0])
        found.append(tokens[np.append(True, tokens[1:] != tokens[:-1])] if len(tokens) else tokens)
    return found
