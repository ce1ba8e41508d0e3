"""Words of many texts at once as 64-bit hashes, and hashes of runs of words.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text; with ``lower`` A-Z count as a-z. A word's hash mixes its length and
its bytes eight at a time, each step a bijection of the state that is not linear in the bytes; words of more than
``LONG`` bytes are hashed by BLAKE2. A run's hash is the sum of its words' hashes times powers of an odd base, so that it
follows from two prefix sums; runs are tens of words at most, too short for the known collisions of such sums.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C17 | 3)  # 3 modulo 4: base - 1 holds the factor 2 only once
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Words of more bytes than this are hashed one by one.
LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    if len(have := _powers.get(int(base), ())) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit hash of each data[start : end]; another ``seed`` gives an independent one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    size = end - start
    out = mixed(size.astype(np.uint64) * BASE + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64)))
    for at in range(0, LONG, 8):
        own = np.flatnonzero(size > at) if at else slice(None)
        if at and not len(own):
            break
        step = eight[start[own] + at] & _MASK[np.minimum(size[own] - at, 8)]
        out[own] = mixed(out[own] * np.uint64(0x9FB21C651E98DF25) ^ mixed(step + np.uint64(seed)))
    for i in np.flatnonzero(size > LONG).tolist():
        word = data[start[i] : end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


@dataclass
class Words:
    """Of the words of a slice of texts: hash, text, first and last byte + 1 in ``data``; ``first[d]`` to ``first[d + 1]`` are those of text d."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def second(self) -> np.ndarray:
        """Hashes of the words that are independent of ``hash``."""
        return word_hashes(self.data, self.start, self.end, 1)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 as they stand, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins, with the end of the last. Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = texts_of(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(len(column) + 1, np.int64), data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left = np.ones(n, bool)
    left[1:] = ~inside[:-1]
    right = np.ones(n, bool)
    right[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (left | edge[:-1]))
    end = np.flatnonzero(inside & (right | edge[1:])) + 1
    if lower:
        data = _LOWER[data]
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(word_hashes(data, start, end), doc, start, end, np.searchsorted(start, offsets), data)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of hashes[i : i + k], for each i where it is whole."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(INVERSE, n)[: n - k + 1] + np.uint64(k))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes; fewer words are one shingle, none are none."""
    all_runs, first = runs(words.hash, k), words.first.tolist()
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(all_runs[a : b - k + 1]))
        else:
            out.append(runs(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of hashes[begin : end], for each pair."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=sums[1:])
    return mixed((sums[end] - sums[begin]) * powers(INVERSE, max(1, len(hashes)))[np.minimum(begin, max(0, len(hashes) - 1))] + (end - begin).astype(np.uint64))
