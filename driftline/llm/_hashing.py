"""Vectorised 64-bit hashes of words, word n-grams and byte strings, for whole groups of texts at once.

A word hashes to the sum of random values of its bytes and their places in it, read off cumulative sums, then mixed:
no structure of its bytes makes two words alike. A word n-gram hashes to a polynomial of its words' hashes, a string of bytes (for
search only) to a polynomial of random byte values modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_R = 0x5851F42D4C957F2D  # odd, 5 modulo 8: powers differ as much as they can
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_power: list[np.ndarray] = []
_values: list[np.ndarray] = []


#: Words that are hashed at once.
PLACED_WORDS = 1 << 17
#: Places in a word whose values a worker keeps.
PLACES = 64
#: Powers that a worker keeps; longer texts make their own.
KEPT_POWERS = 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i below n (at least)."""
    if n <= KEPT_POWERS and _power:
        return _power[0], _power[1]
    made = []
    for r in (_R, pow(_R, -1, 1 << 64)):
        p = np.full(max(n, KEPT_POWERS), r, dtype=np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if n <= KEPT_POWERS:
        _power[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c with the hash of data[a:b] being (c[b] - c[a]) * R**-a."""
    c = np.zeros(len(data) + 1, dtype=np.uint64)
    values = _BYTE[data]
    values *= powers(len(data))[0][: len(data)]
    np.cumsum(values, out=c[1:])
    return c


def groups(rows: Iterable[tuple], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Cut rows (.., text bytes) into groups of about ``limit`` bytes; a longer text is a group of its own."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[-1]) > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield held


def _placed() -> np.ndarray:
    """Random values of all bytes in the first ``PLACES`` places of a word; spaces, which are not summed, may go beyond."""
    if not _values:
        _values.append(mix(np.arange(PLACES << 8, dtype=np.uint64) + _M))
    return _values[0]


class Words:
    """The words of a group of texts: maximal runs of bytes other than 0x20 and 0x09 to 0x0D.

    first[d] is the index of the first word of text d; first[-1] is the number of words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        if lower:
            data = LOWER[data]
        space = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.data, self.starts, self.ends = data, edges[::2], edges[1::2]
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.offsets = np.concatenate([[1], 1 + np.cumsum(sizes)])  # of the texts
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        lengths = self.ends - self.starts
        total = np.zeros(len(lengths), dtype=np.uint64)
        for a in range(0, len(lengths), PLACED_WORDS):
            some = slice(a, a + PLACED_WORDS)
            own, first, last = lengths[some], int(self.starts[a]), int(self.ends[some][-1])
            start = self.starts[some] - first
            place = np.arange(last - first)
            place -= np.repeat(start, np.diff(start, append=last - first))  # spaces go on from the word before and are not summed
            longest = int(own.max())
            place <<= 8
            place += self.data[first:last]
            value = _placed().take(place, mode="clip") if longest <= PLACES else mix(place.astype(np.uint64) + _M)
            c = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(value, out=c[1:])
            total[some] = c[start + own] - c[start]
        return mix(total + lengths.astype(np.uint64) * _M)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on, as far as there are k."""
    n = max(0, len(words) - k + 1)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _M
        h += words[j : j + n]
    return mix(h)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
