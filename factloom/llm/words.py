"""Vectorised words and word n-grams of a whole Arrow batch, as 64-bit hashes.

Hashes stand for the words and n-grams themselves. Within the few million different n-grams that are ever compared
with each other (one document, or two), two of them agree by chance with a probability below 1e-6.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Of ASCII, all but letters and digits.
MARKS = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Bytes that are hashed at once; a longer word is hashed alone.
_WINDOW = 1 << 18


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below n."""
    if n <= len(_powers[0]):
        return _powers
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
_powers = _power(_WINDOW + 1)


@dataclass
class Words:
    """hashes, starts and ends (in buf) of all words; the words of text i are first[i]:first[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray
    codes: np.ndarray  # what each byte counts as


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    kind, data = column.buffers()[1:]
    at = np.frombuffer(kind, np.int64, len(column) + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(column: pa.Array, fold: bool = False, apart: np.ndarray = SPACE) -> Words:
    """fold: A-Z count as a-z. apart: the bytes between words."""
    buf, at = utf8(column)
    n = len(buf)
    codes = _FOLDED if fold else _CODES
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64), buf, at, codes)
    solid = ~apart[buf]
    edge = np.zeros(n + 1, bool)  # a text begins here, or all texts end
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    del solid, edge, before, after
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # windows of whole words, so that only a word longer than a window needs more than a window's memory
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _WINDOW, side="right")))
        size = int(ends[j - 1] - lo)
        power, inverse = _power(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[buf[lo : lo + size]] * power[:size], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        hashes[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * _PLACES[63])
        i = j
    return Words(hashes, starts, ends, np.searchsorted(starts, at), buf, at, codes)


def leads(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first k bytes of the words that are longer, and the places of these words among all."""
    at = np.flatnonzero(w.ends - w.starts > k)
    begin = w.starts[at]
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total += w.codes[w.buf[begin + i]] * _powers[0][i]
    return mix(total + _PLACES[k]), at


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of one text's word hashes; with fewer words than n, the whole sequence as one; without words, none."""
    m = len(hashes)
    if m == 0:
        return hashes
    k = min(n, m)
    out = np.zeros(m - k + 1, np.uint64)
    for j in range(k):
        out += hashes[j : m - k + 1 + j] * _PLACES[j]
    return mix(out + np.uint64((n - k) * int(_PLACES[62]) % (1 << 64)))


def all_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """grams() of all texts at once: the hashes, and where each text's begin."""
    m, count = len(w.hashes), np.diff(w.first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    if m < n:
        parts = [grams(w.hashes[a:b], n) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), begin
    full = np.zeros(m - n + 1, np.uint64)
    for j in range(n):
        full += w.hashes[j : m - n + 1 + j] * _PLACES[j]
    full = mix(full)
    out = np.empty(begin[-1], np.uint64)
    long = count >= n
    place = np.repeat(w.first[:-1][long] - begin[:-1][long], size[long]) + (np.arange(begin[-1]) if long.all() else np.flatnonzero(np.repeat(long, size)))
    out[np.repeat(long, size)] = full[place]
    for i in np.flatnonzero((count > 0) & ~long):
        out[begin[i]] = grams(w.hashes[w.first[i] : w.first[i + 1]], n)[0]
    return out, begin
