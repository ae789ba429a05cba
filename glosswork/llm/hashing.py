"""64-bit hashes of words and word sequences, a few array operations for each block of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)  # A-Z as a-z
#: Bytes that are worked on at once, and places in a word whose values are looked up.
SLICE, NEAR = 1 << 21, 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of the input over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _value(lowered: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random-looking number for a byte at a place in its word; a word's hash is the sum of these."""
    return mix(lowered * np.uint64(0x9E3779B97F4A7C15) + (place + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


_NEAR = _value(np.repeat(_LOWER, NEAR), np.tile(np.arange(NEAR, dtype=np.uint64), 256))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array and the offsets of its texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(first, last) runs of whole texts of about ``most`` bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of these texts, A-Z lower-cased, and each text's number of words.

    Bytes are taken in slices that end at white space, so that what is held besides the result is bounded.
    """
    parts, a, last = [], int(offsets[0]), int(offsets[-1])
    while a < last:
        b = min(last, a + SLICE)
        while b < last and not _WHITE[data[b]]:
            ahead = np.flatnonzero(_WHITE[data[b : min(last, b + 4096)]])
            b = min(last, b + (int(ahead[0]) if len(ahead) else 4096))
        parts.append(_slice(data[a:b], offsets[(offsets > a) & (offsets < b)] - a, a))
        a = b
    h, s, e = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return h, s, e, np.diff(np.searchsorted(s, offsets)).astype(np.int64)


def _slice(data: np.ndarray, cuts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    white = _WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    begins, ends = ~white, ~white
    begins[1:] &= white[:-1] | edge[1:-1]
    ends[:-1] &= white[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(s):
        return np.empty(0, np.uint64), s, e
    size = e - s
    flat = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(flat, size)
    letters = data[~white]
    value = _NEAR[letters.astype(np.int64) * NEAR + np.minimum(place, NEAR - 1)]
    far = np.flatnonzero(place >= NEAR)
    if len(far):
        value[far] = _value(_LOWER[letters[far]], place[far].astype(np.uint64))
    return mix(np.add.reduceat(value, flat) + size.astype(np.uint64)), s + first, e + first


def sequences(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside a text, and each text's number of runs. A shorter text has none."""
    runs = np.maximum(counts - k + 1, 0)
    if len(h) < k:
        return np.empty(0, np.uint64), runs
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += h[i : i + len(out)]
    ends = np.cumsum(counts)
    keep = np.zeros(len(h) + 1, np.int64)
    np.add.at(keep, ends - counts, (runs > 0).astype(np.int64))
    np.add.at(keep, ends - counts + runs, -(runs > 0).astype(np.int64))
    return mix(out[np.cumsum(keep)[: len(out)] > 0]), runs
