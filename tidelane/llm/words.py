"""Vectorised word and shingle hashing over Arrow batches; no per-word Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice of a batch holds, unless one text alone is longer.
SLICE_BYTES = 1 << 20
#: The same where texts become shingles, whose arrays take some 60 times as much.
SHINGLED_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

#: Space and 0x09 to 0x0D part words; A to Z are lower-cased.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters alone: what is no ASCII letter, apostrophe or byte of a longer code point parts them.
NO_LETTER = np.ones(256, bool)
NO_LETTER[97:123] = NO_LETTER[65:91] = NO_LETTER[128:] = False
NO_LETTER[39] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column; null is empty."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its length in bytes, bounds): words bounds[i] to bounds[i + 1] belong to text i."""
    low = LOWER[data]
    word = ~parts[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    where = np.flatnonzero(word)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    head = np.flatnonzero(first[where])
    length = np.diff(np.append(head, len(where)))
    power = np.multiply.accumulate(np.full(int(length.max()), _STEP | np.uint64(1), np.uint64))
    place = np.arange(len(where)) - np.repeat(head, length)
    h = np.add.reduceat(_BYTE[low[where]] * power[place], head)
    return mix(h + length.astype(np.uint64) * _STEP), length, np.searchsorted(where[head], offsets)


def stems(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """([word hashes, hashes of each word's first `size` bytes for each size], bounds); 0 where a word is no longer than that."""
    low = LOWER[data]
    h, length, bounds = words(data, offsets, parts)
    if not len(h):
        return [h] * (1 + len(sizes)), bounds
    where = np.flatnonzero(~parts[low])
    head = where[np.append(0, np.cumsum(length)[:-1])]
    out = [h]
    power = np.multiply.accumulate(np.full(max(sizes), _STEP | np.uint64(1), np.uint64))
    for size in sizes:
        at = np.minimum(head[:, None] + np.arange(size), len(low) - 1)
        x = mix((_BYTE[low[at]] * power[:size]).sum(axis=1, dtype=np.uint64) + np.uint64(size * int(_LEFT) % 2**64))
        out.append(np.where(length > size, x, np.uint64(0)))
    return out, bounds


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text's words; fewer words make one shingle, none make none."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))), np.uint64)
    for j in range(min(k, len(h))):
        out = mix(out * _LEFT + h[j : j + n] * _RIGHT)
    return np.unique(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each row of a string column, in order."""
    for _, _, data, offsets in slices(column, SHINGLED_BYTES):
        h, _, bounds = words(data, offsets)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield shingles(h[a:b], k)
