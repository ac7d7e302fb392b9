"""Hashes of the words of Arrow string columns, computed with numpy over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WINDOW = 1 << 20
_byte_value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_power = np.cumprod(np.full(WINDOW, BASE, dtype=U64))
_inverse = np.cumprod(np.full(WINDOW, pow(BASE, -1, 1 << 64), dtype=U64))

#: Bytes that belong to words: all but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[128:] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def bytes_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[at[0] : at[-1]], at - at[0]) if len(at) else (whole[:0], np.zeros(1, np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, counts``: the hash of each word in order, and the number of words of each row.

    A word is a longest run of bytes of the class ``inside``; rows end words. Memory besides the result
    is bounded by the window, so it does not depend on a row's length; a word longer than a window is
    hashed in parts.
    """
    hashes, first = [], []
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[at] = True
    lo = 0
    while lo < len(data):
        hi = min(lo + WINDOW, len(data))
        if hi < len(data):  # not in the middle of a word
            gaps = np.flatnonzero(~inside[data[max(lo + 1, hi - 65536) : hi]])
            hi = max(lo + 1, hi - 65536) + int(gaps[-1]) + 1 if len(gaps) else hi
        part = data[lo:hi]
        word = inside[part]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edges[lo + 1 : hi]
        ends[:-1] &= ~word[1:] | edges[lo + 1 : hi]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(_byte_value[part] * _power[: len(part)])])
        hashes.append(mix((sums[e + 1] - sums[b]) * _inverse[b]))
        first.append(b + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(at) - 1, np.int64)
    starts = np.concatenate(first)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, at))


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, rows``: each run of ``size`` words within a row; a shorter row with words has one of all its words."""
    n = len(words)
    row = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    short = np.repeat(np.minimum(counts, size), counts)
    place = np.arange(n)
    full = place + short <= end
    full &= (short == size) | (place == end - short)
    total = np.zeros(n, dtype=U64)
    for k in range(size):
        part = words[np.minimum(place + k, max(n - 1, 0))] * U64(2 * k + 1) + U64(k) if n else words
        total = mix(total + np.where(k < short, part, U64(0)))
    return total[full], row[full]


def slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """``first, count`` of runs of rows with at most ``most_bytes`` bytes together; a longer row is alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most_bytes:
            yield first, i - first
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes) - first
