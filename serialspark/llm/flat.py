"""The words of a batch of texts as numpy arrays, without a Python object for each word.

A batch's UTF-8 bytes lie one text after the other, as Arrow holds them; a word is a run of bytes of a given kind
that stays inside its text, told by where it begins and ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2_000_000
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LONG = 64  # bytes of a word from which it is summed on its own


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # the place of each text's first word, and the number of words at last


def texts_of(column: pa.Array, most: int = BATCH_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, where each row's begin) of runs of rows with at most so many bytes, one row at least. A null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1), lo + rows, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Words of lower-cased bytes; is_word: for each byte value (after lower-casing) whether words hold it."""
    low = LOWER[data]
    inside = is_word[low]
    begins, ends = np.ones(len(low) + 1, bool), np.ones(len(low) + 1, bool)
    np.logical_not(inside[:-1], out=begins[1:-1])
    np.logical_not(inside[1:], out=ends[:-2])
    begins[offsets[:-1]] = True
    ends[offsets[1:] - 1] = True  # of an empty text at the very start this is the last element, which is not looked at
    start, end = np.flatnonzero(begins[:-1] & inside), np.flatnonzero(ends[: len(low)] & inside) + 1
    return Words(low, start, end, np.searchsorted(start, offsets))


def joined(words: Words) -> Words:
    """The same words with one space between neighbours and none other, so that runs of words are runs of bytes."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    places = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start, size) + places] = words.data[np.repeat(words.start, size) + places]
    return Words(out, start, end, words.first)


#: The table by bytes: the sum is linear, so what all single bytes have in common falls out.
CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes: of all the runs' first bytes, then of all second ones, and so on."""
    size = end - start
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int16), kind="stable")
    at, sizes = start[order], size[order]
    n_long = int(np.searchsorted(-sizes, -LONG))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    longest = int(sizes[n_long]) if n_long < len(order) else 0
    rest = np.searchsorted(-sizes[n_long:], -np.arange(longest) - 1, "right")
    for j, n in enumerate(rest.tolist()):
        now = crc[n_long : n_long + n]
        crc[n_long : n_long + n] = CRC[(now ^ data[at[n_long : n_long + n] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc = ~crc
    for i in range(n_long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


_RANDOM = np.random.default_rng(42)
_BYTE = _RANDOM.integers(1, 1 << 64, 256, np.uint64)
_FACTOR = int(_RANDOM.integers(1, 1 << 63)) * 2 + 1
_powers: dict[int, np.ndarray] = {}


def _power(factor: int, n: int) -> np.ndarray:
    """1, factor, its square and so on, modulo 2 ** 64, n at least."""
    if factor not in _powers or len(_powers[factor]) < n:
        x = np.full(max(n, 1 << 19), factor, np.uint64)
        x[0] = 1
        _powers[factor] = np.multiply.accumulate(x)
    return _powers[factor]


def hashes_of(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, alike on all machines: a polynomial of random values of its bytes, from running sums; mixed at last."""
    n = len(words.data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[words.data] * _power(_FACTOR, n)[:n], out=sums[1:])
    h = (sums[words.end] - sums[words.start]) * _power(pow(_FACTOR, -1, 1 << 64), n + 1)[words.start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)
