"""Words of many texts at once as ranges of one byte buffer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
# A polynomial modulo 2**64 tells words apart up to about a thousand bytes only; longer words than this get XXH64.
_LONG_WORD = 64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table: True for bytes inside one of the ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Bytes that separate words.
SPACE_BYTES = byte_class((0x09, 0x0D), (0x20, 0x20))
NOT_ALNUM_BYTES = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary()).fill_null(b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(array) + 1, offset=8 * array.offset)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and per text the number of its first word (one more at the end)."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _power_table(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1); tables are kept in steps of doubled size."""
    return _power_table(base, 1 << max(16, (n - 1).bit_length() if n else 0))[:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes over 2**64, scrambled, by prefix sums; XXH64 of long words."""
    codes = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed * int(_ODD) & _ALL))
    base = int(mixed(np.array([seed + 1], dtype=np.uint64))[0]) | 1
    inverse = pow(base, -1, 2**64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * _powers(base, len(data)), dtype=np.uint64, out=sums[1:])
    back = _powers(inverse, len(data) + 1)
    out = mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _ODD)
    for n in np.flatnonzero(end - start > _LONG_WORD).tolist():
        out[n] = xxhash.xxh64_intdigest(data[start[n] : end[n]], seed)
    return out


def window_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hash of each run of `n` consecutive values of `words` (len(words) - n + 1 of them)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    base = int(mixed(np.array([seed + 77], dtype=np.uint64))[0]) | 1
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers(base, len(words)), dtype=np.uint64, out=sums[1:])
    back = _powers(pow(base, -1, 2**64), len(words) - n + 1)
    return mixed((sums[n:] - sums[:-n]) * back)


def slices(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text; a longer text is a range of its own or ends one."""
    lengths = np.cumsum(np.diff(text_bytes(texts)[1]))
    cuts = (np.flatnonzero(np.diff(lengths // limit)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(texts)], strict=True))


def token_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like word_spans, for maximal runs of bytes of one class; class 0 separates."""
    kind = classes[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    return start, end, np.searchsorted(start, offsets)
