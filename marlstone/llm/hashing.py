"""Vectorised word and shingle hashing over UTF-8 text.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Words are
hashed with a polynomial over a random byte table modulo 2**64 and then mixed,
so equal words hash equally wherever they stand.  All loops run over blocks of
documents, never over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64((seed * 0xD1342543DE82EF95 + 1) % 2**64))


_BYTES = stream(11, 256) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = BLOCK
    while size < n:
        size *= 2
    if size not in _powers:
        up = np.full(size, _BASE, dtype=U64)
        up[0] = 1
        down = np.full(size, pow(_BASE, -1, 2**64), dtype=U64)
        down[0] = 1
        if size > BLOCK:
            _powers.pop(next((k for k in _powers if k > BLOCK), 0), None)
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of a byte array: equal bytes, equal hashes."""
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def _hash_block(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one block."""
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=U64), starts
    return span_hashes(_LOWER[raw] if lower else raw, starts, ends), starts


def word_blocks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks that end where words do; a block exceeds BLOCK by at most one word."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not _SPACE[raw[end]]:
            more = np.flatnonzero(_SPACE[raw[end : end + BLOCK]])
            end = end + int(more[0]) if len(more) else min(len(raw), end + BLOCK)
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte array, and where each starts; in blocks, so memory stays bounded by the longest word."""
    if len(raw) <= 2 * BLOCK:
        return _hash_block(raw, lower)
    hashes, starts = [], []
    for at, end in word_blocks(raw):
        h, s = _hash_block(raw[at:end], lower)
        hashes.append(h)
        starts.append(s + at)
    return np.concatenate(hashes), np.concatenate(starts)


def text_blocks(column, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into bytes) of runs of rows of an Arrow string column.

    Runs hold about ``limit`` bytes, or one longer row.  Nulls are empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def rows_of_words(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each row, and the number of words at the end."""
    return np.searchsorted(starts, offsets)


def separated(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A run of rows with a space after each."""
    n = len(offsets) - 1
    if n < 2:
        return raw, offsets
    out = np.full(len(raw) + n, 32, dtype=np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = raw
    return out, offsets + np.arange(n + 1)


def split_rows(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a run of rows and each row's bounds among them.

    A separator is put between rows so that words never run across two of them.
    """
    raw, offsets = separated(raw, offsets)
    h, s = word_hashes(raw, lower)
    return h, rows_of_words(s, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; rows with fewer words give one shingle of them all, rows without words none."""
    n = len(bounds) - 1
    odd = stream(23, width) | U64(1)
    with np.errstate(over="ignore"):
        if len(words) >= width:
            m = len(words) - width + 1
            acc = words[:m] * odd[0]
            for j in range(1, width):
                acc = mix(acc) + words[j : j + m] * odd[j]
            acc = mix(acc)
        else:
            acc = words[:0]
        out = []
        for k in range(n):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= width:
                out.append(np.unique(acc[a : b - width + 1]))
            elif b > a:
                h = U64(b - a)
                for j in range(a, b):
                    h = mix((h * U64(_BASE) + words[j])[None])[0]
                out.append(np.array([h], dtype=U64))
            else:
                out.append(words[:0])
    return out


def document_sets(column, width: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """Shingle set of each row of an Arrow string column."""
    for _, _, raw, offsets in text_blocks(column):
        yield from shingle_sets(*split_rows(raw, offsets, lower), width)
