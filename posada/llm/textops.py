"""Vectorised helpers on Arrow text columns, shared by the operators of this package.

Texts are handled as one UTF-8 byte buffer with offsets, in pieces of about ``PIECE`` bytes, so that the
working memory of a task does not depend on the size of its partition. Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask with the byte ranges (both ends included) set."""
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


#: Everything but blank and 09-0D.
NON_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters and every byte of a character beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that combined hashes spread over all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U64(_MULT))
_BASE = 0x5851F42D4C957F2D
#: Bytes that are hashed in one go; longer spans are hashed by themselves.
STRIDE = 1 << 20
with np.errstate(over="ignore"):
    _UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STRIDE, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def release(collect: bool = False) -> None:
    """Gives memory that this process no longer uses back to the system; otherwise it stays with a worker from one task to the next. The driver also collects its references to Spark's plans."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with the C library of GNU
        ctypes.CDLL(None).malloc_trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0 and have one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose text column holds about ``size`` bytes; a longer text is a slice of its own. At the end unused memory is released."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of word bytes; runs never cross rows."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the buffer, the same wherever the span lies. Spans are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + STRIDE, side="right")))
            end = int(ends[to - 1])
            if end - base > STRIDE:
                out[at] = _long_hash(data[base:end])
            else:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODE[data[base:end]] * _UP[: end - base])])
                a, b = starts[at:to] - base, ends[at:to] - base
                out[at:to] = (sums[b] - sums[a]) * _DOWN[a]
            at = to
        return mix(out + (ends - starts).astype(np.uint64) * U64(_MULT))


def _long_hash(data: np.ndarray) -> np.uint64:
    """The sum of the codes of a span's bytes times the powers of their places, in steps."""
    total, scale = U64(0), U64(1)
    for at in range(0, len(data), STRIDE):
        part = data[at : at + STRIDE]
        total = total + scale * np.sum(_BYTE_CODE[part] * _UP[: len(part)], dtype=np.uint64)
        scale = scale * _UP[STRIDE]
    return total


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of a row; a row of fewer words gives one run of all its words."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        full = np.zeros(0, np.int64)
        codes = np.zeros(0, np.uint64)
        if n >= k:
            codes = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                codes = codes * U64(0x100000001B3) + hashes[j : n - k + 1 + j] * U64(2 * j + 0x9E3779B1)
            ok = rows[: n - k + 1] == rows[k - 1 :]
            full, codes = np.flatnonzero(ok), codes[ok]
        counts = np.bincount(rows, minlength=n_rows)
        first = np.concatenate([[0], np.cumsum(counts)])
        short = np.flatnonzero((counts > 0) & (counts < k))
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            on = counts[short] > j
            extra[on] = extra[on] * U64(0x100000001B3) + hashes[first[short[on]] + j] * U64(2 * j + 0x9E3779B1)
        extra = extra + counts[short].astype(np.uint64) * U64(_MULT)
        return mix(np.concatenate([codes, extra])), np.concatenate([rows[full], short])


def by_row_and_value(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order by row, then by value."""
    order = np.argsort(values)
    small = rows[order]
    if len(small) and small.max() < 1 << 16:
        small = small.astype(np.uint16)  # sorted by radix
    return order[np.argsort(small, kind="stable")]


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order, as (values, offsets)."""
    order = by_row_and_value(values, rows)
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=n_rows))])


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
