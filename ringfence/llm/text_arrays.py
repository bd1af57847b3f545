"""Vectorised word work on Arrow string buffers (used inside Arrow tasks).

Words are the maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``.
UTF-8 never uses those bytes inside a longer character, so splitting bytes
equals splitting code points. All helpers take whole texts; memory follows
the bytes of one chunk, and a chunk holds at least one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BLOCK_WORDS = 1 << 14
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = stream(256, 1)
_PLACE = stream(1 << 12, 2)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = stream(1 << int(n - 1).bit_length(), 2)
    return _PLACE


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data bytes, n+1 offsets into them); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with at most ``limit`` text bytes each (or one row)."""
    pool = pa.default_memory_pool()
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield batch.slice(lo, hi - lo)
            lo = hi
        pool.release_unused()  # idle workers share an executor's memory


def spans_where(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``mask`` that do not cross ``offsets``:
    (starts, ends, number of runs before each offset)."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | cut[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def words(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, words before each document) of all words."""
    return spans_where(~_SPACE[data], offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit multilinear hash of the bytes of each span (A-Z folded if ``lower``)."""
    out = np.empty(len(starts), dtype=_U)
    with np.errstate(over="ignore"):
        for lo in range(0, len(starts), _BLOCK_WORDS):
            s, e = starts[lo:lo + _BLOCK_WORDS], ends[lo:lo + _BLOCK_WORDS]
            size = e - s
            at = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            byte = data[place + np.repeat(s, size)]
            if lower:
                byte = _LOWER[byte]
            part = _BYTE[byte] * _places(int(size.max()))[place]
            out[lo:lo + _BLOCK_WORDS] = _mix(np.add.reduceat(part, at) + size.astype(_U))
    return out


_ROLL = stream(64, 3) | _U(1)


def gram_hash(h: np.ndarray, before: np.ndarray, k: int, seed: int = 0):
    """Hash of every run of ``k`` words inside one document.

    ``before``: words before each document (n_docs + 1). Returns (hashes,
    document index of each, index of its first word)."""
    count = np.diff(before)
    per = np.maximum(count - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), per)
    first = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + before[:-1][doc]
    acc = np.zeros(len(first), dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc += h[first + j] * _ROLL[(j + seed) % 64]
    return _mix(acc + _U(seed)), doc, first


def join_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> pa.Array:
    """One string per document: its spans joined by one space."""
    size = ends - starts
    last = np.zeros(len(starts), dtype=bool)
    last[before[1:][np.diff(before) > 0] - 1] = True
    wide = size + ~last
    at = np.cumsum(wide) - wide
    out = np.full(int(wide.sum()), 0x20, dtype=np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[place + np.repeat(at, size)] = data[place + np.repeat(starts, size)]
    edge = np.append(at, len(out))[before].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(before) - 1,
                                 [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def cut_spans(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One string per document: its bytes without the (disjoint) spans."""
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    left = np.cumsum(step[:-1], dtype=np.int8) == 0
    edge = np.append(0, np.cumsum(left))[offsets].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(data[left].tobytes())]).cast(pa.string())
