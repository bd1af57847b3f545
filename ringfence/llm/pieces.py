"""Pre-tokenisation and piece caching shared by the two BPE operators.

Both vocabularies first cut a text into pieces (a word with its leading
space, a run of signs, ...) and encode each piece alone. The cut is done on
UTF-8 bytes for texts of ASCII and the Latin letters U+00C0-U+017F; other
texts, and those that spell out a special token, take the caller's general
path. Pieces are encoded once and then found by a 64-bit hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd

from . import text_arrays as ta

LETTER, DIGIT, SPACE, SIGN = 0, 1, 2, 3
_KIND = np.full(256, SIGN, dtype=np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER
_KIND[0x80:] = LETTER  # plain() admits letters only
# The endings that both vocabularies cut off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE_PIECES = 1_000_000


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for documents whose characters are ASCII or U+00C0-U+017F letters (but not U+0130)."""
    odd = (data >= 0xC6) | (data == 0xC2)
    lead = np.flatnonzero((data == 0xC3) | (data == 0xC4))
    second = data[np.minimum(lead + 1, max(len(data) - 1, 0))]
    odd[lead[((data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((data[lead] == 0xC4) & (second == 0xB0))]] = True
    return np.diff(np.append(0, np.cumsum(odd))[offsets]) == 0


def cut(data: np.ndarray, offsets: np.ndarray, spaced: bool):
    """(starts, ends, pieces before each document).

    ``spaced``: a piece takes one leading space and a run of digits, other
    white space makes pieces too. Otherwise white space is dropped and every
    digit is a piece."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    if not spaced:
        edge[:n] |= kind == DIGIT
    doc_edge = np.zeros(n + 1, dtype=bool)
    doc_edge[offsets] = True
    edge |= doc_edge
    edge[0] = True
    if spaced:  # the last white space before other text stands alone, or leads it if a space
        last = np.flatnonzero((kind == SPACE) & np.append(kind[1:] != SPACE, False) & ~doc_edge[1:])
        edge[last] = True
        edge[last[data[last] == 0x20] + 1] = False
    # an apostrophe that starts a piece takes one of the endings with it
    at = np.flatnonzero((data == 0x27) & edge[:n])
    for ending in _ENDINGS:
        letters = np.frombuffer(ending.encode(), np.uint8)
        k = len(letters)
        hit = at[at + k < n]
        for j, c in enumerate(letters, 1):
            hit = hit[data[hit + j] == c]
            hit = hit[~doc_edge[hit + j]]
        edge[hit + 1] = False
        edge[hit + 1 + k] = True
    starts = np.flatnonzero(edge[:n])
    ends = np.append(starts[1:], n)
    if not spaced:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets, side="left")


class PieceCache:
    """Ids of pieces by hash; at most ``CACHE_PIECES`` plus one chunk's.

    ``encode(data, starts, ends)`` gives the ids of pieces (flat) and their counts."""

    def __init__(self, encode: Callable):
        self.encode = encode
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)   # ascending
        self.place = np.zeros(0, np.int64)   # of each key, in ``edge``
        self.flat = np.zeros(0, np.int32)
        self.edge = np.zeros(1, np.int64)

    def ids(self, data, starts, ends, before):
        """(ids of all pieces in order, ids before each document)."""
        if len(self.keys) > CACHE_PIECES:
            self._clear()
        back, h = pd.factorize(ta.span_hash(data, starts, ends))
        order = np.argsort(h)
        at = np.searchsorted(self.keys, h[order])
        known = np.zeros(len(h), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == h[order[at < len(self.keys)]]
        place = np.empty(len(h), np.int64)
        place[order[known]] = self.place[at[known]]
        new = order[~known]
        if len(new):
            first = np.zeros(len(h), np.int64)
            first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
            flat, size = self.encode(data, starts[first[new]], ends[first[new]])
            place[new] = len(self.edge) - 1 + np.arange(len(new))
            self.keys = np.insert(self.keys, at[~known], h[new])
            self.place = np.insert(self.place, at[~known], place[new])
            self.flat = np.concatenate([self.flat, flat])
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(size)])
        place = place[back]
        size = self.edge[place + 1] - self.edge[place]
        lead = np.append(0, np.cumsum(size))
        out = self.flat[np.arange(lead[-1]) + np.repeat(self.edge[place] - lead[:-1], size)]
        return out, lead[before]


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class RankArray:
    """BPE of pieces by the contiguous rank array.

    Pieces of one length up to ``SHORT`` are encoded together: each row holds
    its part boundaries and the merge ranks of adjacent parts, contiguously.
    A step scans the ranks for the smallest (the leftmost of equals), deletes
    that boundary and refreshes the two neighbouring ranks; rows without a
    rank left are done. Longer pieces use a heap, as repeated scans would be
    quadratic in them."""

    SHORT = 48
    ROWS = 1 << 15
    NO_RANK = np.int64(1 << 40)

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + mark] for c in symbols], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = dict(zip(keys.tolist(), range(len(pairs))))
        self.by_key = np.argsort(keys)
        self.keys = np.append(keys[self.by_key], np.iinfo(np.int64).max)
        symbols = np.append(self.inner, self.final)
        self.first = self._ranks(self.inner[:, None], symbols[None, :])  # of two adjacent bytes

    def _ranks(self, left, right):
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        out = np.full(key.shape, self.NO_RANK)
        out[found] = self.by_key[at[found]]
        return out

    def encode(self, data, starts, ends):
        size = ends - starts
        count, parts = np.zeros(len(size), np.int64), []
        for n in np.unique(size):
            of = np.flatnonzero(size == n)
            for lo in range(0, len(of), self.ROWS):
                rows = of[lo:lo + self.ROWS]
                if n <= self.SHORT:
                    got = self._scan(data[starts[rows][:, None] + np.arange(n)])
                else:
                    got = [(k, np.array([self._heap(data[starts[r]:ends[r]])])) for k, r in enumerate(rows)]
                for k, ids in got:
                    count[rows[k]] = ids.shape[1]
                    parts.append((rows[k], ids))
        edge = np.append(0, np.cumsum(count))
        flat = np.zeros(edge[-1], np.int32)
        for rows, ids in parts:
            flat[edge[np.atleast_1d(rows)][:, None] + np.arange(ids.shape[1])] = ids
        return flat, count

    def _scan(self, symbols):
        """Yields (row numbers, ids) of rows that end with the same number of parts."""
        ids = self.inner[symbols]
        ids[:, -1] = self.final[symbols[:, -1]]
        row = np.arange(len(ids))
        bounds = np.tile(np.arange(ids.shape[1]), (len(ids), 1))
        right = symbols[:, 1:].astype(np.int64)
        right[:, -1:] += 256
        ranks = self.first[symbols[:, :-1], right]
        while len(row):
            low = ranks.min(axis=1) if ranks.shape[1] else np.full(len(row), self.NO_RANK)
            done = low == self.NO_RANK
            if done.any():
                yield row[done], np.take_along_axis(ids[done], bounds[done], 1)
                row, ids, bounds, ranks, low = (x[~done] for x in (row, ids, bounds, ranks, low))
            if not len(row):
                return
            every, n = np.arange(len(row)), ranks.shape[1]
            i = ranks.argmin(axis=1)
            ids[every, bounds[every, i]] = self.merged[low]
            keep = np.ones(bounds.shape, bool)
            keep[every, i + 1] = False
            bounds = bounds[keep].reshape(len(row), n)
            keep = np.ones(ranks.shape, bool)
            keep[every, i] = False
            ranks = ranks[keep].reshape(len(row), n - 1)
            for at, ok in ((i - 1, i > 0), (i, i < n - 1)):
                r, k = every[ok], at[ok]
                ranks[r, k] = self._ranks(ids[r, bounds[r, k]], ids[r, bounds[r, k + 1]])

    def _heap(self, symbols) -> list[int]:
        ids = self.inner[symbols].tolist()
        ids[-1] = int(self.final[symbols[-1]])
        n, rank = len(ids), self.rank.get
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for left in (ahead[i], i):
                if left >= 0 and after[left] < n:
                    right = after[left]
                    if (r := rank(ids[left] << 20 | ids[right])) is not None:
                        heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]
