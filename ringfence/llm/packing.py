"""Best-fit packing of tokenised documents into fixed-length sequences.

Bound-certified repacking: the items are dealt over parts of about
``PART_ITEMS``; each part packs its items best-fit decreasing and certifies
its number of bins with dual-feasible-function lower bounds. Parts whose
bins exceed their bound put the documents of their unfilled bins into a
common pool, parts that meet it only their emptiest bin; the pool is dealt
anew over parts and packed again. A repacked pool replaces the old bins only
if it needs fewer. This ends when the bins equal the lower bound of all
items, or when an exchange gains nothing.

A document longer than a sequence is cut into full sequences, its first
piece taking the remainder; full pieces need no packing.

Defined cases: a null or empty text is its end token alone; equal lengths are
taken in the order of the pieces' numbers; every row is a document, also if
ids repeat; a null id stays null; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache, partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from . import text_arrays as ta
from .staging import bounded_batches, drop_staged, staged

PART_ITEMS = 16_384
LEAST_GAIN = 0.001   # of the pool's bins; an exchange that gains less is the last


class ByteBpe:
    """Ids of a byte-level vocabulary file of the ``tokenizers`` format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.cache = pieces.PieceCache(pieces.RankArray(spec).encode)

    def encode_column(self, texts: pa.Array):
        """(ids of all texts, ids before each text)."""
        data, offsets = ta.buffers(texts)
        general = ~pieces.plain(data, offsets)
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                general[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        if general.any():
            import pyarrow.compute as pc

            data, offsets = ta.buffers(pc.if_else(pa.array(general), "", texts.fill_null("")))
        ids, before = self.cache.ids(data, *pieces.cut(data, offsets, spaced=True))
        if general.any():  # other scripts, special tokens: the library itself
            own = {int(i): np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
                   for i in np.flatnonzero(general)}
            parts = [own.get(i, ids[before[i]:before[i + 1]]) for i in range(len(general))]
            ids, before = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, before


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                           ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut_tokens(batches, path: str, size: int, end_id: int, with_ids: bool):
    codec = byte_bpe(path)
    for chunk in ta.chunks(batches):
        ids, before = codec.encode_column(chunk.column("text"))
        n = np.diff(before) + 1
        ids = np.insert(ids, before[1:], end_id).astype("<u4")  # the end token after each document
        count = -(-n // size)
        edge = np.append(0, np.cumsum(count))
        doc = np.repeat(np.arange(len(n)), count)
        piece = np.arange(edge[-1]) - edge[:-1][doc]
        start = np.maximum(0, n[doc] - (count[doc] - piece) * size)
        stop = n[doc] - (count[doc] - 1 - piece) * size
        lead = (np.cumsum(n) - n)[doc]
        cells = [ids[a:b].tobytes() for a, b in zip(lead + start, lead + stop)]
        columns = [chunk.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(stop - start),
                   pa.array([zlib.crc32(c) for c in cells], pa.int64())]
        if with_ids:
            columns.append(pa.array(cells, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, schema=_PIECE_SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else _PIECE_SCHEMA)


def token_pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]); ``ids``: little-endian unsigned 32-bit."""
    return (bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(partial(_cut_tokens, path=path, size=size, end_id=end_id, with_ids=with_ids),
                        _PIECE + (", ids binary" if with_ids else "")))


def lower_bound(lengths: np.ndarray, size: int, counts: np.ndarray | None = None) -> int:
    """Bins that any packing needs, by dual feasible functions. With
    ``counts``, ``lengths`` are distinct and occur so many times each."""
    w, n = np.unique(lengths, return_counts=True) if counts is None else (lengths, counts)
    if not len(w):
        return 0
    best = -(-int((w * n).sum()) // size)
    for k in np.unique(np.append(w[2 * w <= size], 0)):  # small items count nothing, those over size - k a whole bin
        big, middle, small = w > size - k, (2 * w > size) & (w <= size - k), (2 * w <= size) & (w >= k)
        room = int(n[middle].sum()) * size - int((w * n)[middle].sum())
        rest = int((w * n)[small].sum()) - room
        best = max(best, int(n[big].sum() + n[middle].sum()) + max(0, -(-rest // size)))
    for k in range(1, 33):  # x -> floor((k + 1) x) / k, but x itself if (k + 1) x is whole
        scaled = (k + 1) * w
        value = np.where(scaled % size == 0, w * k, (scaled // size) * size)
        best = max(best, -(-int((value * n).sum()) // (size * k)))
    return best


def best_fit(lengths: np.ndarray, size: int):
    """(bin, offset) of each item; ``lengths`` descending."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0                                                   # bit r: some bin has room r
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at, used = size, used, used + 1
        bins[i], offsets[i] = at, size - room
        if room > n:
            open_bins[room - n].append(at)
            rooms |= 1 << (room - n)
    return bins, offsets, used


_PACK_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                ("uid", pa.int64()), ("part", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()),
                ("emptiest", pa.bool_()), ("bins", pa.int64()), ("bound", pa.int64())]
_PACK = _PIECE + ", uid long, part long, bin long, offset long, fill long, emptiest boolean, bins long, bound long"


def _pack_parts(batches, size: int):
    """Rows come sorted by part, then length descending."""
    def pack(rows):
        table = pa.Table.from_batches(rows).combine_chunks()
        lengths = table["length"].to_numpy()
        bins, offset, used = best_fit(lengths, size)
        fill = np.bincount(bins, lengths, used).astype(np.int64)
        more = [bins, offset, fill[bins], bins == int(fill.argmin()), np.full(len(bins), used), np.full(len(bins), lower_bound(lengths, size))]
        table = pa.Table.from_arrays([*(c.combine_chunks() for c in table.columns), *map(pa.array, more)], schema=pa.schema(_PACK_FIELDS))
        yield from table.to_batches(max_chunksize=8192)

    held, now = [], None
    for batch in batches:
        part = batch.column("part").to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(0, int)
        for a, b in zip(edge[:-1], edge[1:]):
            if part[a] != now and held:
                yield from pack(held)
                held = []
            now = part[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from pack(held)


def _packed(items: DataFrame, parts: int, turn: int, size: int) -> DataFrame:
    columns = [n for n, _ in _PACK_FIELDS[:6]]
    part = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts).cast("long"))
    return (items.select(*columns, part.alias("part")).repartition("part")
            .sortWithinPartitions("part", F.desc("length"), "uid").mapInArrow(partial(_pack_parts, size=size), _PACK))


def pack(pieces_df: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32)."""
    table = staged(pieces_df.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full, items = table.filter(F.col("length") == size), table.filter(F.col("length") < size)
    lengths = items.groupBy("length").count().collect()  # at most one row for each length
    n_items = sum(r["count"] for r in lengths)
    goal = lower_bound(np.array([r["length"] for r in lengths], np.int64), size, np.array([r["count"] for r in lengths], np.int64))
    kept, pool, pool_bins, locked = [], items, None, 0
    last = None
    for turn in count():
        if not n_items:
            break
        now = staged(_packed(pool, max(1, -(-n_items // PART_ITEMS)), turn, size), f"packed-{turn}")
        bins = now.groupBy("part").agg(F.max("bins").alias("b")).agg(F.sum("b")).first()[0]
        if last is not None:
            if bins >= pool_bins:  # nothing gained: the former bins stay
                kept.append(last.filter("swap").withColumn("turn", F.lit(turn - 1)))
                drop_staged(now)
                last = None
                break
        if locked + bins <= goal or pool_bins is not None and pool_bins - bins < LEAST_GAIN * pool_bins:
            kept.append(now.withColumn("turn", F.lit(turn)))
            last = None
            break
        swap = F.when(F.col("bins") > F.col("bound"), F.col("fill") < size).otherwise(F.col("emptiest"))
        last = now.withColumn("swap", swap)
        kept.append(last.filter("not swap").withColumn("turn", F.lit(turn)))
        pool = last.filter("swap")
        pool_bins = pool.select("part", "bin").distinct().count()
        locked += bins - pool_bins
        n_items = pool.count()
    out = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset"))
    number = (F.shiftleft(F.col("turn").cast("long"), 50) + F.shiftleft("part", 20) + F.col("bin")).alias("sequence_id")
    for rows in kept:
        out = out.unionByName(rows.select("doc_id", "piece", "start", "length", "ids_crc32", number, "offset"))
    return out


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, path, size, end_id), size)
