"""Substring deduplication: repeated fixed-length token windows.

Rabin-Karp style hashes of every 13-word window are counted in Spark; a
window that also starts in a document with a smaller id is repeated, and
overlapping repeated windows merge into maximal intervals that are removed.

Three stages, none of which holds more than one flush, one hash bucket or
one part's repeated windows in memory:

1. ``_window_rows`` (map side): hashes all windows, drops repeats inside a
   flush (a window found in several of its documents leaves one entry, with
   the smallest id; the other documents' windows are known to be repeated
   there and then), and packs the rest as (hash bucket, hashes, ids). A
   window that a third of all documents share therefore costs one entry a
   flush, not one a document.
2. ``_repeated`` (by hash bucket): the smallest id of each hash; all larger
   ids get the hash back as a repeated one, packed by part (a fixed share of
   the documents, about ``BUCKET_BYTES`` of text).
3. ``_remove`` (by part): recomputes the windows of each document, marks the
   repeated ones and drops the words they cover.

A window is identified by a 64-bit hash and its bucket (bits of a second
hash): at 10 billion windows fewer than 1e-4 false matches are expected.

Defined cases: a null or empty text has no words; a text under 13 words has
no windows and stays whole; a null id counts as larger than every other id;
rows that repeat an id are one document to each other (they never remove
each other's words) and each gives a result row; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .staging import bounded_batches, staged

NO_ID = np.iinfo(np.int64).max  # stands for a null id: larger than any other
CHUNK_BYTES = 512 << 10         # text bytes whose words and windows are held as arrays at once
FLUSH_WINDOWS = 250_000
BUCKET_BYTES = 2 << 20          # text bytes for each hash bucket and each part of the documents
TASK_BYTES = 32 << 20           # text bytes for each shuffle partition
_SPREAD = 0x9E3779B1
_PACKED = pa.schema([("key", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary())])
_PACKED_TYPES = "key long, hashes binary, ids binary"


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((((ids ^ (ids >> 32)) & 0x7FFFFFFF) * _SPREAD) >> 20) % parts


def part_of(id_column, parts: int):
    """``_part`` as a Column."""
    low = id_column.bitwiseXOR(F.shiftright(id_column, 32)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    return F.pmod(F.shiftright(low * F.lit(_SPREAD).cast("long"), 20), F.lit(parts).cast("long"))


def _packed(key: np.ndarray, fp: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """One row for each key with its hashes and ids."""
    order = np.argsort(key, kind="stable")
    key, fp, doc = key[order], fp[order], doc[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    edge = np.append(at, len(key))
    cells = [[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])] for x in (fp, doc)]
    return pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], schema=_PACKED)


def _smallest(fp: np.ndarray, doc: np.ndarray):
    """Without repeats: (hashes, ids, is the smallest id of its hash)."""
    order = np.lexsort((doc, fp))
    doc, fp = doc[order], fp[order]
    new = np.append(True, fp[1:] != fp[:-1])
    keep = new | np.append(True, doc[1:] != doc[:-1])
    return fp[keep], doc[keep], new[keep]


def _window_rows(batches, width: int, buckets: int):
    """Keys below ``buckets``: hashes to compare. Keys from there on: hashes
    already known to be repeated, by part of the documents."""
    def flush(held):
        fp, doc, second = (np.concatenate(x) for x in zip(*held))
        held.clear()  # the pieces go before the sorted copies come
        order = np.lexsort((doc, fp))
        fp, doc, bucket = fp[order], doc[order], (second[order] % np.uint64(buckets)).astype(np.int64)
        # windows of one hash in two buckets may lie mixed: then one more entry than needed goes to a bucket, which tells them apart
        new = np.append(True, (fp[1:] != fp[:-1]) | (bucket[1:] != bucket[:-1]))
        keep = new | np.append(True, doc[1:] != doc[:-1])
        yield _packed(np.where(new, bucket, buckets + _part(doc, buckets))[keep], fp[keep], doc[keep])

    held, n = [], 0
    for chunk in ta.chunks(batches, limit=CHUNK_BYTES):
        data, offsets = ta.buffers(chunk.column("text"))
        s, e, before = ta.words(data, offsets)
        h = ta.span_hash(data, s, e)
        fp, doc, _ = ta.gram_hash(h, before, width)
        if not len(fp):
            continue
        held.append((fp, _ids(chunk.column("doc_id"))[doc], ta.gram_hash(h, before, width, seed=29)[0]))
        n += len(fp)
        if n >= FLUSH_WINDOWS:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _repeated(batches, buckets: int):
    """Rows come sorted by key, one bucket after the other; gives the repeated
    hashes by part of the documents."""
    def settle(rows):
        h, d, first = _smallest(*(np.concatenate(x) for x in zip(*rows)))
        return h[~first], d[~first]

    def give(hits):
        h, d = (np.concatenate(x) for x in zip(*hits))
        return _packed(_part(d, buckets), h, d)

    now, rows, hits, n = None, [], [], 0
    for batch in batches:
        for key, hashes, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now and rows:
                hits.append(settle(rows))
                n += len(hits[-1][0])
                rows = []
            now = key
            pair = np.frombuffer(hashes, np.uint64), np.frombuffer(ids, np.int64)
            if key < buckets:
                rows.append(pair)
            else:
                hits.append(pair)
                n += len(pair[0])
            if n >= FLUSH_WINDOWS:
                yield give(hits)
                hits, n = [], 0
    if rows:
        hits.append(settle(rows))
    if hits:
        yield give(hits)



class _Hits:
    """The repeated hashes of one part, by document."""

    def __init__(self, rows):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in rows]) if rows else np.zeros(0, np.uint64)
        d = np.concatenate([np.frombuffer(x, np.int64) for _, x in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(d, kind="stable")
        self.ids, self.hashes = d[order], h[order]

    def of(self, doc: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.ids, doc, "left"), np.searchsorted(self.ids, doc, "right")
        return self.hashes[lo:hi]


def _cut(texts: pa.Array, data, offsets, s, e, before, kept) -> pa.Array:
    """The texts without the runs of words not kept, from the first byte of a
    run to its last; a text that keeps all its words, or null, is as it was."""
    a, b, runs = ta.spans_where(~kept, before)
    cut = ta.cut_spans(data, offsets, s[a], e[b - 1])
    return pc.if_else(pa.array(np.diff(runs) > 0), cut, texts.cast(pa.string()))


def _remove(batches, width: int, keep: list[str], joined: bool):
    """Rows come sorted by part, its repeated hashes before its texts."""
    waiting: dict[int, list] = {}
    hits: dict[int, _Hits] = {}
    for chunk in ta.chunks(batches, limit=CHUNK_BYTES):
        parts, is_text = chunk.column("key").to_pylist(), chunk.column("hashes").is_null().to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~is_text):
            waiting.setdefault(parts[i], []).append((chunk.column("hashes")[int(i)].as_py(), chunk.column("ids")[int(i)].as_py()))
        rows = np.flatnonzero(is_text)
        if len(rows):
            texts = chunk.take(pa.array(rows))
            data, offsets = ta.buffers(texts.column("text"))
            s, e, before = ta.words(data, offsets)
            fp, doc, first = ta.gram_hash(ta.span_hash(data, s, e), before, width)
            edge = np.searchsorted(doc, np.arange(len(rows) + 1))
            step = np.zeros(len(s) + width + 1, dtype=np.int64)
            for i, key in enumerate(_ids(texts.column("doc_id")).tolist()):
                part = parts[rows[i]]
                if part not in hits:
                    hits = {part: _Hits(waiting.pop(part, []))}
                repeated = hits[part].of(key)
                if len(repeated) and edge[i] < edge[i + 1]:
                    hit = first[edge[i]:edge[i + 1]][np.isin(fp[edge[i]:edge[i + 1]], repeated)]
                    np.add.at(step, hit, 1)
                    np.add.at(step, hit + width, -1)
            kept = np.cumsum(step)[:len(s)] == 0
            left = np.append(0, np.cumsum(kept))[before]
            n = np.diff(before)
            text = ta.join_spans(data, s[kept], e[kept], left) if joined else _cut(texts.column("text"), data, offsets, s, e, before, kept)
            yield pa.RecordBatch.from_arrays(
                [texts.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()),
                 text, *(texts.column(c) for c in keep)],
                ["doc_id", "n_words", "n_removed", "kept_text", *keep])


def remove_repeated_windows(docs: DataFrame, width: int = 13, keep: tuple[str, ...] = (), joined: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, ``kept_text`` and the
    columns ``keep``, which may not be called as any of these. ``kept_text``
    is the kept words joined by one space or, if not ``joined``, the text as
    it is but for the removed runs of words: the white space around a run
    stays, and a null text stays null."""
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(8, int(size // BUCKET_BYTES).bit_length())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    windows = docs.select("doc_id", "text").mapInArrow(partial(_window_rows, width=width, buckets=buckets), _PACKED_TYPES)
    repeated = staged(windows.repartition(tasks, "key").sortWithinPartitions("key")
                      .mapInArrow(partial(_repeated, buckets=buckets), _PACKED_TYPES), "repeated-windows")
    part = part_of(F.coalesce("doc_id", F.lit(int(NO_ID))), buckets)
    texts = docs.select(part.alias("key"), "*", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("ids"))
    both = texts.unionByName(repeated, allowMissingColumns=True)
    types = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] if keep else []
    return (both.repartition(tasks, "key").sortWithinPartitions("key", F.col("hashes").isNull())
            .mapInArrow(partial(_remove, width=width, keep=list(keep), joined=joined),
                        ", ".join(["doc_id long, n_words long, n_removed long, kept_text string", *types])))
