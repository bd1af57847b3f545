"""How filters overlap: a removal game for each part of a table.

Five filters judge every document by itself. The worth of a coalition of
filters is the number of documents that at least one of them fails, so five
bits a document decide everything: documents are counted by (part, bits), and
the 32 worths of a part follow from at most 32 counts.

* A step of an order removes what its coalition has over the coalition before
  it; the other counts of a step are differences of coalitions too.
* The Hart-Mas-Colell potential is P(S) = (v(S) + sum of P(S without i)) / |S|
  from the empty coalition up. A filter's Shapley value is the potential of all
  filters minus the potential of all but it; times 120 it is the sum of what
  the filter removes over all orders. Potentials are held 120-fold, as whole
  numbers: every division comes out even (the shares of a potential have
  denominators up to 5).

Filter E (identical to a smaller id's text) needs no join back: rows are folded
by (text, part, other bits, labels) with the smallest id and how often it
occurs, so a large group of copies is one row a part before its texts meet.

Words are compared by 64-bit hashes within a document, texts by SHA-256.

Defined cases: a null text is empty; a null source is the empty part; a row
with a null id counts as larger than every id, and such rows don't precede one
another; rows that repeat an id count each, and don't precede one another
either; repeated labels of an id count once (1 if any is 1), null labels and
labels of other ids not at all; an empty table has no parts and no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_arrays as ta
from .staging import bounded_batches

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = list(permutations(range(len(FILTERS))))
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5   # words, and percents
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"#$%&*|")] = True
_AT_ONCE = 64                                        # parts whose rows are made at once


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[offsets])


def _bits(batches):
    """Adds the bits of A to D, and leaves out the text."""
    for chunk in ta.chunks(batches):
        data, offsets = ta.buffers(chunk.column("text"))
        start, end, before = ta.words(data, offsets)
        n_words = np.diff(before)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        with np.errstate(over="ignore"):
            key = ta._mix(ta.span_hash(data, start, end) + ta._mix(doc.astype(np.uint64)))
        distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=len(n_words))
        capitals = _per_document((data >= 65) & (data <= 90), offsets)
        points = _per_document((data & 0xC0) != 0x80, offsets)
        fails = [n_words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n_words, 100 * capitals > MAX_CAPITALS * points,
                 _per_document(_MARKS[data], offsets) > 0]
        bits = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("part"), chunk.column("copy"), pa.array(bits, pa.int32())],
                                         ["doc_id", "part", "copy", "bits"])


def worths(counts: np.ndarray) -> np.ndarray:
    """(parts, 32): documents with any bit of each coalition, from (parts, 32) counts by bits."""
    bits = np.arange(ALL + 1)
    return counts @ ((bits[:, None] & bits[None, :]) != 0).astype(np.int64)


def potentials(worth: np.ndarray) -> np.ndarray:
    """(parts, 32): 120 times the potential of each coalition, from smaller ones."""
    p = np.zeros_like(worth)
    for s in range(1, ALL + 1):
        members = [i for i in range(len(FILTERS)) if s >> i & 1]
        p[:, s] = (len(ORDERS) * worth[:, s] + sum(p[:, s ^ (1 << i)] for i in members)) // len(members)
    return p


_LONGS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _LONGS)
_OUT_SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _LONGS)])


def _steps(batches):
    orders = np.array(ORDERS)
    after = np.cumsum(1 << orders, axis=1).ravel()
    which = orders.ravel()
    before = after - (1 << which)
    names = np.repeat(["".join(FILTERS[i] for i in o) for o in ORDERS], len(FILTERS))
    step = np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
    for batch in batches:
        for lo in range(0, batch.num_rows, _AT_ONCE):
            some = batch.slice(lo, _AT_ONCE).to_pylist()
            counts = np.zeros((3, len(some), ALL + 1), dtype=np.int64)
            for i, row in enumerate(some):
                for c in row["counts"]:
                    counts[:, i, c["bits"]] += (c["n"], c["good"], c["toxic"])
            worth, good, toxic = (worths(c) for c in counts)
            total = counts[0].sum(axis=1, keepdims=True)
            removed = worth[:, after] - worth[:, before]
            p = potentials(worth)
            longs = [total - worth[:, after], removed, worth[:, 1 << which] - removed, (worth[:, [ALL]] - worth[:, ALL ^ (1 << which)]),
                     good[:, after] - good[:, before], toxic[:, after] - toxic[:, before], p[:, [ALL]] - p[:, ALL ^ (1 << which)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([row["part"] for row in some], len(which)).astype(object), pa.string()), pa.array(np.tile(names, len(some)).astype(object), pa.string()),
                 pa.array(np.tile(step, len(some)).astype(np.int32)), *(pa.array(x.ravel()) for x in longs)], schema=_OUT_SCHEMA)


def removal_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents by the filters that they fail."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
                                        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("copy"), "text")
    rows = rows.mapInArrow(_bits, "doc_id long, part string, copy binary, bits int")
    ids = rows.groupBy("doc_id", "part", "copy", "bits").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    both = ids.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    folded = both.groupBy("copy", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")).alias("first"))
    least = F.min(F.struct("first.no_id", "first.doc_id")).over(Window.partitionBy("copy"))
    own = (F.col("first.no_id") == F.col("least.no_id")) & F.col("first.doc_id").eqNullSafe(F.col("least.doc_id"))
    split = (folded.withColumn("least", least).withColumn("free", F.when(own, F.col("first.n")).otherwise(0))
             .select("part", "good", "toxic", F.explode(F.array(
                 F.struct("bits", F.col("free").alias("n")),
                 F.struct(F.col("bits").bitwiseOR(F.lit(1 << 4)).alias("bits"), (F.col("n") - F.col("free")).alias("n")))).alias("one"))
             .filter("one.n > 0"))
    n = F.col("one.n")
    return split.groupBy("part", F.col("one.bits").alias("bits")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    games = removal_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("counts"))
    return games.mapInArrow(_steps, _OUT)
