"""Approximate nearest neighbours on randomly rotated one-bit codes.

A vector is centred, rotated by a fixed random orthogonal matrix and kept as
the signs of its coordinates (one bit each, packed) with a few correction
scalars. For a unit residual o with code vector s / sqrt(d), the inner
product with a query residual q is estimated as <s / sqrt(d), q> / <s /
sqrt(d), o>; the deviation is at most eps * |q| * sqrt((1 - c^2) / c^2) /
sqrt(d - 1) with c = <s / sqrt(d), o>, but for a chance that falls as
exp(-eps^2 / 2). In every block each query takes the k-th largest lower bound
as its threshold, and exactly those vectors whose upper bound reaches it are
reranked by their true inner products, so recall is governed by eps alone.

Vectors lie in blocks of about ``BLOCK`` rows, queries in blocks of about
``QUERY_BLOCK``; each pair of blocks is one unit of work, which gives the k
best of the block for each query, and a grouped top-k merges them. A unit holds
its vectors, and its queries stream past them ``AT_ONCE`` at a time, so a block
of queries may be long: n vectors are copied n / (20 * QUERY_BLOCK) times and
queries n / BLOCK times. The stated queries meet all rows this way; nothing
else is paired, broadcast or collected. Every row has a code; the only statistic fitted is the mean vector.

Defined cases: vectors that are null, zero, of another than the most frequent
length (the smaller of equals), or hold null or non-finite components take no
part; equal scores rank by the smaller vec_id; rows that repeat an id are one
candidate (the first by its components) and one query; a null vec_id takes no
part; fewer than k candidates are all given; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

BLOCK = 8192
QUERY_BLOCK = 65536
AT_ONCE = 128        # queries whose estimates are held at once
EPS = 3.0
_SEED = 20240607


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


_CODED = "vec_id long, block long, is_query boolean, vector array<double>, code binary, away double, cosine double, level double"


def _encode(batches, mean, rot):
    """Adds code, away = |v - mean|, cosine = <code, residual> and level = <v, mean>."""
    d = len(mean)
    for batch in batches:
        v = _matrix(batch.column("vector"), d)
        o = (v - mean) @ rot
        away = np.sqrt((o * o).sum(axis=1))
        signs = o >= 0
        cosine = np.abs(o).sum(axis=1) / np.sqrt(d) / np.maximum(away, 1e-300)
        codes = np.packbits(signs, axis=1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(away), pa.array(cosine), pa.array(v @ mean)],
            [*batch.schema.names, "code", "away", "cosine", "level"])


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first component on."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += vectors[:, j] * query[j]
    return total


def _nearest_in_block(ids, vectors, signs, away, cosine, level, reach, query_id, query, k, mean, rot, eps):
    """The block's k best of each query: (query position, vec_id, score)."""
    d = len(mean)
    q = (query - mean) @ rot
    q_len = np.sqrt((q * q).sum(axis=1))
    safe = np.where(cosine > 0, cosine, 1)  # a vector equal to the mean has no direction: its residual is 0
    ratio = (q.astype(np.float32) @ signs.T) / np.sqrt(d) / safe
    spread = np.sqrt(np.maximum(1 - safe * safe, 0)) / safe / np.sqrt(max(d - 1, 1))
    # <v, x> = <v - m, x - m> + <v, m> + <x, m> - <m, m>
    base = level[None, :] + (query @ mean)[:, None] - mean @ mean
    middle = away * ratio + base
    bound = away[None, :] * (eps * spread)[None, :] * q_len[:, None] + 1e-5 * (1 + np.abs(middle))
    low = middle - bound
    own = query_id[:, None] == ids[None, :]
    low[own] = -np.inf
    out = []
    for i in range(len(query)):
        least = np.partition(low[i], -k)[-k] if len(ids) > k else -np.inf
        at = np.flatnonzero((middle[i] + bound[i] >= least) & ~own[i])
        if len(at) > k:  # the stated order of addition for those alone that rounding could bring to the k best
            near = vectors[at] @ query[i]
            least = np.partition(near, -k)[-k] - 1e-15 * d * reach * np.sqrt(query[i] @ query[i])
            at = at[near >= least] if np.isfinite(least) else at
        score = exact_scores(vectors[at], query[i])
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), i), ids[at[best]], score[best]))
    return out


_FOUND = "query_id long, vec_id long, score double"
_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _block(vectors: list, d: int):
    """ids, vectors, signs, away, cosine and level of a block's rows; the greatest length."""
    v = pa.Table.from_batches(vectors).combine_chunks()
    codes = np.frombuffer(b"".join(v["code"].to_pylist()), np.uint8).reshape(v.num_rows, -1)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    matrix = _matrix(v["vector"].combine_chunks(), d)
    reach = np.sqrt((matrix * matrix).sum(axis=1).max())
    return v["vec_id"].to_numpy(), matrix, signs, *(v[c].to_numpy() for c in ("away", "cosine", "level")), reach


def _search(batches, k, mean, rot, eps):
    """Rows come sorted by (block, query block), the block's vectors first; the
    queries are answered as they come."""
    d = len(mean)
    now, vectors, block = None, [], None
    for batch in batches:
        key = np.stack([batch.column("block").to_numpy(), batch.column("query_block").to_numpy()], axis=1)
        role = batch.column("role").to_numpy()
        change = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1) | (role[1:] != role[:-1]))) if len(key) else np.zeros(0, int)
        for a, b in zip(change, np.append(change[1:], len(key))):
            if tuple(key[a]) != now:
                now, vectors, block = tuple(key[a]), [], None
            if not role[a]:
                vectors.append(batch.slice(a, b - a))
                continue
            if not vectors:
                continue
            block = block or _block(vectors, d)
            for lo in range(a, b, AT_ONCE):
                some = batch.slice(lo, min(AT_ONCE, b - lo))
                query_id, query = some.column("vec_id").to_numpy(), _matrix(some.column("vector"), d)
                found = _nearest_in_block(*block, query_id, query, k, mean, rot, eps)
                at, near, score = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(query_id[at]), pa.array(near), pa.array(score)], schema=_FOUND_SCHEMA)


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, eps: float = EPS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products.
    Queries are the rows whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    vector = F.col("embedding").cast("array<double>")
    fine = (~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
            .filter("vec_id is not null and vector is not null").filter(fine))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes[0]["d"]
    rows = staged(rows.filter(F.size("vector") == d).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    n = rows.count()
    sums = rows.agg(*(F.sum(F.get("vector", j)).alias(f"m{j}") for j in range(d))).first()
    mean = np.array(sums, np.float64) / n
    rot = rotation(d)
    blocks, query_blocks = -(-n // BLOCK), -(-(n // query_every + 1) // QUERY_BLOCK)
    rows = rows.select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")).alias("block"),
                       (F.col("vec_id") % query_every == 0).alias("is_query"), "vector")
    coded = staged(rows.mapInArrow(partial(_encode, mean=mean, rot=rot), _CODED), "codes")
    columns = ["vec_id", "vector", "code", "away", "cosine", "level"]
    all_queries, all_blocks = F.sequence(F.lit(0), F.lit(query_blocks - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    held = coded.select(*columns, F.col("block").cast("int").alias("block"), F.explode(all_queries).alias("query_block"), F.lit(0).alias("role"))
    asked = coded.filter("is_query").select(
        "vec_id", "vector", F.lit(None).cast("binary").alias("code"), *(F.lit(None).cast("double").alias(c) for c in columns[3:]),
        F.explode(all_blocks).alias("block"), F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(query_blocks).cast("long")).cast("int").alias("query_block"),
        F.lit(1).alias("role"))
    found = (held.unionByName(asked).repartition("block", "query_block").sortWithinPartitions("block", "query_block", "role")
             .mapInArrow(partial(_search, k=k, mean=mean, rot=rot, eps=eps), _FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
