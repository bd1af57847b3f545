"""Exact top-k search of inner products in an M-tree, best node first.

Vectors become whole numbers, floor(scale * x), under the Euclidean metric. As
2 <q, x> = |q|^2 + |x|^2 - |q - x|^2, a node whose members have squared norms of
at most N and lie no nearer to q than D holds no score above
(|q|^2 + N - D^2) / 2, so the M-tree's bounds on distances bound scores.

* **Pages.** A bounded sample (``ROUTERS`` vectors at most, the smallest hashes
  of ids) gives the routing objects of the root. Every vector goes to its
  nearest one; the vectors of a routing object, ordered by their distance to
  it, are cut into pages of ``PAGE`` rows, so a page is a ring between two radii
  and no routing object, however popular, makes a page larger.
* **Nodes.** A task builds the M-tree of one page: nodes of at most ``FAN``
  children and leaves of at most ``LEAF`` vectors (or copies of one), each with its routing object, covering radius, distance to the
  parent's routing object and largest squared norm.
* **Search.** A query goes to the page of the best bound first; the k-th best
  score there is its threshold. The pages whose bound reaches the threshold
  follow, and the k best of all are merged. Within a page a heap gives the node
  of the best bound next, until that bound is below the k-th best score. The
  distances of an entry and of the query to the parent's routing object bound
  the entry's distance by the triangle inequality; an entry that cannot reach
  the threshold is dropped before its own distance is computed.

All bounds have a margin above their rounding error, and scores are exact whole
numbers, so the result equals a full scan's. Where many queries meet one page,
its queries are split and the page is read by several tasks.

Defined cases: vectors that are null, empty, of another than the most frequent
length (the smaller of equals) or hold null or non-finite components take no
part; zero vectors do; rows that repeat an id are one vector (the first by its
components) and one query; a null id takes no part; equal scores rank by the
smaller id; fewer than k candidates are all given; components are cut at
+-2^53 and scores at the limits of a long; other columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered, sorted_groups
from .staging import staged

ROUTERS = 1024         # routing objects of the root, a bounded sample
PAGE = 4096            # vectors of a page
FAN = 32               # children of a node
LEAF = 256             # vectors of a leaf
QUERIES_A_TASK = 16_384
RINGS_AT_ONCE = 4096   # pages whose bounds a task compares at once
_LIMIT = float(1 << 53)
_LONG = (1 << 63) - 1


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, (points, centres), a block of differences at a time."""
    out = np.empty((len(points), len(centres)))
    for lo in range(0, len(points), 256):
        for c in range(len(centres)):
            gap = points[lo:lo + 256] - centres[c]
            out[lo:lo + 256, c] = np.sqrt((gap * gap).sum(axis=1))
    return out


def scores(vectors: np.ndarray, query: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    most = max(np.abs(vectors).max(initial=0), np.abs(query).max(initial=0))
    if most * most * len(query) < _LIMIT:  # every partial sum is a whole double
        return (vectors @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
    return np.array([max(-_LONG - 1, min(_LONG, s)) for s in exact], dtype=np.int64)


def _middle(vectors: np.ndarray, members: np.ndarray) -> int:
    """The member nearest to the members' mean."""
    gap = vectors[members] - vectors[members].mean(axis=0)
    return members[np.argmin((gap * gap).sum(axis=1))]


def _split(vectors: np.ndarray, members: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(routing object, members) of at most FAN parts: centres far from one
    another, each member with its nearest; nothing if they cannot be told apart."""
    v = vectors[members]
    pick, chosen = int(np.flatnonzero(members == _middle(vectors, members))[0]), []
    nearest, owner = np.full(len(members), np.inf), np.zeros(len(members), int)
    for j in range(min(FAN, -(-len(members) // LEAF))):
        gap = v - v[pick]
        far = (gap * gap).sum(axis=1)
        owner[far < nearest] = j
        nearest = np.minimum(nearest, far)
        chosen.append(pick)
        pick = int(np.argmax(nearest))
        if not nearest[pick]:
            break
    parts = [(members[c], members[owner == j]) for j, c in enumerate(chosen)]
    return parts if len(parts) > 1 else []


def build(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of a page's M-tree (0 is the root; parents come before their
    children) and, by vector, its leaf and its distance to the leaf's centre."""
    norm = (vectors * vectors).sum(axis=1)
    node: dict[str, list] = {"parent": [], "centre": [], "radius": [], "apart": [], "most": []}
    leaf, leaf_apart = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
    everything = np.arange(len(vectors))
    todo = [(-1, _middle(vectors, everything), everything)]
    while todo:
        parent, centre, members = todo.pop()
        at = len(node["parent"])
        to = _distances(vectors[members], vectors[[centre]])[:, 0]
        up = vectors[node["centre"][parent]] - vectors[centre] if at else np.zeros(1)
        for name, value in (("parent", parent), ("centre", centre), ("radius", to.max()), ("apart", np.sqrt((up * up).sum())), ("most", norm[members].max())):
            node[name].append(value)
        parts = _split(vectors, members) if len(members) > LEAF else []
        todo += [(at, c, m) for c, m in parts]
        if not parts:
            leaf[members], leaf_apart[members] = at, to
    kinds = {"parent": np.int32, "centre": np.int32}
    return {**{name: np.array(x, kinds.get(name, np.float64)) for name, x in node.items()}, "leaf": leaf, "leaf_apart": leaf_apart}


_TREE = [("parent", np.int32), ("centre", np.int32), ("radius", np.float64), ("apart", np.float64), ("most", np.float64),
         ("leaf", np.int32), ("leaf_apart", np.float64)]


class Tree:
    """The M-tree of one page, read from its arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, parent, centre, radius, apart, most, leaf, leaf_apart):
        self.ids, self.vectors, self.centre, self.radius, self.apart, self.most, self.leaf_apart = ids, vectors, centre, radius, apart, most, leaf_apart
        self.norm = (vectors * vectors).sum(axis=1)
        nodes = np.arange(len(parent) + 1)
        by_parent, by_leaf = np.argsort(parent, kind="stable"), np.argsort(leaf, kind="stable")
        self.child = np.split(by_parent, np.searchsorted(parent[by_parent], nodes))[1:-1]
        self.entry = np.split(by_leaf, np.searchsorted(leaf[by_leaf], nodes))[1:-1]

    def search(self, query_id: int, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """The page's best (score, vec_id), at most k, of those that reach ``least``."""
        own = (query * query).sum()
        margin = 1e-9 * (own + self.norm.max() + 1)
        best: list[tuple[int, int]] = []     # heap of (score, -id): the worst first
        limit = -np.inf if least is None else float(least)
        first = np.sqrt(((self.vectors[self.centre[0]] - query) ** 2).sum())
        heap = [(-np.inf, 0, first)]
        while heap:
            bound, node, to_centre = heapq.heappop(heap)
            if -bound < limit:
                break
            kids = self.child[node]
            if len(kids):
                # |d(q, parent) - d(parent, kid)| <= d(q, kid): known without the kid's vector
                near = np.maximum(np.abs(to_centre - self.apart[kids]) - self.radius[kids], 0)
                kids = kids[(own + self.most[kids] - near * near) / 2 + margin >= limit]
                gap = self.vectors[self.centre[kids]] - query
                to = np.sqrt((gap * gap).sum(axis=1))
                near = np.maximum(to - self.radius[kids], 0)
                top = (own + self.most[kids] - near * near) / 2 + margin
                for b, kid, d in zip(top.tolist(), kids.tolist(), to.tolist()):
                    if b >= limit:
                        heapq.heappush(heap, (-b, kid, d))
                continue
            members = self.entry[node]
            near = to_centre - self.leaf_apart[members]
            members = members[((own + self.norm[members] - near * near) / 2 + margin >= limit) & (self.ids[members] != query_id)]
            if not len(members):
                continue
            score = scores(self.vectors[members], query)
            good = score >= limit
            for one, vec_id in zip(score[good].tolist(), self.ids[members[good]].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (one, -vec_id))
                elif (one, -vec_id) > best[0]:
                    heapq.heapreplace(best, (one, -vec_id))
            if len(best) == k:
                limit = max(limit, float(best[0][0]))
        return [(s, -v) for s, v in best]


def _route(batches, routers: np.ndarray):
    """Adds the nearest routing object and the distance to it."""
    for batch in batches:
        v = _matrix(batch.column("vector"), routers.shape[1])
        nearest = ((routers * routers).sum(axis=1) - 2 * (v @ routers.T)).argmin(axis=1)
        gap = v - routers[nearest]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(np.sqrt((gap * gap).sum(axis=1)))],
                                         [*batch.schema.names, "router", "away"])


_PACKED = [f"node_{name}" for name, _ in _TREE]
_PAGE = "router int, page long, low double, high double, most double, ids binary, vectors binary, " + ", ".join(f"{c} binary" for c in _PACKED)
_PAGE_SCHEMA = pa.schema([("router", pa.int32()), ("page", pa.int64()), *((c, pa.float64()) for c in ("low", "high", "most")),
                          *((c, pa.binary()) for c in ("ids", "vectors", *_PACKED))])


def _pages(batches, d: int):
    """One row per page: its ring, largest squared norm, members and nodes."""
    for (router, page), rows in sorted_groups(batches, "router", "page"):
        v, away = _matrix(rows.column("vector"), d), rows.column("away").to_numpy()
        yield pa.RecordBatch.from_pylist([{
            "router": router, "page": page, "low": away.min(), "high": away.max(), "most": (v * v).sum(axis=1).max(),
            "ids": rows.column("vec_id").to_numpy().tobytes(), "vectors": np.ascontiguousarray(v).tobytes(),
            **{f"node_{name}": x.tobytes() for name, x in build(v).items()}}], schema=_PAGE_SCHEMA)


def _bounds(query: np.ndarray, rings, routers: np.ndarray) -> np.ndarray:
    """The largest score that a query can have in each page."""
    router, low, high, most = rings
    own = (query * query).sum()
    to = _distances(routers, query[None, :])[:, 0][router]
    near = np.maximum(np.maximum(to - high, low - to), 0)
    near = np.maximum(near - 1e-9 * (to + high), 0)
    return (own + most - near * near) / 2 + 1e-9 * (own + most + 1)


_ASKED = "vec_id long, vector array<double>, least long, router int, page long, bound double"


def _choose(batches, routers: np.ndarray, first: bool):
    """Rows come sorted by (ring block, role): rings, then queries. Gives each
    query its best page (``first``), or all others that may reach ``least``."""
    d = routers.shape[1]
    for _, rows in sorted_groups(batches, "ring_block", "salt"):
        is_query = rows.column("role").to_numpy() == 1
        at = int(np.searchsorted(is_query, True))
        rings, asked = rows.slice(0, at), rows.slice(at)
        place = [rings.column(c).to_numpy() for c in ("router", "page")]
        ring = [rings.column(c).to_numpy() for c in ("router", "low", "high", "most")]
        for lo in range(0, asked.num_rows, 256):
            some = asked.slice(lo, 256)
            queries, least = _matrix(some.column("vector"), d), some.column("least").to_pylist()
            home = list(zip(some.column("router").to_pylist(), some.column("page").to_pylist()))
            who, where, bound = [], [], []
            for i, query in enumerate(queries):
                top = _bounds(query, ring, routers)
                if first:
                    best = np.lexsort((place[1], place[0], -top))[:1]
                else:
                    best = np.flatnonzero(((top >= least[i]) if least[i] is not None else np.ones(len(top), bool))
                                          & ~((place[0] == home[i][0]) & (place[1] == home[i][1])))
                who.append(np.full(len(best), i))
                where.append(best)
                bound.append(top[best])
            who, where, bound = (np.concatenate(x) for x in (who, where, bound))
            chosen = some.take(pa.array(who)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [chosen.column("vec_id").combine_chunks(), chosen.column("vector").combine_chunks(), chosen.column("least").combine_chunks(),
                 pa.array(place[0][where].astype(np.int32)), pa.array(place[1][where]), pa.array(bound)],
                ["vec_id", "vector", "least", "router", "page", "bound"])


_FOUND = "query_id long, vec_id long, score long, router int, page long"
_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("router", pa.int32()), ("page", pa.int64())])


def _search(batches, d: int, k: int):
    """Rows come sorted by (page, salt, role): the page, then its queries."""
    now, tree = None, None
    for batch in batches:
        out = []
        role = batch.column("role").to_numpy()
        place = list(zip(*(batch.column(c).to_pylist() for c in ("router", "page", "salt"))))
        for i in range(batch.num_rows):
            if role[i] == 0:
                packed = [np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in
                          [("ids", np.int64), ("vectors", np.float64), *((f"node_{name}", t) for name, t in _TREE)]]
                tree = Tree(packed[0], packed[1].reshape(-1, d), *packed[2:])
                now = place[i]
                continue
            if place[i] != now:
                raise ValueError("a page is missing")
            query_id = batch.column("vec_id")[i].as_py()
            query = np.array(batch.column("vector")[i].as_py(), np.float64)
            found = tree.search(query_id, query, k, batch.column("least")[i].as_py())
            out += [(query_id, v, s, *now[:2]) for s, v in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND_SCHEMA.types)], schema=_FOUND_SCHEMA)


class Index:
    """The paged M-tree over (vec_id, vector)."""

    def __init__(self, rows: DataFrame, d: int, page: int = PAGE):
        self.d = d
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ROUTERS)
        n = rows.count()
        sample = sample.limit(max(1, min(ROUTERS, -(-n // page)))).select("vector").collect()
        self.routers = np.array([r[0] for r in sample], np.float64).reshape(len(sample), d)
        routed = rows.mapInArrow(partial(_route, routers=self.routers), "vec_id long, vector array<double>, router int, away double")
        placed = numbered(routed, ["router"], ["away", "vec_id"], "metric-rows")
        placed = placed.select("vec_id", "vector", "router", "away", F.floor(F.col("pos") / page).cast("long").alias("page"))
        self.pages = staged(placed.repartition("router", "page").sortWithinPartitions("router", "page")
                            .mapInArrow(partial(_pages, d=d), _PAGE), "metric-pages")
        self.rings = self.pages.select("router", "page", "low", "high", "most")
        self.ring_blocks = -(-self.rings.count() // RINGS_AT_ONCE)

    def choose(self, asked: DataFrame, first: bool) -> DataFrame:
        """(query, page) pairs; ``asked``: vec_id, vector, least, router, page (the home, null at first)."""
        n = asked.count()
        salts = -(-n // QUERIES_A_TASK)
        each = F.sequence(F.lit(0), F.lit(max(salts - 1, 0)))
        rings = self.rings.select(F.pmod(F.xxhash64("router", "page"), F.lit(self.ring_blocks).cast("long")).cast("int").alias("ring_block"),
                                  F.explode(each).alias("salt"), F.lit(0).alias("role"), "router", "page", "low", "high", "most")
        queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(self.ring_blocks - 1))).alias("ring_block"),
                               F.pmod(F.xxhash64("vec_id"), F.lit(max(salts, 1)).cast("long")).cast("int").alias("salt"), F.lit(1).alias("role"),
                               "vec_id", "vector", "least", "router", "page")
        rows = rings.unionByName(queries, allowMissingColumns=True)
        return (rows.repartition("ring_block", "salt").sortWithinPartitions("ring_block", "salt", "role")
                .mapInArrow(partial(_choose, routers=self.routers, first=first), _ASKED))

    def search(self, pairs: DataFrame, k: int) -> DataFrame:
        """The best of each pair (query, page)."""
        load = pairs.groupBy("router", "page").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("parts"))
        asked = (pairs.join(load, ["router", "page"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int"))
                 .select("router", "page", "salt", F.lit(1).alias("role"), "vec_id", "vector", "least"))
        held = (self.pages.join(load, ["router", "page"])
                .select("router", "page", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"), "ids", "vectors", *_PACKED))
        rows = held.unionByName(asked, allowMissingColumns=True)
        return (rows.repartition("router", "page", "salt").sortWithinPartitions("router", "page", "salt", "role")
                .mapInArrow(partial(_search, d=self.d, k=k), _FOUND))


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_scores(embeddings: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of
    floor(``scale`` * x), for the rows whose id is divisible by ``query_every``."""
    spark = embeddings.sparkSession
    limit = F.lit(_LIMIT)
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .filter("vec_id is not null and size(embedding) > 0").filter(fine))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = sizes[0]["d"]
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, limit), -limit)).cast("double"), limit), -limit))
    rows = staged(rows.filter(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
                  .select("vec_id", whole.alias("vector")), "metric-vectors")
    index = Index(rows, d, page)
    none = F.lit(None)
    asked = rows.filter(F.col("vec_id") % query_every == 0).select(
        "vec_id", "vector", none.cast("long").alias("least"), none.cast("int").alias("router"), none.cast("long").alias("page"))
    home = index.choose(asked, first=True)
    home = (home.groupBy("vec_id").agg(F.max(F.struct("bound", "router", "page", "vector", "least")).alias("b"))
            .select("vec_id", "b.vector", "b.least", "b.router", "b.page"))
    home = staged(home, "metric-home")
    near = staged(best(index.search(home, k), k), "metric-first")
    least = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    rest = staged(index.choose(home.drop("least").join(least, "vec_id", "left"), first=False), "metric-rest")
    found = near.select("query_id", "vec_id", "score").unionByName(index.search(rest, k).select("query_id", "vec_id", "score"))
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
