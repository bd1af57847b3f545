"""N-gram Jaccard join by grouped prefixes.

Two texts link when the Jaccard similarity of their word-shingle sets
reaches the threshold t (exactly, in integers). Equal sets form one class.

1. Every shingle set is hashed. With one global order of shingles (rarest
   first), sets of a and b shingles that link share a shingle in their
   prefixes, the first a - o + 1 and b - o + 1 of each, where o is the
   overlap they need. Shingles of one class only lead nowhere.
   A first round orders by the frequency of the *pool*, a fixed part of the
   hash range of twice a prefix's share (shingles outside it come last, by
   hash). Its shingles travel packed, and a shingle of several classes of a
   chunk once a chunk, so a common one is never gathered row by row. It leaves
   the classes whose prefix may hold a shared shingle; a second round counts
   every shingle of these and cuts their prefixes anew.
2. Classes with the same prefix and size collapse into one group. Members
   are checked against the group's representative; those it does not link to
   leave the group.
3. Representatives meet in lists keyed by (prefix shingle, size band). Each is
   compared with one pivot of the list, the one with the fewest shingles of its
   own. Everything that links to a representative or a pivot forms a star around
   it; a star's radius is its members' largest distance.
4. Lists are folded to one entry a star and closed when their entries are in
   one component. Where stars of different components are left, a list of more
   than ``LIST`` of them is compared with a few pivots a round (of different
   components), which then leave it; a shorter one pair by pair. A pair is
   filtered by sizes and places of the shared shingle. Jaccard distance is a
   metric, so two stars further apart than 1 - t plus both radii have no linked
   members. The rest expand: members are compared with the other star's centre,
   then only those pairs that both centres allow with one another. Every link is
   verified on whole sets. Nothing is capped or dropped.

A set is identified by a 64-bit hash of its 64-bit shingle hashes and size.

Defined cases: a null or empty text has an empty set, links with nothing and
is its own component; fewer words than a shingle give one shingle of them
all; rows that repeat an id are linked (their component has that id); a null
id takes part, its component_id is the smallest id it reaches or null; other
columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_arrays as ta
from .components import components
from .numbering import sorted_groups
from .staging import bounded_batches, drop_staged, staged

BUCKET_TOKENS = 1 << 18            # pool shingles that meet in a bucket, about
CHUNK_BYTES = 512 << 10            # text bytes whose shingles are held as arrays at once
PACK_TOKENS = 1 << 18              # pool shingles that a task packs at once
PIVOT_ROWS = 256                   # comparisons that share one shipped pivot set
LIST = 512                         # stars that a list compares pair by pair
PIVOTS = 16                        # of a longer list, in its first round
_SET_TYPES = "cls long, n long, tokens array<long>"
_SET_SCHEMA = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_POOL_TYPES = "doc_id long, text_hash long, cls long, n long, m long, inner long, bucket long, packed binary"
_POOL_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("doc_id", "text_hash", "cls", "n", "m", "inner", "bucket")), ("packed", pa.binary())])


def _shingles(data, offsets, width: int):
    """Distinct shingle hashes, ascending within each document: (hashes, before each document)."""
    s, e, before = ta.words(data, offsets)
    h = ta.span_hash(data, s, e, lower=True)
    grams = [ta.gram_hash(h, before, width)[:2]]
    count = np.diff(before)
    for k in range(1, width):  # too short for a shingle: all words as one
        short = np.flatnonzero(count == k)
        if len(short):
            g = np.zeros(len(short), dtype=np.uint64)
            at = before[:-1][short]
            with np.errstate(over="ignore"):
                for j in range(k):
                    g += h[at + j] * ta.stream(width, 40 + k)[j]
            grams.append((ta._mix(g + np.uint64(k)), short))
    g, doc = (np.concatenate(x) for x in zip(*grams))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))
        g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(count) + 1))


def _classes(batches, width: int):
    """By chunk: (batch, shingle hashes, before each row, set sizes, classes, first row of a class in its chunk)."""
    for chunk in ta.chunks(batches, limit=CHUNK_BYTES):
        g, before = _shingles(*ta.buffers(chunk.column("text")), width)
        n = np.diff(before)
        rows = np.flatnonzero(n)
        total = np.zeros(len(n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            if len(rows):
                total[rows] = np.add.reduceat(ta._mix(g), before[:-1][rows])
            cls = ta._mix(total + n.astype(np.uint64)).view(np.int64)
        cls = np.where(cls == 0, 1, cls)  # 0 has a meaning of its own in _pool
        first = np.zeros(len(n), dtype=bool)
        first[np.unique(cls, return_index=True)[1]] = True
        yield chunk, g, before, n, cls, first & (n > 0)


def _full_sets(batches, width: int):
    """Whole sets, ascending, of the classes that begin in a chunk."""
    for _, g, before, n, cls, first in _classes(batches, width):
        take = np.where(first, n, 0)
        at = np.flatnonzero(np.repeat(first, n))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take))[np.append(np.flatnonzero(first), len(n))], pa.int32()),
                                         pa.array(g[at].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(cls[first]), pa.array(n[first].astype(np.int64)), lists], schema=_SET_SCHEMA)


def _pool(batches, width: int, percent: int, buckets: int):
    """A row per document, and the first ordered shingles of its classes packed by bucket."""
    top = np.uint64(min((1 << 64) - 1, (1 << 64) * 2 * (100 - percent) // 100))
    held: list[tuple] = []

    def pack(held):
        rows, tokens, of = (np.concatenate(x) for x in zip(*((r, t, o) for r, t, o in held)))
        order = np.lexsort((of, tokens))
        tokens, of = tokens[order], of[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])) if len(tokens) else np.zeros(0, bool)
        tokens, of = tokens[new], of[new]      # a class counts once
        start = np.append(True, tokens[1:] != tokens[:-1]) if len(tokens) else np.zeros(0, bool)
        several = np.diff(np.append(np.flatnonzero(start), len(tokens))) > 1
        met = of[np.repeat(several, np.diff(np.append(np.flatnonzero(start), len(tokens))))]
        known, count = np.unique(met, return_counts=True)
        inner = np.zeros(len(rows), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, rows[:, 2]), len(known) - 1)
            inner = np.where(known[at] == rows[:, 2], count[at], 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0], pa.int64(), mask=rows[:, 5] == 1), *(pa.array(rows[:, j]) for j in (1, 2, 3, 4)), pa.array(inner),
             pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())], schema=_POOL_SCHEMA)
        # a shingle of several classes goes once, without one: class 0 stands for more than one
        one = np.where(several, np.int64(0), of[start])
        tokens = tokens[start]
        bucket = (ta._mix(tokens) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((one, bucket))
        bucket, tokens, one = bucket[order], tokens[order], one[order]
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
        out = [(int(bucket[a]), tokens[a:b].tobytes() + one[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
        if out:
            blank = [pa.nulls(len(out), pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([*blank, pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())],
                                             schema=_POOL_SCHEMA)

    size = 0
    for chunk, g, before, n, cls, first in _classes(batches, width):
        low = np.append(0, np.cumsum(g < top))[before]
        m = np.diff(low)
        need = np.minimum(n, n + (-percent * n // 100) + 1)
        take = np.where(first, np.maximum(m, need), 0)
        edge = np.append(0, np.cumsum(take))
        at = np.arange(edge[-1]) + np.repeat(before[:-1] - edge[:-1], take)
        ids = chunk.column("doc_id").cast(pa.int64())
        rows = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), chunk.column("text_hash").to_numpy(zero_copy_only=False), cls, n,
                         np.maximum(m, need), np.asarray(ids.is_null()).astype(np.int64)], axis=1)
        held.append((rows, g[at], np.repeat(cls, take)))
        size += len(at) + len(n)
        if size >= PACK_TOKENS:
            yield from pack(held)
            held, size = [], 0
    if held:
        yield from pack(held)


def _bucket(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the packed columns of a bucket or part."""
    halves = [(blob[:len(blob) // 2], blob[len(blob) // 2:]) for blob in rows.column("packed").to_pylist()]
    return np.frombuffer(b"".join(a for a, _ in halves), np.uint64), np.frombuffer(b"".join(b for _, b in halves), np.int64)


def _summed(cls: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, at = np.unique(cls, return_inverse=True)
    return one, np.bincount(at, inner, len(one)).astype(np.int64)


def _shared(batches, parts: int):
    """Of each class, the shingles of a task's buckets that another one has too; packed by part of the classes."""
    schema = pa.schema([("part", pa.int64()), ("packed", pa.binary())])

    def pack(held):
        cls, inner = _summed(*(np.concatenate(x) for x in zip(*held)))
        part = (ta._mix(cls.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cls, inner, part = cls[order], inner[order], part[order]
        edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        rows = [(int(part[a]), cls[a:b].tobytes() + inner[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    held, size = [], 0
    for _, rows in sorted_groups(batches, "bucket"):
        tokens, of = _bucket(rows)
        order = np.lexsort((of, tokens))
        tokens, of = tokens[order], of[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1]))
        tokens, of = tokens[new], of[new]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        count = np.diff(np.append(start, len(tokens)))
        some = np.add.reduceat((of == 0).astype(np.int64), start) > 0
        cls, inner = np.unique(of[np.repeat((count > 1) | some, count) & (of != 0)], return_counts=True)
        if len(cls):
            held.append((cls, inner))
            size += len(cls)
        if size >= PACK_TOKENS:
            yield from pack(held)
            held, size = [], 0
    if held:
        yield from pack(held)


def _inner(batches):
    """(cls, inner) of a part of the classes."""
    for _, rows in sorted_groups(batches, "part"):
        cls, inner = _bucket(rows)
        cls, inner = _summed(cls.view(np.int64), inner)
        for lo in range(0, len(cls), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(cls[lo:lo + (1 << 16)]), pa.array(inner[lo:lo + (1 << 16)])], ["cls", "inner"])


def _edges(lists: pa.ListArray) -> np.ndarray:
    edge = lists.offsets.to_numpy()
    return edge - edge[0]


def _compare(batches):
    """Rows come sorted by (pivot, salt), the pivot's own set first."""
    schema = pa.schema([("x", pa.int64()), ("p", pa.int64()), ("common", pa.int64()), ("nx", pa.int64()), ("np", pa.int64())])
    pivot, own = None, None
    for batch in batches:
        out = []
        sets, edge = batch.column("tokens").flatten().to_numpy().view(np.uint64), _edges(batch.column("tokens"))
        for p, x, a, b in zip(batch.column("p").to_pylist(), batch.column("x").to_pylist(), edge[:-1], edge[1:]):
            s = sets[a:b]
            if x is None:
                pivot, own = p, s.copy()
            else:
                if p != pivot:
                    raise ValueError("a pivot's set is missing")
                small, large = (s, own) if len(s) < len(own) else (own, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                out.append((x, p, int((large[at] == small).sum()), len(s), len(own)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        self.docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                F.xxhash64("text").alias("text_hash"))

    def similar(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def prefix_size(self, n):
        return F.col(n) - F.ceil(F.col(n) * self.percent / 100) + 1

    def pool(self):
        """Writes (rows of documents and packed shingles), then a row per class:
        (cls, n, first row, whether its prefix may hold a shared shingle)."""
        size = self.docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = 1 + size * 2 * (100 - self.percent) // (100 * 6 * BUCKET_TOKENS)   # about six bytes a word
        both = staged(self.docs.mapInArrow(partial(_pool, width=self.width, percent=self.percent, buckets=buckets), _POOL_TYPES), "pool")
        rows = both.filter("bucket is null").select("doc_id", "text_hash", "cls", "n", "m", "inner")
        shared = (both.filter("bucket is not null").select("bucket", "packed").repartition("bucket").sortWithinPartitions("bucket")
                  .mapInArrow(partial(_shared, parts=buckets), "part long, packed binary")
                  .repartition("part").sortWithinPartitions("part").mapInArrow(_inner, "cls long, inner long"))
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
        own = rows.filter("n > 0").select("cls", "n", "m", F.col("inner").alias("here"), F.lit(0).cast("long").alias("there"), first.alias("row"))
        own = own.unionByName(shared.select("cls", F.col("inner").alias("there")), allowMissingColumns=True)
        classes = staged(own.groupBy("cls").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.min("row").alias("row"),
                                                (F.max("here") + F.sum("there")).alias("inner")), "classes")
        # single shingles come first: the prefix holds m - inner of them, if they don't fill it
        candidate = (F.col("inner") > 0) & (F.col("m") - F.col("inner") < self.prefix_size("n"))
        rows = staged(rows.select("doc_id", "text_hash", "cls", "n"), "rows")
        drop_staged(both)
        return rows, classes.select("cls", "n", "row", candidate.alias("candidate"))

    def full_sets(self, classes):
        """(cls, n, tokens): the whole sets of the candidate classes, from one text of each."""
        key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("k"), F.col("doc_id").isNull().alias("no_id"), "text_hash"]
        wanted = classes.filter("candidate").select("row.*").select(*key)
        texts = self.docs.select(*key, "text").join(wanted, ["k", "no_id", "text_hash"], "left_semi").select("text")
        full = texts.mapInArrow(partial(_full_sets, width=self.width), _SET_TYPES)
        return staged(full.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "full-sets")

    def prefixes(self) -> DataFrame:
        """(cls, n, own, prefix): the shared shingles of each class's prefix, rarest
        first; they follow ``own`` shingles of that class alone."""
        posts = self.full.select(F.explode("tokens").alias("token"), "cls", "n")
        shared = posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
        met = posts.join(shared, "token").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        own = F.col("n") - F.size("tokens")
        return (met.withColumn("own", own).filter(F.col("own") < self.prefix_size("n"))
                .select("cls", "n", "own", F.slice("tokens.token", F.lit(1), (self.prefix_size("n") - F.col("own")).cast("int")).alias("prefix")))

    def overlap(self, a, b):
        """Shingles that linked sets of sizes a and b have in common at least."""
        return F.ceil(self.percent * (a + b) / (100 + self.percent))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(x, p, common, nx, np) of class pairs (x, p)."""
        sets = self.full.select("cls", "tokens")
        load = pairs.groupBy("p").agg(F.ceil(F.count("*") / PIVOT_ROWS).alias("parts"))
        spread = (pairs.join(load, "p").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
                  .select("x", "p", "salt"))
        rows = spread.join(sets, spread.x == sets.cls).select("p", "salt", "x", "tokens")
        own = (load.select("p", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("salt"))
               .join(sets, F.col("p") == sets.cls).select("p", "salt", F.lit(None).cast("long").alias("x"), "tokens"))
        return (rows.unionByName(own).repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("x").isNotNull())
                .mapInArrow(_compare, "x long, p long, common long, nx long, np long"))

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        """Written: (x, p, fits, away) of class pairs."""
        away = 1 - F.col("common") / (F.col("nx") + F.col("np") - F.col("common"))
        got = self.verified(staged(pairs, f"{name}-pairs"))
        return staged(got.select("x", "p", self.similar(F.col("common"), F.col("nx"), F.col("np")).alias("fits"), away.alias("away")), name)

    def run(self):
        """(rows with their class, (cls, n, row) of the classes, label of each class that has a link)."""
        rows, classes = self.pool()
        self.full = self.full_sets(classes)
        grouped = staged(self.prefixes(), "prefixes")
        key = ["n", "own", "prefix"]
        member = staged(grouped.join(grouped.groupBy(*key).agg(F.min("cls").alias("rep")), key).select("cls", "rep", *key), "groups")

        # members with their representative, representatives with the pivots of their lists
        posts = self._posts(member.filter("cls = rep"), F.col("cls"))
        inside = member.filter("cls != rep").select(F.col("cls").alias("x"), F.col("rep").alias("p"))
        met = self.compared(inside.unionByName(self._pivot_pairs(posts)), "first-round")
        links = met.filter("fits").select(F.col("x").alias("u"), F.col("p").alias("v"))
        label = staged(components(links), "labels")

        # stars: centres are what something links to; all others go to the nearest centre
        seats = met.filter("fits").select(F.explode(F.array(
            F.struct(F.col("p").alias("cls"), F.struct(F.lit(0.0).alias("away"), F.lit(0).alias("x"), F.col("p").alias("of")).alias("to")),
            F.struct(F.col("x").alias("cls"), F.struct("away", F.lit(1).alias("x"), F.col("p").alias("of")).alias("to")))).alias("one"))
        star = seats.groupBy(F.col("one.cls").alias("cls")).agg(F.min_by("one.to", F.struct("one.to.x", "one.to.away", "one.to.of")).alias("to"))
        self.star = staged(star.join(label.withColumnRenamed("node", "cls"), "cls").select("cls", "to.of", "to.away", "label"), "stars")
        self.radius = staged(self.star.groupBy("of").agg(F.max("away").alias("radius")).filter("radius > 0"), "radius")

        posts, turn, last = staged(self._open(self._folded(member)), "lists-0"), 0, False
        while not last:
            large, pivots = posts.filter(F.col("entries") > LIST), PIVOTS ** (turn + 1)
            last = large.isEmpty()
            pairs = self._pairs(posts, posts).filter("node > pnode") if last else self._pairs(large, self._pivots(large, pivots))
            turn += 1
            new = self._star_links(pairs.select(F.col("node").alias("x"), F.col("pnode").alias("p")).distinct(), turn)
            if not new.isEmpty():
                label = self._merged(label, new, turn)
            if not last:
                left = posts.join(self._pivots(large, pivots).select("token", "band", "node"), ["token", "band", "node"], "left_anti")
                left = left.drop("comp", "entries").join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
                posts = staged(self._open(left), f"lists-{turn}")
        drop_staged(self.full)
        return rows, classes, label

    def _posts(self, nodes, node, *more):
        """(token, band, node, lo, hi, room): places in lists; ``room`` are the
        shingles from the shared one on."""
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / self.percent) * 1.000001)).cast("int")
        return (nodes.select(node.alias("node"), *more, "n", "own", F.posexplode("prefix").alias("at", "token"), band.alias("band"))
                .select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "node", *more, "own",
                        F.col("n").alias("lo"), F.col("n").alias("hi"), (F.col("n") - F.col("own") - F.col("at")).alias("room")))

    def _folded(self, member):
        """One entry a list and star: (token, band, node, lo, hi, room, own, comp)."""
        # a member in the star of its representative has that one's prefix, size and places
        seats = (member.join(self.star, "cls", "left").filter("cls = rep or of is null or of != rep")
                 .select(F.coalesce("of", "cls").alias("node"), F.coalesce("label", "cls").alias("comp"), "n", "own", "prefix"))
        return (self._posts(seats, F.col("node"), "comp").groupBy("token", "band", "node")
                .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("room").alias("room"), F.min("own").alias("own"), F.max("comp").alias("comp")))

    def _open(self, posts):
        """Entries of lists of more than one component that have room for a
        partner, with their list's number of entries."""
        some = (posts.groupBy("token", "band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("lo").alias("least"), F.count("*").alias("entries"))
                .filter("a != b").select("token", "band", "least", "entries"))
        return posts.join(some, ["token", "band"]).filter(F.col("room") >= self.overlap(F.col("lo"), F.col("least"))).drop("least")

    def may_link(self):
        """Two entries of a list, the other one's columns marked with a p."""
        need = self.overlap(F.col("lo"), F.col("plo"))
        sizes = (100 * F.col("hi") >= self.percent * F.col("plo")) & (100 * F.col("phi") >= self.percent * F.col("lo"))
        return sizes & (F.col("room") >= need) & (F.col("proom") >= need)

    def _pivot_pairs(self, posts):
        """(x, p): every entry with its list's first pivot."""
        row = F.struct("own", "node", "lo", "hi", "room")
        one = (posts.groupBy("token", "band").agg(F.min(row).alias("q"), F.max("node").alias("z"), F.min("node").alias("a")).filter("a != z")
               .select("token", "band", *(F.col(f"q.{c}").alias("p" + c) for c in ("node", "lo", "hi", "room"))))
        return posts.join(one, ["token", "band"]).filter("node != pnode").filter(self.may_link()).select(F.col("node").alias("x"), F.col("pnode").alias("p")).distinct()

    def _pivots(self, posts, k):
        """Of each list, the first entry of each of ``k`` components."""
        first = posts.groupBy("token", "band", "comp").agg(F.min(F.struct("own", "node", "lo", "hi", "room")).alias("q"))
        order = Window.partitionBy("token", "band").orderBy("q.own", "q.node")
        few = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return few.select("token", "band", "comp", "q.*")

    def _pairs(self, posts, others):
        """(node, pnode) of a list and different components that may link."""
        other = others.select("token", "band", *(F.col(c).alias("p" + c) for c in ("node", "lo", "hi", "room", "comp")))
        return posts.join(other, ["token", "band"]).filter(F.col("comp") != F.col("pcomp")).filter(self.may_link())

    def _star_links(self, pairs, turn):
        """Links between the members of two stars; centres first."""
        met = self.compared(pairs, f"centres-{turn}")
        found = met.filter("fits").select(F.col("x").alias("u"), F.col("p").alias("v"))
        rx, rp = (self.radius.select(F.col("of").alias(c), F.col("radius").alias("r" + c)) for c in ("x", "p"))
        least = 1 - self.percent / 100 + 1e-9
        r = F.coalesce("rx", F.lit(0.0)) + F.coalesce("rp", F.lit(0.0))
        near = met.filter("not fits").join(rx, "x", "left").join(rp, "p", "left").filter((r > 0) & (F.col("away") <= least + r))
        near = staged(near.select("x", "p", F.col("away").alias("apart"), F.coalesce("rx", F.lit(0.0)).alias("rx"), F.coalesce("rp", F.lit(0.0)).alias("rp")), f"near-{turn}")
        if near.isEmpty():
            return staged(found, f"links-{turn}")
        mine = self.star.select(F.col("cls").alias("one"), "of", F.col("away").alias("own"))
        # members with the other star's centre, unless the triangle inequality rules them out
        half = [near.join(mine, F.col(a) == F.col("of")).filter(f"one != {a}").filter(F.col("apart") - F.col("own") <= least + F.col(other))
                .select("x", "p", "one", "own", F.lit(side).alias("side"), F.col(b).alias("to"))
                for side, a, b, other in ((0, "x", "p", "rp"), (1, "p", "x", "rx"))]
        half = staged(half[0].unionByName(half[1]), f"halves-{turn}")
        seen = self.compared(half.select(F.col("one").alias("x"), F.col("to").alias("p")).distinct(), f"half-round-{turn}")
        half = half.join(seen.select(F.col("x").alias("one"), F.col("p").alias("to"), "fits", "away"), ["one", "to"])
        solved = half.filter("fits").select("x", "p").distinct()
        centre = [near.select("x", "p", F.col(a).alias("one"), F.lit(0.0).alias("own"), F.col("apart").alias("away"), F.lit(side).alias("side"))
                  for side, a in ((0, "x"), (1, "p"))]
        half = half.select("x", "p", "one", "own", "away", "side").unionByName(centre[0]).unionByName(centre[1]).join(solved, ["x", "p"], "left_anti")
        a, b = (half.filter(F.col("side") == k).select("x", "p", F.col("one").alias(c), F.col("own").alias("own" + c), F.col("away").alias("away" + c))
                for k, c in ((0, "i"), (1, "j")))
        wide = (a.join(b, ["x", "p"]).filter((F.col("awayi") <= least + F.col("ownj")) & (F.col("awayj") <= least + F.col("owni")))
                .filter("i != x and j != p").select(F.col("i").alias("x"), F.col("j").alias("p")).distinct())
        inner = self.compared(wide, f"members-{turn}")
        pairs = [seen, inner]
        return staged(reduce(DataFrame.unionByName, [found, *(m.filter("fits").select(F.col("x").alias("u"), F.col("p").alias("v")) for m in pairs)]), f"links-{turn}")

    def _merged(self, label, new, turn):
        """Labels with the new links: components of components."""
        at = [label.select(F.col("node").alias(c), F.col("label").alias("l" + c)) for c in ("u", "v")]
        short = new.join(at[0], "u", "left").join(at[1], "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        over = staged(components(short), f"merges-{turn}")
        over = over.select(F.col("node").alias("label"), F.col("label").alias("least"))
        kept = label.join(over, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
        # nodes without a link so far
        fresh = over.join(label.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("least").alias("label"))
        return staged(kept.unionByName(fresh), f"labels-{turn}")

    def result(self) -> DataFrame:
        rows, classes, label = self.run()
        one = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "row.doc_id")
        linked = one.join(one.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("cls", "component_id")
        return (rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(linked, "cls", "left")
                .select("doc_id", "n_shingles",
                        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))

    def firsts(self) -> DataFrame:
        rows, classes, label = self.run()
        linked = (classes.join(label.withColumnRenamed("node", "cls"), "cls", "left")
                  .groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("row").alias("row")).select("row.*"))
        empty = rows.filter("n = 0").select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").distinct()
        return linked.unionByName(empty).select("doc_id", "text_hash")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (set size) and component_id."""
    return _Join(docs, width, percent).result()


def component_firsts(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, text_hash) of the first text of each component: the smallest
    id (null after all others), then the smallest ``xxhash64(text)``. Rows are
    told apart by id and text, so neither null nor repeated ids merge
    components; each id and text without words stands for itself."""
    return _Join(docs, width, percent).firsts()
