"""Merkle manifest of a table: a tree of SHA-256 midstates.

A leaf is the digest of a row. Within a language the leaves ascend by id, and
every ``FAN`` consecutive nodes become one parent, level by level, up to the
language's subroot; the subroots, in order of language, become the root in the
same way. A parent is hashed child by child and retains a copy of the hash
state before each child's slot, so folding a replaced child resumes the state
of its slot and hashes the replacement and the siblings to its right only.

The leaves of a language are cut into blocks of ``FAN ** height``, each a whole
subtree of ``height`` levels that one step of a task builds; the blocks' tops
are the leaves of the next round. So a language, however large, is never in
one task, and every round shrinks the rows by the block. Down the rounds each
block gets its path to the root (its slots and runs of siblings); the states
along it are rebuilt once a block, and every leaf of the block resumes them.

Defined cases: a null value is ``-`` in a leaf; null languages form a group of
their own, before all others; null ids come first in theirs; rows that repeat
an id are ordered by their leaves, and equal rows are leaves each; a language
of one row has its leaf as subroot, and a table of one language its subroot as
root; without any sibling the proof is the digest of nothing; an empty table
gives no rows; columns other than those of ``documents`` are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, sorted_groups
from .staging import staged

FAN = 8
HEIGHT = 3          # levels of a block
_PATH = "array<struct<slot:int,run:array<string>>>"
_PATH_TYPE = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))


def _value(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of ``documents`` that has this text."""
    return F.sha2(F.concat(*(_value(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _value(text)), 256)


class Parent:
    """A node that retains the hash state before each child's slot."""

    def __init__(self, run: list[str]):
        self.run = run
        self.states, state = [], hashlib.sha256()
        for child in run:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()
        self.right = ["".join(run[i + 1:]).encode() for i in range(len(run))]

    def fold(self, slot: int, child: str) -> str:
        """The digest with another child at ``slot``."""
        state = self.states[slot].copy()
        state.update(child.encode())
        state.update(self.right[slot])
        return state.hexdigest()

    def others(self, slot: int) -> bytes:
        return "".join(self.run[:slot]).encode() + self.right[slot]


def levels(n: int, height: int) -> int:
    """Levels that a block of a group of ``n`` nodes adds, at most ``height``."""
    added = 0
    while n > 1 and added < height:
        n = -(-n // FAN)
        added += 1
    return added


def subtree(nodes: list[str], added: int) -> tuple[list[list[Parent]], str]:
    """The parents of each level over the nodes of a block, and its top."""
    tree = []
    for _ in range(added):
        tree.append([Parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in tree[-1]]
    return tree, nodes[0]


def _way(tree: list[list[Parent]], place: int) -> list[tuple[Parent, int]]:
    way = []
    for level in tree:
        way.append((level[place // FAN], place % FAN))
        place //= FAN
    return way


_NODE = "grp string, pos long, n long, digest string"


def _tops(batches, height: int):
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    for (grp, block), rows in sorted_groups(batches, "grp", "block"):
        n = rows.column("n")[0].as_py()
        top = subtree(rows.column("digest").to_pylist(), levels(n, height))[1]
        yield pa.RecordBatch.from_pylist([{"grp": grp, "pos": block, "n": -(-n // FAN ** height), "digest": top}], schema=schema)


def _blocks(nodes: DataFrame, height: int, above: DataFrame | None = None) -> DataFrame:
    """Nodes sorted within their blocks, after the row of the path from the
    block's top (``above``: grp, pos, path, subroot, root)."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FAN ** height).cast("long"))
    if above is not None:
        path = above.withColumn("block", F.col("pos")).withColumn("pos", F.lit(-1).cast("long"))
        rows = rows.unionByName(path, allowMissingColumns=True)
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _paths_of_nodes(batches, height: int):
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("path", _PATH_TYPE), ("top", pa.string())])
    for (grp, _), rows in sorted_groups(batches, "grp", "block"):
        up, nodes = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        tree, _ = subtree(nodes.column("digest").to_pylist(), levels(nodes.column("n")[0].as_py(), height))
        out = []
        for place, pos in enumerate(nodes.column("pos").to_pylist()):
            own = [{"slot": slot, "run": p.run} for p, slot in _way(tree, place)]
            out.append({"grp": grp, "pos": pos, "path": own + up["path"], "top": up["top"]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _tops_of(nodes: DataFrame, height: int) -> DataFrame:
    return staged(_blocks(nodes.select("grp", "pos", "n", "digest"), height).mapInArrow(partial(_tops, height=height), _NODE), "merkle-tops")


def _paths(nodes: DataFrame, height: int) -> DataFrame:
    """(grp, pos, path, top): the way of each node to the top of its group."""
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return nodes.select("grp", "pos", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    above = _paths(_tops_of(nodes, height), height)
    rows = _blocks(nodes.select("grp", "pos", "n", "digest"), height, above)
    return staged(rows.mapInArrow(partial(_paths_of_nodes, height=height), f"grp string, pos long, path {_PATH}, top string"), "merkle-paths")


_FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_FOLDED_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
                            ("verified", pa.bool_())])


def _fold(batches, height: int):
    for _, rows in sorted_groups(batches, "grp", "block"):
        up, leaves = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        digests = leaves.column("digest").to_pylist()
        tree, _ = subtree(digests, levels(leaves.column("n")[0].as_py(), height))
        upper = [(Parent(step["run"]), step["slot"]) for step in up["path"]]
        shared = b"".join(p.others(slot) for p, slot in upper)
        proofs, roots = [], []
        for place, now in enumerate(leaves.column("changed").to_pylist()):
            way = _way(tree, place)
            proof = hashlib.sha256(b"".join(p.others(slot) for p, slot in way))
            proof.update(shared)
            proofs.append(proof.hexdigest())
            for parent, slot in (*way, *upper):
                now = parent.fold(slot, now)
            roots.append(now)
        k = len(digests)
        yield pa.RecordBatch.from_arrays(
            [leaves.column("doc_id").combine_chunks(), pa.array(digests), pa.array([up["subroot"]] * k), pa.array([up["root"]] * k),
             pa.array(proofs), pa.array(roots), pa.array([r == up["root"] for r in roots])], schema=_FOLDED_SCHEMA)


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256 (of the
    siblings up to the root), folded_root (from the row with ``tampered`` as its
    text, if given) and verified (whether that is the root)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"),
                       leaf(F.col("text")).alias("digest"),
                       (F.lit(None).cast("string") if tampered is None else F.when(~tampered.eqNullSafe(F.col("text")), leaf(tampered))).alias("changed"))
    rows = staged(rows, "merkle-rows")  # the texts are hashed once, not again for the ranges
    leaves = numbered(rows, ["grp"], ["doc_id", "digest"], "merkle-leaves")
    leaves = staged(leaves.withColumn("changed", F.coalesce("changed", "digest")), "merkle-numbered")
    above = _paths(_tops_of(leaves, height), height)
    subroots = above.groupBy("grp").agg(F.first("top").alias("digest"))
    subroots = numbered(subroots.select(F.lit("").alias("all"), F.col("grp").alias("of"), "digest"), ["all"], ["of"], "merkle-subroots")
    subroots = staged(subroots.withColumnRenamed("all", "grp"), "merkle-subroots")
    upper = _paths(subroots.select("grp", "pos", "n", "digest"), height).select("pos", F.col("path").alias("upper"), F.col("top").alias("root"))
    upper = subroots.select("pos", F.col("of").alias("grp")).join(upper, "pos").drop("pos")
    above = (above.join(upper, "grp").select("grp", "pos", F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root"))
    return _blocks(leaves, height, above).mapInArrow(partial(_fold, height=height), _FOLDED)
