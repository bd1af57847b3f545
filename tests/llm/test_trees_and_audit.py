"""M-tree search, filter audit and Merkle manifest against plain re-statements."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfence.llm import filter_audit, merkle, metric_tree
from ringfence.llm.numbering import numbered

from . import cases


# numbering ------------------------------------------------------------------

def test_numbered_places_every_row(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", "c"]), r.randrange(40), i) for i in range(700)]
    got = numbered(spark.createDataFrame(rows, "g string, k long, id long").repartition(7), ["g"], ["k", "id"]).collect()
    for g in "abc":
        mine = sorted((x.k, x.id, x.pos, x.n) for x in got if x.g == g)
        assert [m[2] for m in mine] == list(range(len(mine))) and {m[3] for m in mine} == {len(mine)}
    assert len(got) == 700


# M-tree ---------------------------------------------------------------------

def _best(rows, k, every):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            seen.setdefault(i, []).append(v)
    size = min((-n, d) for d, n in Counter(len(v) for vs in seen.values() for v in vs).items())[1]
    whole = {i: [math.floor(1024 * x) for x in min(v for v in vs if len(v) == size)] for i, vs in seen.items() if any(len(v) == size for v in vs)}
    out = []
    for q in whole:
        if q % every == 0:
            near = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(out)


def _vectors(n, d, seed):
    """Clusters of different widths and lengths, with copies and a crowd in one place."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, d))
    v = centres[r.integers(0, 5, n)] + r.choice([0.01, 0.3, 2.0], (n, 1)) * r.standard_normal((n, d))
    v[: n // 3] = v[0]
    return [(int(i), [float(x) for x in row]) for i, row in zip(r.permutation(n), v)]


@pytest.mark.parametrize("n,d,page", [(30, 3, 4096), (700, 5, 64), (900, 16, 100)])
def test_metric_tree_equals_a_full_scan(spark, n, d, page):
    rows = _vectors(n, d, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = metric_tree.top_scores(df, k=7, query_every=9, page=page)
    assert sorted(map(tuple, got.collect())) == _best(rows, 7, 9)


def test_metric_tree_splits_queries_and_rings(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "QUERIES_A_TASK", 20)
    monkeypatch.setattr(metric_tree, "RINGS_AT_ONCE", 3)
    rows = _vectors(500, 4, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, metric_tree.top_scores(df, k=5, query_every=2, page=50).collect())) == _best(rows, 5, 2)


def test_metric_tree_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]),
            (6, [1.0]), (7, [1e30, -1e30]), (8, [-1.0, 2.0]), (8, [-1.0, 2.0]), (None, [5.0, 5.0]), (10, []), (100, [1.0, 2.0]), (200, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("page", F.lit(1))
    got = sorted(map(tuple, metric_tree.top_scores(df, k=3).collect()))
    cut = [(i, [max(-2.0**43, min(2.0**43, x)) if x is not None and math.isfinite(x) else x for x in v] if v else v) for i, v in rows]
    assert got == _best(cut, 3, 100)
    assert metric_tree.top_scores(df.limit(0)).collect() == []
    few = [r for r in got if r[0] == 100]
    assert [r[1] for r in few] == [1, 2, 3]


def test_metric_tree_visits_few_vectors(monkeypatch):
    """Bounds spare most of the vectors of a clustered page."""
    r = np.random.default_rng(1)
    v = np.floor(1024 * (r.standard_normal((40, 12))[r.integers(0, 40, 4000)] + 0.02 * r.standard_normal((4000, 12))))
    tree = metric_tree.Tree(np.arange(4000), v, *metric_tree.build(v).values())
    computed, plain = [], metric_tree.scores
    monkeypatch.setattr(metric_tree, "scores", lambda m, q: computed.append(len(m)) or plain(m, q))
    found = sorted(tree.search(-1, v[17], 10, None), reverse=True)
    assert [s for s, _ in found] == sorted((v @ v[17]).astype(int).tolist(), reverse=True)[:10]
    assert sum(computed) < 2000


# filter audit ---------------------------------------------------------------

def _audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for i, text, source in rows:
        text = text or ""
        w = cases.words(text)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 5 * len(text),
                 any(c in "#$%&*|" for c in text),
                 any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in rows)]
        docs.append((source or "", fails, i in good, i in bad))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(lost)
                out[part, "".join("ABCDE"[i] for i in order), step] = [
                    len(left), len(lost), sum(d[1][f] for d in mine) - len(lost), sum(d[1][f] and sum(d[1]) == 1 for d in mine),
                    sum(d[2] for d in lost), sum(d[3] for d in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley["ABCDE".index(order[step - 1])])
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit(spark):
    r = random.Random(5)
    rows = [(i, t if r.random() < 0.8 or t is None else t + r.choice([" # ", " ABCDEFGHIJ KLMNOP", " |"]), r.choice([None, "", "a", "b"]))
            for i, t in cases.rows()]
    rows += [(r.randrange(400), "the same text of many rows", r.choice("ab")) for _ in range(60)] + [(None, "twice", "b"), (None, "twice", "a")]
    labels = [(r.randrange(220), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1), (100000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit("x").alias(c) for c in ("part", "bits", "n", "copy", "good")))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("source", F.lit("x"))
    got = filter_audit.audit(docs.repartition(6), marks).collect()
    assert sorted(map(tuple, got)) == _audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_potentials_share_out_the_worth_of_all_filters():
    counts = np.random.default_rng(2).integers(0, 50, (9, 32))
    p = filter_audit.potentials(filter_audit.worths(counts))
    shares = sum(p[:, 31] - p[:, 31 ^ (1 << i)] for i in range(5))
    assert (shares == 120 * filter_audit.worths(counts)[:, 31]).all()


def test_a_long_text_is_judged_whole(spark):
    long_text = "word " * 900_000 + "#"
    docs = spark.createDataFrame([(1, long_text, "s"), (2, long_text, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.bits, r.n) for r in filter_audit.removal_counts(docs, labels).collect()} == {(0b01010, 1), (0b11010, 1)}


# Merkle manifest ------------------------------------------------------------

def _digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _row_leaf(doc_id, text, lang, source, n_chars):
    def value(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"
    return _digest([value(doc_id), value(source), value(lang), value(n_chars), value(text)])


def _climb(nodes):
    """Levels from the leaves to a single node."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_digest(out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _folded(tree, place, digest, proof):
    for level in tree[:-1]:
        run = list(level[place // 8 * 8:place // 8 * 8 + 8])
        proof += run[:place % 8] + run[place % 8 + 1:]
        run[place % 8] = digest
        digest, place = _digest(run), place // 8
    return digest


def _manifest(rows, tamper):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    order = sorted(groups, key=lambda g: g.encode())
    trees = {}
    for g in order:
        mine = sorted(((r[0] is not None, r[0] or 0, _row_leaf(*r)), r) for r in groups[g])
        trees[g] = (mine, _climb([key[2] for key, _ in mine]))
    top = _climb([trees[g][1][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        mine, tree = trees[g]
        for place, (key, r) in enumerate(mine):
            proof = []
            now = _folded(top, at, _folded(tree, place, _row_leaf(r[0], tamper(r[0], r[1]), *r[2:]), proof), proof)
            out.append((r[0], key[2], tree[-1][0], top[-1][0], _digest(proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def _lowered(doc_id, text):
    if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 3:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _tampered():
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))


_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _check_manifest(spark, rows, height=merkle.HEIGHT):
    df = spark.createDataFrame(rows, _DOCS).select("*", *(F.lit("x").alias(c) for c in ("grp", "pos", "digest", "changed", "block", "n", "leaf")))
    got = merkle.manifest(df.repartition(5), tampered=_tampered(), height=height).collect()
    assert sorted(map(tuple, got), key=repr) == _manifest(rows, _lowered)
    return got


def test_merkle_manifest_of_odd_rows(spark):
    rows = [(i, t, (None, "en", "de", "", "é")[k % 5], None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t))
            for k, (i, t) in enumerate(cases.rows())]
    got = _check_manifest(spark, rows + rows[:3])
    assert {r.verified for r in got} == {True, False}


def test_merkle_manifest_over_blocks_and_many_languages(spark):
    rows = [(i, f"Text {i}", "en" if i % 3 else f"l{i % 37:02d}", "s", i) for i in range(1300)]
    _check_manifest(spark, rows)
    _check_manifest(spark, rows[:700], height=1)


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_merkle_manifest_of_few_rows(spark, n):
    got = _check_manifest(spark, [(i, "A text", "en", None, 6) for i in range(n)])
    if n == 1:
        assert got[0].leaf == got[0].root == got[0].subroot and got[0].proof_sha256 == hashlib.sha256().hexdigest()


def test_merkle_manifest_without_tampering_verifies(spark):
    df = spark.createDataFrame([(i, "x" * (i % 5), "en", "s", 1) for i in range(100)], _DOCS)
    assert merkle.manifest(df).filter("verified").count() == 100


def test_a_parent_resumes_the_state_before_a_slot():
    run = [_digest([str(i)]) for i in range(8)]
    parent = merkle.Parent(run)
    for slot in range(8):
        assert parent.fold(slot, run[slot]) == parent.digest == _digest(run)
        assert parent.fold(slot, "00" * 32) == _digest([*run[:slot], "00" * 32, *run[slot + 1:]])
