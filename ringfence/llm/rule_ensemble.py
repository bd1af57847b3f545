"""Quality classifier: a sparse rule ensemble.

Small trees are grown on text statistics of a bounded labelled sample; every
path from a root is a conjunctive rule. A lasso-penalised logistic regression
over the rules (and nothing else) leaves few of them with a weight, and those
are compiled into one Spark column expression that scores all documents.

The statistics are counts per text from one Arrow pass over the bytes and
word hashes (Rabin-style, no language, source, id or label). Training is a
few numpy steps on the driver over at most ``max_rows`` x 14 numbers.

Defined cases: a null or empty text has all statistics 0 and is scored like
any other; without labelled rows every score is 0.5, with labels of one class
it is that class's smoothed share; every row gives a row, repeated or not;
a null id stays null and is not held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .labelled import held_out, with_labels
from .staging import bounded_batches

STATS = [f"stat_{s}" for s in (
    "n_words", "word_bytes", "short_words", "long_words", "symbols", "exclaims", "bars", "capitals", "digits", "points",
    "beyond_ascii", "same_as_previous", "distinct_words", "line_words")]
TRAIN_ROWS = 20_000
PREDICT_FROM = 0.3
_SYMBOL, _EXCLAIM, _BAR, _CAPITAL, _DIGIT, _POINT, _BEYOND, _LINE = range(1, 9)
_CLASS = np.zeros(256, np.int32)
for _signs, _kind in ((b"#*$%&<>", _SYMBOL), (b"!", _EXCLAIM), (b"|", _BAR), (b".,;:?", _POINT), (b"\n", _LINE)):
    _CLASS[list(_signs)] = _kind
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x80:] = _DIGIT, _CAPITAL, _BEYOND


def _statistics(batches, keep: list[str]):
    for chunk in ta.chunks(batches):
        data, offsets = ta.buffers(chunk.column("text"))
        n_docs = chunk.num_rows
        doc = np.repeat(np.arange(n_docs, dtype=np.int32) * 9, np.diff(offsets))
        signs = np.bincount(doc + _CLASS[data], minlength=9 * n_docs).reshape(n_docs, 9)
        s, e, before = ta.words(data, offsets)
        h = ta.span_hash(data, s, e)
        n = np.diff(before)
        doc = np.repeat(np.arange(n_docs), n)
        size = e - s
        same = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, bool)
        order = np.lexsort((h, doc))
        first = np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(h) else np.zeros(0, bool)

        def count(mask):
            return np.bincount(doc[mask], minlength=n_docs)

        words, length = np.maximum(n, 1), np.maximum(np.bincount(doc, size, n_docs), 1)
        values = [n, np.bincount(doc, size, n_docs) / words, count(size <= 3) / words, count(size >= 14) / words,
                  *(signs[:, k] / length for k in (_SYMBOL, _EXCLAIM, _BAR, _CAPITAL, _DIGIT, _POINT, _BEYOND)),
                  count(same) / words, np.bincount(doc[order][first], minlength=n_docs) / words, n / (signs[:, _LINE] + 1)]
        yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in keep), *(pa.array(v, pa.float64()) for v in values)], [*keep, *STATS])


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and ``STATS`` of every row."""
    keep = ["doc_id", *keep]
    rows = bounded_batches(docs).withColumn("doc_id", F.col("doc_id").cast("long")).select(*keep, *({"text"} - set(keep)))
    types = [f"`{c}` {t}" for c, t in rows.select(*keep).dtypes] + [f"{x} double" for x in STATS]
    return rows.mapInArrow(partial(_statistics, keep=keep), ", ".join(types))


Rule = tuple[tuple[str, float, bool], ...]  # (statistic, cut, True: above the cut)


@dataclass
class RuleEnsemble:
    """score = sigmoid(bias + the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        def holds(rule):
            return reduce(lambda a, b: a & b, [F.col(s) > cut if above else F.col(s) <= cut for s, cut, above in rule])

        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.bias))
        return 1.0 / (1.0 + F.exp(-total))


def _edges(x: np.ndarray, n: int = 31) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 2)[1:-1], method="lower"))


def _grow(x_bins, edges, g, h, rows, depth, path, rules, rng, update, rate):
    """Gradient tree; appends the rule of every node below the root."""
    def leaf():
        update[rows] += -rate * g[rows].sum() / (h[rows].sum() + 1.0)

    if depth == 0 or len(rows) < 40:
        return leaf()
    parent = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    best = (1e-6, None, None)
    for f in rng.permutation(len(edges))[: max(4, len(edges) * 2 // 3)]:
        k = len(edges[f])
        if not k:
            continue
        gs = np.cumsum(np.bincount(x_bins[rows, f], g[rows], k + 1))
        hs = np.cumsum(np.bincount(x_bins[rows, f], h[rows], k + 1))
        ns = np.cumsum(np.bincount(x_bins[rows, f], minlength=k + 1))
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - parent
        gain[(ns[:-1] < 15) | (ns[-1] - ns[:-1] < 15)] = 0
        c = int(gain.argmax())
        if gain[c] > best[0]:
            best = (gain[c], f, c)
    if best[1] is None:
        return leaf()
    _, f, c = best
    above = x_bins[rows, f] > c
    for side, flag in ((rows[~above], False), (rows[above], True)):
        rule = (*path, (STATS[f], float(edges[f][c]), flag))
        rules.append(rule)
        _grow(x_bins, edges, g, h, side, depth - 1, rule, rules, rng, update, rate)


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400):
    """Logistic lasso by accelerated proximal gradient; the bias is free."""
    n, k = a.shape
    w, z, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    a = np.hstack([a, np.ones((n, 1))])
    v = np.ones(k + 1)
    for _ in range(30):  # largest eigenvalue of the quadratic bound
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(float(v @ (a.T @ (a @ v))), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / t_new * (new - w), t_new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0, [])
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return RuleEnsemble(bias, [])
    rng = np.random.default_rng(seed)
    edges = [_edges(x[:, f]) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, rules = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        _grow(bins, edges, p - y, np.maximum(p * (1 - p), 1e-6), rows, depth, (), rules, rng, score, 0.3)
    at = {s: f for f, s in enumerate(STATS)}
    columns, kept, seen = [], [], set()
    for rule in dict.fromkeys(rules):
        holds = np.logical_and.reduce([(x[:, at[s]] > cut) == above for s, cut, above in rule])
        if 10 <= holds.sum() <= len(y) - 10 and (key := holds.tobytes()) not in seen:
            seen.add(key)
            columns.append(holds)
            kept.append(rule)
    if not kept:
        return RuleEnsemble(bias, [])
    a = np.stack(columns, axis=1).astype(np.float64)
    w, bias = _lasso(a, y.astype(np.float64), penalty)
    return RuleEnsemble(bias, [(r, float(v)) for r, v in zip(kept, w) if abs(v) > 1e-3])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = text_statistics(with_labels(rows, labels, target, max_rows), ("label",)).toPandas().sort_values("doc_id")
    return fit_rules(sample[STATS].to_numpy(np.float64), sample["label"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted and the columns
    ``keep``. The second reading of the texts computes statistics and score in
    one stage; nothing is shuffled."""
    model = train(docs, labels, "quality", max_rows)
    scored = text_statistics(docs, keep).select("doc_id", held_out("doc_id").alias("held_out"), model.score().alias("score"), *keep)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"), *keep)
