"""Toxicity: a counterfactual-regularised classifier over word features.

Features are the presence of a word and of its four-, five- and six-byte
beginnings. From a bounded labelled sample the features most associated with
the label (either way) are chosen, and a logistic model is fitted by Newton's
method with an extra penalty: in every labelled text that names identity
groups the identity terms are swapped for their counterparts, and the squared
change of the score (its logit) is penalised. The model can thus not lean on
a group being mentioned. Scoring is one Arrow pass over whole texts with the
few chosen features; nothing is shuffled.

Defined cases: a null or empty text has no features and gets the model's base
score; without labelled rows every score is 0.5, with labels of one class it
is that class's smoothed share; every row gives a row, repeated or not; a
null id stays null and is not held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .labelled import held_out, with_labels
from .staging import bounded_batches

TRAIN_ROWS = 8_000
FEATURES = 256
BEGINNINGS = (4, 5, 6)
# Identity terms with the term they are swapped for.
IDENTITY_PAIRS = [
    ("man", "woman"), ("men", "women"), ("he", "she"), ("his", "her"), ("him", "her"), ("boy", "girl"), ("boys", "girls"),
    ("male", "female"), ("father", "mother"), ("son", "daughter"), ("husband", "wife"), ("christian", "muslim"),
    ("christians", "muslims"), ("jew", "buddhist"), ("jewish", "hindu"), ("jews", "hindus"), ("black", "white"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("african", "european"), ("mexican", "american"), ("asian", "western"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("blind", "sighted"), ("deaf", "hearing"),
    ("homme", "femme"), ("hommes", "femmes"), ("mann", "frau"), ("hombre", "mujer"), ("hombres", "mujeres"),
]
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def _features(data, starts, ends) -> np.ndarray:
    """Feature hashes of each word: itself and its beginnings (0: too short)."""
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.uint64)
    out[:, 0] = ta.span_hash(data, starts, ends, lower=True)
    for k, n in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(ends - starts >= n)
        if len(long):
            out[long, k] = ta.span_hash(data, starts[long], starts[long] + n, lower=True) ^ np.uint64(n)
    return out


def _word_features(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return _features(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]), ends)


def _swaps():
    """(word hash ascending, features of its counterpart)."""
    both = dict(IDENTITY_PAIRS) | {b: a for a, b in reversed(IDENTITY_PAIRS)}
    key = _word_features(list(both))[:, 0]
    order = np.argsort(key)
    return key[order], _word_features(list(both.values()))[order]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.unique(x)
    return x[x != 0]


_SAMPLE = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("features", pa.binary()), ("swapped", pa.binary())])


def _sample_features(batches):
    """Distinct features of a text, and of the same text with identity terms swapped (null: none in it)."""
    key, other = _swaps()
    for chunk in ta.chunks(batches):
        data, offsets = ta.buffers(chunk.column("text"))
        s, e, before = ta.spans_where(_LETTER[data], offsets)
        f = _features(data, s, e)
        at = np.minimum(np.searchsorted(key, f[:, 0]), len(key) - 1)
        hit = key[at] == f[:, 0]
        swapped = np.where(hit[:, None], other[at], f)
        own, turned = [], []
        for a, b in zip(before[:-1], before[1:]):
            own.append(_distinct(f[a:b]).tobytes())
            turned.append(_distinct(swapped[a:b]).tobytes() if hit[a:b].any() else None)
        yield pa.RecordBatch.from_arrays([chunk.column("label").cast(pa.int32()), chunk.column("doc_id"), pa.array(own, pa.binary()),
                                          pa.array(turned, pa.binary())], schema=_SAMPLE)


@dataclass
class ToxicModel:
    bias: float
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _choose(labels, features, n: int) -> np.ndarray:
    """The ``n`` features with the largest log-likelihood ratio."""
    flat = np.concatenate(features)
    if not len(flat):
        return np.zeros(0, np.uint64)
    doc_label = np.repeat(labels, [len(f) for f in features])
    order = np.argsort(flat, kind="stable")
    flat, doc_label = flat[order], doc_label[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    total = np.diff(np.append(at, len(flat)))
    ones = np.add.reduceat(doc_label, at)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    gain = np.zeros(len(at))
    for have, of in ((ones, n1), (total - ones, n0)):
        for count, whole in ((have, total), (of - have, len(labels) - total)):
            expected = np.maximum(of * whole / len(labels), 1e-12)
            gain += np.where(count > 0, count * np.log(np.maximum(count, 1e-12) / expected), 0)
    gain[total < 5] = 0
    best = np.argsort(-gain, kind="stable")[:n]
    return np.sort(flat[at][best[gain[best] > 6]])


def _matrix(chosen, features) -> np.ndarray:
    x = np.zeros((len(features), len(chosen)))
    for i, f in enumerate(features):
        at = np.searchsorted(f, chosen)
        ok = at < len(f)
        x[i, ok] = f[at[ok]] == chosen[ok]
    return x


def fit_toxic(labels, features, swapped, n_features: int = FEATURES, ridge: float = 1.0, fairness: float = 5.0) -> ToxicModel:
    """``features``, ``swapped``: sorted distinct hashes of each text (``swapped`` may hold None)."""
    labels = np.asarray(labels, np.float64)
    if not len(labels):
        return ToxicModel(0.0)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    chosen = _choose(labels, features, n_features) if labels.min() != labels.max() else np.zeros(0, np.uint64)
    if not len(chosen):
        return ToxicModel(bias)
    x = _matrix(chosen, features)
    changed = [i for i, s in enumerate(swapped) if s is not None]
    delta = x[changed] - _matrix(chosen, [swapped[i] for i in changed]) if changed else np.zeros((0, len(chosen)))
    a = np.hstack([x, np.ones((len(x), 1))])
    quad = np.zeros((a.shape[1], a.shape[1]))
    quad[:-1, :-1] = ridge * np.eye(len(chosen)) + 2 * fairness * delta.T @ delta
    w = np.zeros(a.shape[1])
    w[-1] = bias
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + quad + 1e-9 * np.eye(len(w)), a.T @ (p - labels) + quad @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return ToxicModel(float(w[-1]), chosen, w[:-1])


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(batches, model: ToxicModel):
    for chunk in ta.chunks(batches):
        total = np.full(chunk.num_rows, model.bias)
        if len(model.features):
            data, offsets = ta.buffers(chunk.column("text"))
            s, e, before = ta.spans_where(_LETTER[data], offsets)
            doc = np.repeat(np.arange(chunk.num_rows), np.diff(before))
            pairs = []
            for column in _features(data, s, e).T:
                at = np.minimum(np.searchsorted(model.features, column), len(model.features) - 1)
                hit = np.flatnonzero(model.features[at] == column)
                pairs.append(doc[hit] * len(model.features) + at[hit])
            seen = np.unique(np.concatenate(pairs))
            total += np.bincount(seen // len(model.features), model.weights[seen % len(model.features)], chunk.num_rows)
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], schema=_SCORE)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = TRAIN_ROWS) -> ToxicModel:
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = (with_labels(rows, labels, target, max_rows).select("doc_id", "text", "label")
              .mapInArrow(_sample_features, "label int, doc_id long, features binary, swapped binary").toArrow().sort_by("doc_id"))
    features = [np.frombuffer(x, np.uint64) for x in sample["features"].to_pylist()]
    swapped = [None if x is None else np.frombuffer(x, np.uint64) for x in sample["swapped"].to_pylist()]
    return fit_toxic(sample["label"].to_numpy(), features, swapped)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels, "toxic", max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(partial(_score, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
