"""Personal data by weak supervision.

Base spans follow four fixed patterns. Around them, wider patterns propose
candidate spans (an address with an odd end, a number written without its
plus sign or run together with another, ...). Regex,
gazetteer and context labelers vote on every candidate: yes, no or nothing.
Expectation-maximisation over the counts of vote patterns, which Spark
gathers from all texts, estimates how reliable each labeler is and gives
every pattern a probability; a logistic span classifier is trained on these
probabilities with the spans' own features, and decides. Accepted candidates
that overlap no base span are added; base spans always stay.

Texts are read once. What stays is one row a text with its spans; the vote
patterns are a few hundred rows at any corpus size.

Defined cases: a null or empty text has no spans; every row gives a row,
repeated or not; a null id stays null; overlapping candidates are taken from
the left, the longer first; without candidates nothing is added; other
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .staging import bounded_batches, staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is never entered in its middle, which keeps the search linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Candidates beyond the base patterns. Runs are possessive: a text is scanned once.
_DOT = r"(?:\s?[\[(](?:dot|\.)[\])]\s?|\s\.\s|\.)"
_WIDE = {
    "email": re.compile(r"(?<!\S)[\w.%+-]++(?:@|\s?[\[(]at[\])]\s?)[\w-]++(?:(?:\.|\s?[\[(]dot[\])]\s?)[\w-]++)*+"),
    "ip": re.compile(rf"(?<![\w.])(?<!\s\.\s)(?<![\[(]\.[\])])[0-9]++(?:{_DOT}[0-9]++){{3}}(?::[0-9]++)?(?!\w)(?!{_DOT}[0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-])?(?:[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
# Words that announce a kind, in the corpus's languages, and frequent domain ends.
GAZETTEER = {
    "email": {"email", "e-mail", "mail", "contact", "write", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "server", "adresse", "dirección", "servidor", "serveur"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax", "cell", "telefon", "anruf", "movil", "llame", "appelez"},
}
DOMAIN_ENDS = {"com", "org", "net", "edu", "gov", "io", "co", "de", "fr", "es", "uk", "eu", "info", "biz"}
LABELERS = ("shape", "announced", "check", "context", "length")
FEATURES = ("bias", "email", "ip", "card", "phone", "digits", "groups", "has_parens", "issuer", "known_end", "announced", "near_number", "long")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    """At most 255; leading zeros don't count, however many there are."""
    return int(part[-18:]) <= 255 and not part[:-18].strip("0")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # the pattern's only way to match: the whole run of local signs before an @
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


_LOCAL_SET, _DIGITS = frozenset(_LOCAL), frozenset("0123456789")


def _votes_and_features(text: str, kind: str, start: int, end: int):
    """One vote of each labeler (1, -1 or 0) and the span's features."""
    span = text[start:end]
    digits = "".join(c for c in span if c in _DIGITS)
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40):start])[-3:]
    announced = any(w.lower() in GAZETTEER[kind] for w in before)
    around = text[max(0, start - 12):start] + text[end:end + 12]
    near_number = any(c in _DIGITS for c in around)
    groups = len(re.findall(r"[0-9]+", span))
    known_end = kind == "email" and span.rsplit(".", 1)[-1].lower() in DOMAIN_ENDS
    plain_edges = (start == 0 or text[start - 1].isspace()) and (end == len(text) or text[end].isspace() or text[end] in ".,;:!?")
    if kind == "email":
        shape = 1 if "@" in span and "." in span.split("@")[-1] else -1
        check = 1 if known_end else -1
        length = 1 if 6 <= len(span) <= 64 else -1
    elif kind == "ip":
        shape = 1 if len({x.strip() for x in re.findall(r"[^0-9:]+", span)}) == 1 else -1  # one kind of dots
        check = 1 if ":" in span or "[" in span or "(" in span else -1
        length = 1 if 7 <= len(span) <= 40 else -1
    elif kind == "card":
        shape = 1 if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}", span) else -1
        check = 1 if digits[0] in "3456" else -1  # the issuers' first digits
        length = 1 if 13 <= len(digits) <= 19 else -1
    else:
        shape = 1 if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span) else -1 if "." in span else 0
        check = 1 if "(" in span and ")" in span else 0
        length = 1 if 9 <= len(digits) <= 13 else -1
    votes = (shape, 1 if announced else 0, check, (1 if plain_edges else -1) if not near_number else -1, length)
    features = (1.0, kind == "email", kind == "ip", kind == "card", kind == "phone", len(digits) / 16, groups / 4, "(" in span,
                kind == "card" and digits[0] in "3456", known_end, announced, near_number, len(span) > 24)
    return votes, [float(f) for f in features]


def candidates(text: str, base) -> list[tuple[str, int, int]]:
    """Proposed spans that overlap no base span, from the left, the longer first."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _WIDE.items():
        if kind == "email" and "@" not in text and "at]" not in text and "at)" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "ip" and not all(_octet(p) for p in re.findall(r"[0-9]+", m.group())[:4]):
                continue
            if kind != "card" or luhn("".join(c for c in m.group() if c in _DIGITS)):  # no card without its check digit
                found.append((m.start(), -m.end(), kind))
    taken, out = sorted((s, e) for _, s, e in base), []
    starts = [s for s, _ in taken]
    last = 0
    for start, minus_end, kind in sorted(found):
        end = -minus_end
        i = int(np.searchsorted(starts, end)) if starts else 0
        if start < last or any(e > start for _, e in taken[max(0, i - 4):i]):
            continue
        out.append((kind, start, end))
        last = end
    return out


_ROW = ("doc_id long, base array<struct<kind:int,start:int,end:int>>, "
        "proposed array<struct<kind:string,start:int,end:int,votes:string,features:array<double>>>")
_BASE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_PROPOSED_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                     ("votes", pa.string()), ("features", pa.list_(pa.float64()))]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("base", _BASE_TYPE), ("proposed", _PROPOSED_TYPE)])
_MARKS = np.zeros(256, bool)
_MARKS[[*b"0123456789@[("]] = True


def _marked(texts: pa.Array) -> np.ndarray:
    """False: no pattern can match."""
    data, offsets = ta.buffers(texts)
    return np.diff(np.append(0, np.cumsum(_MARKS[data]))[offsets]) > 0


def _label(batches):
    for chunk in ta.chunks(batches):
        marked = _marked(chunk.column("text"))
        base, proposed = [[] for _ in marked], [[] for _ in marked]
        for i in np.flatnonzero(marked):
            text = chunk.column("text")[int(i)].as_py()
            spans = base_spans(text)
            base[i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            for kind, s, e in candidates(text, spans):
                votes, features = _votes_and_features(text, kind, s, e)
                proposed[i].append({"kind": kind, "start": s, "end": e, "votes": ",".join(map(str, votes)), "features": features})
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(base, _BASE_TYPE), pa.array(proposed, _PROPOSED_TYPE)], schema=_SCHEMA)


def estimate(patterns: dict[str, int], rounds: int = 100):
    """Expectation-maximisation over vote patterns: (probability of each
    pattern, reliability of each labeler). A labeler that votes is right with
    its reliability, on either class; the start trusts all labelers alike."""
    keys = list(patterns)
    if not keys:
        return {}, np.zeros(0)
    votes = np.array([[int(v) for v in k.split(",")] for k in keys])
    count = np.array([patterns[k] for k in keys], np.float64)
    right, prior = np.full(votes.shape[1], 0.7), 0.5
    p = np.full(len(keys), 0.5)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (votes * np.log(right / (1 - right))).sum(axis=1)
        new = 1 / (1 + np.exp(-odds))
        agree = np.where(votes > 0, new[:, None], 1 - new[:, None]) * (votes != 0) * count[:, None]
        # two pseudo-votes at the start value keep a rarely voting labeler in range
        right = np.clip((agree.sum(axis=0) + 1.4) / (((votes != 0) * count[:, None]).sum(axis=0) + 2), 0.51, 0.99)
        prior = float(np.clip((new * count).sum() / count.sum(), 0.02, 0.98))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(keys, p.tolist())), right


def fit_spans(features: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights for soft targets, by Newton's method."""
    w = np.zeros(features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hess = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, features.T @ (weight * (p - target)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans and proposed spans with votes and features; written once."""
    return staged(bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_label, _ROW), "labelled-spans")


def train(rows: DataFrame, sample_rows: int = 20_000) -> np.ndarray:
    """Weights of the span classifier. It is fitted on at most ``sample_rows``
    distinct (votes, features) rows with their counts, the most frequent
    first; the labelers' reliabilities come from the counts of all."""
    each = rows.select(F.explode("proposed").alias("c"))
    patterns = {r["votes"]: r["n"] for r in each.groupBy(F.col("c.votes").alias("votes")).agg(F.count("*").alias("n")).collect()}
    belief, _ = estimate(patterns)
    shapes = (each.groupBy(F.col("c.votes").alias("votes"), F.col("c.features").alias("features")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "votes", F.col("features").cast("string")).limit(sample_rows).collect())
    if not shapes:
        return np.zeros(len(FEATURES))
    return fit_spans(np.array([r["features"] for r in shapes]), np.array([belief[r["votes"]] for r in shapes]),
                     np.array([r["n"] for r in shapes], np.float64))


def _cut(accept: float) -> float:
    return float(np.log(accept / (1 - accept)))


def find_spans(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, base and all, arrays of (kind, start, end)
    with kind a number in ``KINDS``, ordered by kind and start."""
    rows = labelled(docs)
    weights = train(rows)

    def logit(c):
        return sum((F.get(c["features"], i) * float(w) for i, w in enumerate(weights)), F.lit(0.0))

    added = F.transform(
        F.filter("proposed", lambda c: logit(c) > _cut(accept)),
        lambda c: F.struct((F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]) - 1).cast("int").alias("kind"),
                           c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", added)).alias("all"))


def spans_text(spans):
    """``kind:start:end`` of each span, joined by commas, as a Column."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every (kind, start, end) replaced by its kind in brackets; of overlapping spans the first from the left names it."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], "[", KINDS[kind].upper(), "]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _mask(batches, weights: np.ndarray, cut: float):
    for chunk in ta.chunks(batches):
        texts = chunk.column("text").to_pylist()
        for i in np.flatnonzero(_marked(chunk.column("text"))):
            spans = base_spans(texts[i])
            for kind, start, end in candidates(texts[i], spans):
                if np.dot(weights, _votes_and_features(texts[i], kind, start, end)[1]) > cut:
                    spans = [*spans, (KINDS.index(kind), start, end)]
            if spans:
                texts[i] = mask_text(texts[i], spans)
        yield chunk.set_column(chunk.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def masked(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """``docs`` with every span found in text replaced by its kind in brackets
    (a null text stays null). Texts are read twice and never shuffled."""
    weights = train(labelled(docs))
    return docs.mapInArrow(partial(_mask, weights=weights, cut=_cut(accept)), docs.schema)
