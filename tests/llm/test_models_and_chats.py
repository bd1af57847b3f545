"""Classifiers, chat formatting and nearest neighbours."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ringfence.llm import ann_codes, chat_format, rule_ensemble, toxicity

from . import cases

BAD_WORDS = ["idiot", "moron", "clown"]


def labelled_corpus(n=900):
    r, vocab = random.Random(11), cases.vocabulary(300)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        toxic, junk = r.random() < 0.2, r.random() < 0.2
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(BAD_WORDS))
        if junk:
            w = [x + r.choice(["$$$", "***"]) for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("target", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, target):
    docs, labels = labelled_corpus()
    df = cases.frame(spark, [*docs, *cases.rows()[:40]]) if target == "quality" else cases.frame(spark, docs)
    extra = [(None, 1, 1), (3, None, None), (99999, 1, 0)]
    label_df = spark.createDataFrame([*labels, *labels[:5], *extra], "doc_id long, quality int, toxic int")
    score = rule_ensemble.quality_scores if target == "quality" else toxicity.toxicity_scores
    got = score(df, label_df).collect()
    assert len(got) == df.count() and all(0 <= x.score <= 1 for x in got)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert x.predicted == int(x.score >= (0.3 if target == "quality" else 0.5))
    truth = {i: q if target == "quality" else t for i, q, t in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth and (target == "toxic" or (x.doc_id, ) and x.doc_id > 211)]
    right = sum(x.predicted == truth[x.doc_id] for x in held) / len(held)
    assert right >= 0.97, right
    assert score(df.limit(0), label_df).count() == 0
    for none in (label_df.limit(0), label_df.filter(f"{target} = 1")):
        flat = {x.score for x in score(df, none).collect()}
        assert len(flat) == 1


def test_scores_do_not_see_metadata(spark):
    docs, labels = labelled_corpus(300)
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    df = cases.frame(spark, docs, clashing=False)
    changed = df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("other")).withColumn("n_chars", F.lit(-1).cast("long"))
    for score in (rule_ensemble.quality_scores, toxicity.toxicity_scores):
        assert {(r.doc_id, r.score) for r in score(df, label_df).collect()} == {(r.doc_id, r.score) for r in score(changed, label_df).collect()}


def test_rules_are_conjunctions_of_statistics():
    r = np.random.default_rng(2)
    x = r.random((2000, len(rule_ensemble.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = rule_ensemble.fit_rules(x, y)
    at = {s: i for i, s in enumerate(rule_ensemble.STATS)}
    total = np.full(len(x), model.bias)
    for rule, weight in model.rules:
        total += weight * np.logical_and.reduce([(x[:, at[s]] > c) == above for s, c, above in rule])
    assert ((total > 0) == (y > 0)).mean() > 0.98 and 0 < len(model.rules) < 120


def test_swapped_identity_terms_keep_the_score():
    """Labels that lean on a group are not learned when swaps are penalised."""
    r = random.Random(5)
    data, labels = [], []
    for i in range(600):
        group = r.choice(["man", "woman"])
        toxic = r.random() < (0.5 if group == "woman" else 0.1)
        w = [f"x{r.randrange(80)}" for _ in range(12)] + [group]
        if toxic and r.random() < 0.8:
            w.append("idiot")
        data.append(w)
        labels.append(int(toxic))
    key, other = toxicity._swaps()
    features, swapped = [], []
    for w in data:
        f = toxicity._word_features(w)
        at = np.minimum(np.searchsorted(key, f[:, 0]), len(key) - 1)
        hit = key[at] == f[:, 0]
        features.append(toxicity._distinct(f))
        swapped.append(toxicity._distinct(np.where(hit[:, None], other[at], f)))

    def gap(model):
        def logit(words):
            f = toxicity._distinct(toxicity._word_features(words))
            return model.weights[np.isin(model.features, f)].sum()
        return abs(logit(["the", "woman"]) - logit(["the", "man"])), logit(["idiot"])

    plain, fair = (gap(toxicity.fit_toxic(labels, features, swapped, fairness=v)) for v in (0.0, 5.0))
    assert plain[0] > 1 > 0.3 > fair[0] and fair[1] > 1.5


def records():
    import json

    return [(1, 0, {"role": "user", "text": "hi"}), (1, 1, {"role": "assistant", "text": None}), (1, 1, {"role": "assistant", "text": "b"}),
            (2, 0, {"prompt": "p", "response": "r", "extra": 1}), (3, 0, {"instruction": "i", "input": "x", "output": "o"}),
            (4, 0, {"messages": [{"role": "system", "content": "s"}, {"role": "assistant", "content": "a <|im_end|>\n b"}]}),
            (5, 0, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "z"}]}),
            (6, None, {"role": None, "text": "nobody"}), (None, 0, {"role": "user", "text": "no id"}), (8, 0, {"unknown": 1}),
            (9, 0, {"role": "a\nb\\", "text": "c"}), (2, 1, {"data": {"messages": [{"role": "user", "content": "deep"}]}})], json.dumps


def test_chat_layouts(spark):
    data, dump = records()
    df = spark.createDataFrame([*((c, t, dump(r), "clash") for c, t, r in data), (8, 1, "{broken", ""), (8, 2, None, "")],
                               "conv_id long, turn long, record string, formatted string")
    pieces = chat_format.format_chats(df)
    turns = {}
    for r in pieces.orderBy("piece").collect():
        turns.setdefault(r.conv_id, []).extend(chat_format.parse(r.formatted))
    assert turns == {1: [("user", "hi"), ("assistant", ""), ("assistant", "b")], 2: [("user", "p"), ("assistant", "r"), ("user", "deep")],
                     3: [("user", "i"), ("user", "x"), ("assistant", "o")], 4: [("system", "s"), ("assistant", "a <|im_end|>\n b")],
                     5: [("user", "q"), ("assistant", "z")], 6: [("", "nobody")], None: [("user", "no id")], 9: [("a\nb\\", "c")]}
    assert sorted((r.conv_id, r.turn) for r in chat_format.unmatched(df).collect()) == [(8, 0), (8, 1), (8, 2)]
    back = {r.conv_id: r for r in chat_format.read_back(pieces).collect()}
    loss = "".join(t for r, t in turns[4] if r == "assistant")
    assert back[4].loss_chars == len(loss) and back[4].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert back[1].n_turns == 3 and back[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\nb\n").hexdigest()
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", 200)
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i} [INST] \\ </s>") for i in range(100)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = list(chat_format._join_pieces(iter(())))
    assert rows == []
    pieces = chat_format.format_chats(chat_format.turn_records(df))
    back = chat_format.read_back(pieces).collect()
    loss = "".join(t[3] for t in turns if t[2] == "assistant")
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in back] == [(100, len(loss), hashlib.sha256(loss.encode()).hexdigest())]


def test_template_is_reversible():
    r = random.Random(5)
    signs = ["\\", "<", "|", "im_start", "im_end", "|>", "</s>", "<s>", "[INST]", "[/INST]", "\n", "a", " ", "<|im_end|>\n", "<|im_start|>user\n", "é"]
    for _ in range(5000):
        turns = [tuple("".join(r.choice(signs) for _ in range(r.randint(0, n))) for n in (4, 8)) for _ in range(r.randint(0, 4))]
        assert chat_format.parse("".join(chat_format.render(*t)[0] for t in turns)) == turns
        assert not any(c in chat_format.escape(t) for _, t in turns for c in chat_format.CONTROL)


def brute_nearest(data, k, every):
    found = {}
    for i, v in sorted((i, v) for i, v in data if i % every == 0):
        scores = ann_codes.exact_scores(np.array([w for _, w in data]), np.array(v))
        order = sorted(((-s, j) for s, (j, _) in zip(scores, data) if j != i))[:k]
        found[i] = [(j, -s) for s, j in order]
    return found


def test_nearest_neighbours(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 32))
    good = [(i, (centres[i % 12] + 0.5 * r.standard_normal(32)).astype(np.float32).astype(float).tolist()) for i in range(800)]
    good += [(800 + i, good[0][1]) for i in range(60)]  # one very common vector: ties
    odd = [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [1.0] * 5), (2080, [None] + [1.0] * 31), (None, [1.0] * 32), (2100, [float("inf")] * 32)]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*good, *odd, good[3]]], "vec_id long, embedding array<float>, block string")
    got = {}
    for x in ann_codes.nearest(df, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    expected = brute_nearest(good, 20, 20)
    assert got.keys() == expected.keys()
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in expected[q]}) for q in expected)
    assert hits >= 0.98 * 20 * len(expected)
    assert all(got[q] == expected[q] for q in expected if {j for j, _ in got[q]} == {j for j, _ in expected[q]})
    few = ann_codes.nearest(spark.createDataFrame(good[:6], "vec_id long, embedding array<float>"), k=20).collect()
    assert len(few) == 5 and {x.query_id for x in few} == {0}
    assert ann_codes.nearest(df.limit(0)).count() == 0


def test_nearest_neighbours_over_many_blocks(spark, monkeypatch):
    """Vectors and queries in several blocks each, queries in several slices: recall against brute force."""
    monkeypatch.setattr(ann_codes, "BLOCK", 500)
    monkeypatch.setattr(ann_codes, "QUERY_BLOCK", 150)
    r = np.random.default_rng(8)
    data = [(i, r.standard_normal(48).tolist()) for i in range(2400)]
    data += [(2400 + i, data[8][1]) for i in range(200)]  # a large group of copies, in every block
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for x in ann_codes.nearest(df, k=20, query_every=5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    expected = brute_nearest(data, 20, 5)
    assert got.keys() == expected.keys() and len(got) == 520 and all(len(x) == 20 for x in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in expected[q]}) for q in expected)
    assert hits >= 0.95 * 20 * len(expected)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def test_quality_scores_by_plain_python(spark):
    """The scores again from the rules, with the statistics counted text by text."""
    docs, labels = labelled_corpus(500)
    df = cases.frame(spark, [*docs, *cases.rows()[:40]], clashing=False)
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = rule_ensemble.train(df, label_df)
    assert len(model.rules) > 3

    def statistics(text):
        data = (text or "").encode()
        words = [w for w in re.split(rb"[\x20\t-\r]+", data) if w]
        n, size = max(len(words), 1), max(sum(map(len, words)), 1)
        signs = [sum(c in group for c in data) for group in (b"#*$%&<>", b"!", b"|")]
        capitals, digits = (len(re.findall(p, data)) for p in (rb"[A-Z]", rb"[0-9]"))
        points, beyond = (len(re.findall(p, data)) for p in (rb"[.,;:?]", rb"[\x80-\xff]"))
        return dict(zip(rule_ensemble.STATS, [
            len(words), sum(map(len, words)) / n, sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 14 for w in words) / n,
            *(x / size for x in (*signs, capitals, digits, points, beyond)),
            sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, len(words) / (data.count(b"\n") + 1)]))

    def score(text):
        s = statistics(text)
        return _sigmoid(model.bias + sum(w for rule, w in model.rules if all((s[f] > cut) == above for f, cut, above in rule)))

    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rule_ensemble.quality_scores(df, label_df).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, score(r.text)) for r in df.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.abs(np.array([x[2] for x in got]) - [x[2] for x in want]).max() < 1e-9


def test_toxicity_scores_by_plain_python(spark):
    """The scores again as bias plus the weights of the distinct features of a text."""
    docs, labels = labelled_corpus(500)
    df = cases.frame(spark, [*docs, *cases.rows()[:40]], clashing=False)
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, label_df)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert len(weights) > 2

    def score(text):
        data, words, now = (text or "").encode(), [], b""
        for c in data + b" ":
            if toxicity._LETTER[c]:
                now += bytes([c])
            elif now:
                words, now = [*words, now], b""
        if not words:
            return _sigmoid(model.bias)
        ends = np.cumsum([len(w) for w in words])
        features = toxicity._features(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)
        return _sigmoid(model.bias + sum(weights.get(f, 0.0) for f in {int(x) for x in features.ravel()}))

    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in toxicity.toxicity_scores(df, label_df).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, score(r.text)) for r in df.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.abs(np.array([x[2] for x in got]) - [x[2] for x in want]).max() < 1e-9
