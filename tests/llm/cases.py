"""Small inputs shared by the operator tests, and plain re-statements of the rules."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# names that operators use inside; a table may have them as columns of its own
CLASHING = ["n_words", "token", "cls", "key", "hashes", "ids", "bin", "part", "score", "label", "words", "grams", "base", "piece", "stat_n_words"]


def words(text):
    return WORD.findall(text or "")


def vocabulary(n=60, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(["th", "er", "on", "an", "re", "lo", "mi", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def texts(n=60, seed=2):
    """Random texts with exact copies, near copies, shared passages and odd ones."""
    r, vocab = random.Random(seed), vocabulary()
    passage = " ".join(r.choice(vocab) for _ in range(30))
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append(r.choice(out))
        elif out and kind < 0.35:
            w = words(r.choice(out))
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
        else:
            body = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 12, 13, 40, 80, 200]))]
            if kind > 0.8:
                body.insert(r.randrange(len(body) + 1), passage)
            out.append(r.choice([" ", "\n", "  \t"]).join(body))
    return [*out, None, "", "   \n ", "one", "Two words", "A b C", "a B c", "word " * 3000, "x" * 20000, "  nbsp stays"]


def rows(seed=2):
    """(doc_id, text): repeated ids, repeated rows and a null id among them."""
    all_texts = texts(seed=seed)
    out = [(i * 3 % 211, t) for i, t in enumerate(all_texts)]
    return [*out, out[5], (out[7][0], "another text of the same id " * 9), (None, all_texts[10]), (None, None)]


def frame(spark, pairs, clashing=True):
    """A documents table: all columns, some null, and clashing extra ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, None if k % 7 == 0 else ("en", "de")[k % 2], None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t))
            for k, (i, t) in enumerate(pairs)]
    df = spark.createDataFrame(data, schema)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    return df.repartition(5)


def as_multiset(rows_):
    return sorted(rows_, key=repr)
