"""Pipeline stages against plain re-statements of their rules."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

from . import cases
from .test_text_operators import shingles

SF = "/root/testdata/sf0.001"


def near_groups(pairs, width=5, percent=80):
    """Index of the group of each (doc_id, text); texts without words stand alone."""
    sets = [shingles(t, width) for _, t in pairs]
    group = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and group[a] != group[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    group = [group[b] if g == group[a] else g for g in group]
    return group


def similarity(a, b, width=5):
    a, b = shingles(a, width), shingles(b, width)
    return len(a & b) / len(a | b)


def near_texts():
    """Originals, each with a copy whose last block is replaced, cut or added
    to (similarity 0.8 to 0.9) and one just below 0.8."""
    r = random.Random(21)
    out = []
    for kind in range(12):
        w = [f"k{kind}w{r.randrange(5000)}" for _ in range(200)]
        new = [f"n{kind}x{j}" for j in range(60)]
        near = [w[:185] + new[:15], w[:170], w + new[:40]][kind % 3]
        out += [w, near, w[:150] + new[:50]]
    return [" ".join(w) for w in out]


def test_near_duplicates_link_from_five_words_and_four_fifths(spark):
    texts = near_texts()
    assert all(0.8 <= similarity(a, b) < 0.9 for a, b in zip(texts[::3], texts[1::3]))
    assert all(similarity(a, b) < 0.8 for a, b in zip(texts[::3], texts[2::3]))
    odd = [t for t in cases.texts(seed=5)]
    pairs = list(enumerate(texts + odd))
    group, first = near_groups(pairs), {}
    for (i, _), g in zip(pairs, group):
        first.setdefault(g, i)
    got = corpus_pipeline.near_duplicates(spark, cases.frame(spark, pairs), SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(first.values())
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in pairs if i in first.values()}


def cut_text(text, covered):
    """``text`` without its maximal runs of covered words."""
    spans, out, at = [m.span() for m in cases.WORD.finditer(text)], "", 0
    for k, (a, b) in enumerate(spans):
        if covered[k]:
            if k == 0 or not covered[k - 1]:
                out += text[at:a]
            at = b
    return out + text[at:]


def covered_words(pairs, width=13):
    """Per pair of distinct, non-null ids: which words an earlier document's windows cover."""
    seen, out = set(), {}
    for i, t in sorted(pairs):
        w = cases.words(t)
        grams = [tuple(w[k:k + width]) for k in range(len(w) - width + 1)]
        out[i] = [any(g in seen for g in grams[max(0, k - width + 1):k + 1]) for k in range(len(w))]
        seen.update(grams)
    return out


def test_substring_stage_keeps_white_space(spark):
    r = random.Random(14)
    passage = "\n".join(f"p{k} é{k}" for k in range(10))
    pairs = [(i, t) for i, t in enumerate(cases.texts(seed=8))]
    pairs += [(500, f"\n first\tline  \n\n{passage}\n last \r\n"), (501, f"4111 1111\n{passage}\n1111 1111"), (502, passage),
              (503, f"{passage}\n\n{passage} x\n"), (504, "card 4111 1111\n1111 1111 and\n  no\u00a0repeat\n"), (505, None), (506, ""), (507, " \n")]
    for i in range(600, 640):
        lines = [" ".join(f"{r.choice('abcdef')}{r.randrange(900)}" for _ in range(r.randrange(1, 9))) for _ in range(12)]
        pairs.append((i, r.choice(["\n", "\r\n", "\n\n  "]).join(lines)))
    covered = covered_words(pairs)
    expected = {i: None if t is None else cut_text(t, covered[i]) for i, t in pairs}
    assert expected[500] == pairs[-48][1] and "4111 1111\n\n1111 1111" == expected[501] and expected[502] == ""
    got = corpus_pipeline.repeated_passages(spark, cases.frame(spark, pairs), SF).collect()
    assert {x.doc_id: x.text for x in got} == expected and len(got) == len(pairs)
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in got)
    assert {i: t for i, t in pairs if not any(covered[i])}.items() <= {x.doc_id: x.text for x in got}.items()


@pytest.mark.parametrize("parts", [1, 7])
def test_near_duplicates_with_null_and_repeated_ids(spark, parts):
    r = random.Random(31)

    def text(tag):
        return " ".join(f"{tag}{r.randrange(9000)}" for _ in range(60))

    copied, near = text("c"), text("d")
    pairs = [(None, text(f"n{k}")) for k in range(20)]
    pairs += [(1, copied), (9, copied), (9, text("u")), (2, near), (None, near + " x"), (None, copied), (12, text("v")), (12, text("w"))]
    pairs += [(30, text("a"))] * 3 + [(None, text("b"))] * 2 + [(None, None), (None, None), (None, ""), (40, ""), (41, "")]
    group, best = near_groups(pairs), {}
    for (i, t), g in zip(pairs, group):
        key = g if cases.words(t) else (i, t)
        best.setdefault(key, set()).add((i is None, i or 0, t or "", i, t))
    expected = [min(rows, key=lambda x: x[:2]) for rows in best.values()]
    got = corpus_pipeline.near_duplicates(spark, cases.frame(spark, pairs).repartition(parts), SF).collect()
    assert cases.as_multiset([(x.doc_id, x.text) for x in got]) == cases.as_multiset([x[3:] for x in expected])
    assert sum(x.doc_id is None and bool(x.text) for x in got) == 21 and sum(x.doc_id == 9 for x in got) == 1
