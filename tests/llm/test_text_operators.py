"""Operators on documents against plain re-statements of their rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ringfence.llm import bpe_codec, jaccard_join, packing, pii_spans, quality_rules, substring_dedup
from ringfence.llm import components as linked
from ringfence.llm import text_arrays as ta

from . import cases


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["<|endoftext|> hi<|startoftext|>", "It's we've I'll THE'S ''s !'s 'st x'y 123 a1b2", "ΑΣ Σσς ΟΔΟΣ İstanbul ǅ", "日本語 😀😀 ok",
       "áé café x y\x1cz\x85w", "ab" * 700 + " é" * 4, "½ ² Ⅷ ٣٤ 5", "\x00\x01 a\x7f", "'ll'll'd're're x're'", "\r\n\t\v\f a", "ﬀ ß ẞ",
       "  a  b   \n\n c\n ", " 's 't\n's", "  ", "don't" * 30, "×÷ ªº"]


def odd_texts():
    r = random.Random(4)
    signs = "abcdefgst're ve'll 'd'm  \n\n\t!?.,#é çñüß01239ÀÉ"
    return ODD + ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(400)]


def test_bpe_equals_library_and_decodes(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pairs = [*cases.rows(), *((1000 + i, t) for i, t in enumerate(odd_texts()))]
    df = cases.frame(spark, pairs)
    got = bpe_codec.round_trip(df, path).collect()
    expected = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert cases.as_multiset([tuple(r) for r in got]) == cases.as_multiset(expected)
    again = bpe_codec.decode(bpe_codec.encode(df, path), path).collect()
    assert cases.as_multiset([(r.doc_id, r.text) for r in again]) == cases.as_multiset([(i, d) for i, _, d in expected])
    assert bpe_codec.round_trip(df.limit(0), path).count() == 0


def shingles(text, k=3):
    w = cases.words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(pairs, percent=90):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    parent[find(a)] = find(b)
    best = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return [(doc, len(sets[i]), best.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(pairs)]


@pytest.mark.parametrize("percent", [90, 60])
def test_jaccard_components(spark, percent):
    pairs = cases.rows(seed=9)
    got = jaccard_join.jaccard_components(cases.frame(spark, pairs), percent=percent).collect()
    assert cases.as_multiset([tuple(r) for r in got]) == cases.as_multiset(components(pairs, percent))


def hot_groups():
    """A template whose copies are not alike, a chain of small edits, and a passage many texts share."""
    r, vocab = random.Random(6), [f"w{i}" for i in range(4000)]
    template = [r.choice(vocab) for _ in range(120)]
    pairs = [(0, " ".join(template))]
    for k in range(90):
        w = list(template)
        for _ in range(r.choice([1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocab)
        pairs.append((len(pairs), " ".join(w)))
    chain = [r.choice(vocab) for _ in range(100)]
    for k in range(25):
        chain[4 * k] = f"new{k}"
        pairs.append((len(pairs), " ".join(chain)))
    passage = " ".join(r.choice(vocab) for _ in range(40))
    return pairs + [(len(pairs) + k, passage + " " + " ".join(r.choice(vocab) for _ in range(r.randint(0, 12)))) for k in range(60)]


@pytest.mark.parametrize("listed,one_task", [(jaccard_join.LIST, 1 << 20), (3, 0)])
def test_jaccard_chains_and_hot_groups(spark, monkeypatch, listed, one_task):
    """Also with pivot rounds for all lists, and components without the step of one task."""
    monkeypatch.setattr(jaccard_join, "LIST", listed)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2 if listed == 3 else jaccard_join.PIVOTS)
    monkeypatch.setattr(linked, "ONE_TASK", one_task)
    pairs = hot_groups()
    got = jaccard_join.jaccard_components(cases.frame(spark, pairs)).collect()
    assert cases.as_multiset([tuple(x) for x in got]) == cases.as_multiset(components(pairs))


def test_jaccard_two_families_in_one_list(spark, monkeypatch):
    """2,000 near copies each of two templates that share their rarest shingle:
    as many comparisons as rows, not as pairs."""
    r, vocab = random.Random(8), [f"w{i}" for i in range(3000)]
    shared = ["once", "upon", "time"]
    pairs = []
    for template in ([r.choice(vocab) for _ in range(90)] for _ in range(2)):
        for _ in range(2000):
            w = list(template)
            w[r.randrange(len(w))] = r.choice(vocab)
            pairs.append((len(pairs), " ".join(shared + w)))
    compared, plain = [], jaccard_join._Join.compared

    def counted(self, some, name):
        out = plain(self, some, name)
        compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join._Join, "compared", counted)
    got = jaccard_join.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string"), percent=80).collect()
    assert {(x.doc_id // 2000, x.component_id) for x in got} == {(0, 0), (1, 2000)}
    assert sum(compared) < 4 * len(pairs)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(cases.frame(spark, [(1, "a b c d")]).limit(0)).count() == 0


def test_quality_fences_follow_each_source(spark, monkeypatch):
    """What is odd in one source is usual in another; no fixed width decides."""
    monkeypatch.setattr(quality_rules, "LEAST_DOCS", 20)
    r, vocab = random.Random(3), cases.vocabulary(400)

    def text(signs):
        return " ".join(r.choice(vocab) + ("#" if k < signs else "") for k in range(120))

    rows = [(i, text(0 if i < 40 else 30 + i % 5), "en", "prose" if i < 40 else "code", 1) for i in range(80)]
    rows += [(100, text(30), "en", "prose", 1), (101, text(120), "en", "code", 1), (102, text(1), "en", "prose", 1)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    kept = {x.doc_id for x in got if x.kept}
    assert set(range(40, 80)) <= kept and not {100, 101, 102} & kept


def base_counts(text):
    text = text or ""
    w = cases.words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), [False] * len(w)
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered[i:i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if cases.WORD.search(x)]
    n, repeats = len(w), sum(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats,
            n < 50 or 100 * repeats > 50 * n)


def test_quality_rules(spark):
    r, vocab = random.Random(3), cases.vocabulary(400)
    pairs = [*cases.rows(), *((500 + i, " ".join(r.choice(vocab) for _ in range(120))) for i in range(80)),
             *((700 + i, " ".join(r.choice(vocab) + "$$$" for _ in range(120))) for i in range(4)),
             (800, "same line here\nsame line here\nother\n\n \n" * 3)]
    got = quality_rules.quality_rules(cases.frame(spark, pairs)).collect()
    assert cases.as_multiset([tuple(x)[:7] for x in got]) == cases.as_multiset([(i, *base_counts(t)) for i, t in pairs])
    kept = {x.doc_id: x.kept for x in got}
    assert all(kept[500 + i] for i in range(80)) and not any(kept[700 + i] for i in range(4))
    assert all(not x.kept for x in got if x.base_failed)
    assert quality_rules.quality_rules(cases.frame(spark, pairs).limit(0)).count() == 0


def test_quality_rules_are_native(spark):
    plan = quality_rules.quality_rules(cases.frame(spark, cases.rows(), clashing=False))._jdf.queryExecution().executedPlan().toString()
    counts = quality_rules.base_counts(cases.frame(spark, cases.rows(), clashing=False))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan + counts)


def test_packing(spark):
    from tokenizers import Tokenizer

    path, size = public_tokenizers.path("byte_bpe_50k.json"), 64
    library = Tokenizer.from_file(path)
    texts = [t for _, t in cases.rows()] + odd_texts()
    pairs = list(enumerate(texts))
    got = packing.pack_documents(cases.frame(spark, pairs), path, size=size).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in pairs}
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    bins = {}
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.length == size or len(ids[r.doc_id]) <= size or r.piece == 0
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    lengths = np.array([r.length for r in got])
    assert len(bins) <= packing.lower_bound(lengths, size) * 1.02 + 1
    assert packing.pack_documents(cases.frame(spark, pairs).limit(0), path).count() == 0
    repeated = packing.pack_documents(cases.frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), path).collect()
    assert sorted((r.doc_id or 0, r.length) for r in repeated) == [(0, 1), (1, 3), (1, 3)]


def test_packing_exchange_reaches_the_bound(spark, monkeypatch):
    """Many small parts: the exchange needs fewer bins than the parts alone, and loses nothing."""
    monkeypatch.setattr(packing, "PART_ITEMS", 32)
    r = random.Random(8)
    data = [(i, 0, 0, r.randint(1, 99), 7) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = packing._packed(df.withColumn("uid", F.monotonically_increasing_id()), 19, 0, 100)
    used = [alone.select("part", "bin").distinct().count()]
    for gain in (2.0, 0.0):  # one exchange, and all that gain
        monkeypatch.setattr(packing, "LEAST_GAIN", gain)
        got = packing.pack(df, size=100).collect()
        assert sorted((x.doc_id, x.length) for x in got) == [(d[0], d[3]) for d in data]
        bins = {}
        for x in got:
            bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for spans in bins.values():
            spans.sort()
            assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
            assert sum(n for _, n in spans) <= 100
        used.append(len(bins))
    assert packing.lower_bound(np.array([d[3] for d in data]), 100) <= used[2] <= used[1] < used[0]


def test_lower_bound_never_exceeds_best_fit():
    r = np.random.default_rng(1)
    for _ in range(200):
        x = np.sort(r.integers(1, 100, r.integers(1, 60)))[::-1]
        assert packing.lower_bound(x, 100) <= packing.best_fit(x, 100)[2]
    assert packing.lower_bound(np.array([51] * 9), 100) == 9 and packing.lower_bound(np.array([], int), 100) == 0


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and pii_spans.luhn(digits):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for signs in ("ab1@.-+% ", "0123.  -", "+1 ().-95 ", "a@b.c@d.e-", "1.2.3.4.255.256.000", "4929 -1"):
        for _ in range(4000):
            text = "".join(r.choice(signs) for _ in range(r.randint(0, 40)))
            assert pii_spans.base_spans(text) == plain_spans(text), text


def test_pii_candidates_are_whole():
    def found(text):
        return [(kind, text[a:b]) for kind, a, b in pii_spans.candidates(text, pii_spans.base_spans(text))]

    local, domain = "x" * 70, "b.c.d.e.f.g.h.i.j.com"
    assert found(f"write {local}[at]{domain} now") == [("email", f"{local}[at]{domain}")]
    assert found("server 10[.]0[.]0[.]1:8080 up") == [("ip", "10[.]0[.]0[.]1:8080")]
    assert found("host 10 . 2 . 3 . 4 is") == [("ip", "10 . 2 . 3 . 4")]
    assert found("ip 192[dot]168(dot)1[.]255") == [("ip", "192[dot]168(dot)1[.]255")]
    assert found("300[.]1[.]1[.]1 and 1.2.3.4 and 1 . 2 . 3 . 4 . 5") == []
    assert found("a" * 3_000_000 + " " + "1[.]" * 500_000) == []


def test_pii_adds_bracketed_addresses(spark):
    r = random.Random(2)

    def ip(dot):
        return dot.join(str(r.randrange(1, 256)) for _ in range(4))

    rows = [(i, f"the server {ip('[.]')} answered") for i in range(150)] + [(200 + i, f"section {ip(' . ')}" if i % 2 else f"host {ip('.')}") for i in range(40)]
    got = {x.doc_id: x for x in pii_spans.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]["all"]) == 1 and got[i]["all"][0].kind == 1 for i in range(150))
    text = dict(rows)[3]
    span = got[3]["all"][0]
    assert text[span.start:span.end].count("[.]") == 3 and not text[span.end:span.end + 1].isdigit()


def test_pii_spans_and_masks(spark):
    said = ["mail me: jo.doe@example.com or +1 (555) 010-4477 now", "é ip 10.0.0.1, card 4111 1111 1111 1111.", "1.2.3.456 and 4111 1111 1111 1112",
            "phone +1 (578) 555-6437 4929717128635271 x", "no digits @ all", "1" * 50000, "@" * 5000, "a" * 30000 + "@b.c"]
    pairs = [*cases.rows(), *((2000 + i, t) for i, t in enumerate(said))]
    df = cases.frame(spark, pairs).drop("base")
    got = pii_spans.find_spans(df).collect()
    assert cases.as_multiset([(r.doc_id, [tuple(s) for s in r.base]) for r in got]) == cases.as_multiset([(i, plain_spans(t or "")) for i, t in pairs])
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.all} for r in got)
    masked = pii_spans.masked(df)
    assert masked.columns == df.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[2000] == "mail me: [EMAIL] or [PHONE] now" and texts[2002] == said[2] and texts[2004] == said[4]
    assert pii_spans.find_spans(df.limit(0)).count() == 0 and pii_spans.masked(df.limit(0)).count() == 0


def test_labeler_estimates():
    belief, right = pii_spans.estimate({"1,1,0": 90, "-1,-1,0": 60, "1,-1,1": 5, "-1,1,-1": 4})
    assert belief["1,1,0"] > 0.9 > 0.1 > belief["-1,-1,0"] and (right > 0.5).all()
    assert pii_spans.estimate({})[0] == {}


def removed_windows(pairs, width=13):
    inf = float("inf")
    first = {}
    for i, t in pairs:
        w = cases.words(t)
        for k in range(len(w) - width + 1):
            key, i_ = tuple(w[k:k + width]), inf if i is None else i
            first[key] = min(first.get(key, inf), i_)
    out = []
    for i, t in pairs:
        w = cases.words(t)
        covered = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < (inf if i is None else i):
                covered[k:k + width] = [True] * width
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        out.append((i, len(w), sum(covered), kept))
    return out


@pytest.mark.parametrize("flush", [1_500_000, 500])
def test_substring_dedup(spark, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "FLUSH_WINDOWS", flush)
    pairs = cases.rows(seed=12)
    df = cases.frame(spark, pairs).withColumn("lang", cases_lang())
    got = substring_dedup.remove_repeated_windows(df, keep=("lang",)).collect()
    assert cases.as_multiset([tuple(r)[:4] for r in got]) == cases.as_multiset(removed_windows(pairs))
    assert {r.lang for r in got} == {"xx"}
    assert substring_dedup.remove_repeated_windows(df.limit(0)).count() == 0


def cases_lang():
    from pyspark.sql import functions as F

    return F.lit("xx")


def test_word_arrays():
    import pyarrow as pa

    texts = [t for _, t in cases.rows()]
    data, offsets = ta.buffers(pa.array(texts, pa.string()).slice(3))
    s, e, before = ta.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(s[lo:hi], e[lo:hi])] for lo, hi in zip(before[:-1], before[1:])]
    assert got == [cases.words(t) for t in texts[3:]]
    h = ta.span_hash(data, s, e)
    distinct = {raw[a:b] for a, b in zip(s, e)}
    assert len(set(h.tolist())) == len(distinct)
    joined = ta.join_spans(data, s, e, before).to_pylist()
    assert joined == [" ".join(cases.words(t)) for t in texts[3:]]
