"""DuckDB SQL for the queries whose rules SQL can express.

Written from the rules, over the tables as views; no text is shared with
the Spark code.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
breaks AS (  -- control strings and backslashes get one more character each
  SELECT *, (SELECT sum((length(s.t) - length(replace(s.t, c.c, ''))) // length(c.c))
             FROM (SELECT unnest(['\', '<|im_start|>', '<|im_end|>', '<|im_sep|>', '<|endoftext|>', '<|startoftext|>', '<s>', '</s>',
                                  '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|system|>', '<|user|>', '<|assistant|>', '<|eot_id|>',
                                  '<|begin_of_text|>']) AS c) c, (SELECT turns.text AS t) s) AS extra
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + length(text) + extra + 10 + 1)::BIGINT AS formatted_chars
FROM breaks GROUP BY conv_id
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sized AS (SELECT sh.doc_id, s, n FROM sh JOIN n USING (doc_id)),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM sized a JOIN sized b
  ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 90 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)
"""

# Fixed values: (lower, upper quantile)
_FENCE = {"symbol_ratio": (None, 0.9), "repeat_ratio": (None, 0.99), "line_ratio": (None, 0.99), "word_length": (0.1, 0.9)}


def _quality() -> str:
    groups, limits, inside = [], [], []
    for x, (low, high) in _FENCE.items():
        for q, mark in ((low, "a"), (0.5, "m"), (high, "b")):
            if q is not None:
                groups.append(f"quantile_disc({x}, {q}) AS {x}_{mark}")
                limits.append(f"CASE WHEN g.n >= 200 THEN g.{x}_{mark} WHEN l.n >= 200 THEN l.{x}_{mark} ELSE a.{x}_{mark} END AS {x}_{mark}")
        inside.append(f"{x} <= {x}_m + 4.0::DOUBLE * ({x}_b - {x}_m)")
        if low is not None:
            inside.append(f"{x} >= {x}_m - 4.0::DOUBLE * ({x}_m - {x}_a)")
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM grams JOIN twice USING (doc_id, g), range(3) AS r(j) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN covered USING (doc_id)),
ratios AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols / greatest(word_chars, 1)::DOUBLE AS symbol_ratio, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio,
         n_dup_lines / greatest(n_lines, 1)::DOUBLE AS line_ratio, word_chars / greatest(n_words, 1)::DOUBLE AS word_length FROM counts),
fine AS (SELECT * FROM ratios WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS n, {", ".join(groups)} FROM fine GROUP BY lang, source),
l AS (SELECT lang, count(*) AS n, {", ".join(groups)} FROM fine GROUP BY lang),
a AS (SELECT {", ".join(groups)} FROM fine),
limits AS (SELECT g.lang, g.source, {", ".join(limits)} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(inside)}, FALSE) AS kept
FROM ratios r LEFT JOIN limits t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
"""


NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS r(i)),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
removed AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (k), range(13) AS r(j) WHERE m < doc_id),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

TREE_SCORES = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

FILTERS = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS ws,
                  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
d AS (
  SELECT part, coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS bad,
         [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'), first_id < doc_id] AS fails
  FROM t LEFT JOIN labels USING (doc_id)),
f AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, o, s AS step, o[s] AS own FROM orders, unnest(range(1, 6)) AS r(s)),
seen AS (
  SELECT part, good, bad, filter_order, step, own, fails[own] AS fails_it,
         len(list_filter(o[:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM d, steps),
counted AS (
  SELECT part, filter_order, step, own, sum((NOT gone AND NOT fails_it)::INT)::BIGINT AS kept, sum((NOT gone AND fails_it)::INT)::BIGINT AS removed,
         sum((gone AND fails_it)::INT)::BIGINT AS redundant, sum((fails_it AND n_fails = 1)::INT)::BIGINT AS unique_fails,
         sum((NOT gone AND fails_it AND good)::INT)::BIGINT AS good_lost, sum((NOT gone AND fails_it AND bad)::INT)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""


def _value(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_value(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: "
        "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)")


def _merkle() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(lower)} ELSE {_leaf("text")} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
low(g, lvl, pos, h, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM placed
  UNION ALL
  SELECT g, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), max(n + 7) // 8 FROM low WHERE n > 1 GROUP BY g, lvl, pos // 8),
subroots AS (SELECT g, lvl AS height, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE n = 1),
high(lvl, pos, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), max(n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, pos // 8),
nodes AS (
  SELECT g, lvl, pos, h FROM low WHERE n > 1
  UNION ALL SELECT s.g, s.height + high.lvl, high.pos, high.h FROM subroots s, high WHERE n > 1),
-- the place of every leaf on every level of its way to the root
way(doc_id, g, leaf, lvl, pos, at_top, up) AS (
  SELECT p.doc_id, p.g, p.leaf, 0, CASE WHEN s.height = 0 THEN s.pos ELSE p.pos END, s.height = 0, s.pos FROM placed p JOIN subroots s USING (g)
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, w.lvl + 1, CASE WHEN NOT w.at_top AND w.lvl + 1 = s.height THEN w.up ELSE w.pos // 8 END,
         w.at_top OR w.lvl + 1 = s.height, w.up
  FROM way w JOIN subroots s USING (g) WHERE w.lvl + 1 < s.height + (SELECT max(lvl) FROM high)),
proofs AS (
  SELECT w.doc_id, w.leaf, sha256(coalesce(string_agg(n.h, '' ORDER BY n.lvl, n.pos) FILTER (n.pos <> w.pos), '')) AS proof_sha256
  FROM way w LEFT JOIN nodes n ON n.g = w.g AND n.lvl = w.lvl AND n.pos // 8 = w.pos // 8 GROUP BY w.doc_id, w.leaf),
folded(doc_id, leaf, lvl, h) AS (
  SELECT doc_id, leaf, 0, changed FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.lvl + 1, sha256(string_agg(CASE WHEN n.pos = w.pos THEN f.h ELSE n.h END, '' ORDER BY n.pos))
  FROM folded f JOIN way w ON f.doc_id = w.doc_id AND f.leaf = w.leaf AND f.lvl = w.lvl
  JOIN nodes n ON n.g = w.g AND n.lvl = w.lvl AND n.pos // 8 = w.pos // 8 GROUP BY f.doc_id, f.leaf, f.lvl),
last AS (SELECT doc_id, leaf, arg_max(h, lvl) AS folded_root FROM folded GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified
FROM placed p JOIN subroots s USING (g) JOIN (SELECT h FROM high WHERE n = 1) r ON TRUE JOIN proofs USING (doc_id, leaf) JOIN last USING (doc_id, leaf)
"""


SQL = {
    "op2_chat_format": CHAT,
    "op3_jaccard_join": JACCARD,
    "op4_quality_rules": _quality(),
    "op7_one_bit_ann": NEAREST,
    "op10_substring_dedup": SUBSTRINGS,
    "op11_metric_tree": TREE_SCORES,
    "op12_filter_audit": FILTERS,
    "op13_merkle_manifest": _merkle(),
}
