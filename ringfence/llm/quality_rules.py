"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets fixed base counts. The cut-offs of four ratios (symbols,
repeated words, repeated lines, word length) are not fixed: mergeable KLL
quantile sketches describe their distribution for each language and source,
sketches of small groups give way to the merged sketch of their language and
then of all documents, and a document is kept inside fences around the
median that are a multiple of the distance to an outer quantile. No fixed
width takes part: where a quantile and the median are equal (no text of nine
in ten has a symbol), the fence is that value.

The counts are written once (a few numbers a document), so texts are read
once and never shuffled. The fences have one row for each language and
source; Spark broadcasts them if they are small and otherwise splits hot
sources in the join.

Defined cases: a null or empty text has no words, fails the base rules and
is not kept; documents that fail the base rules don't enter the sketches;
null languages and sources are groups of their own; every row gives a row,
repeated or not, and a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

# Fixed values
WHITE = r"[ \x09-\x0D]+"
A_WORD = r"[^ \x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SKETCH_K = 2048       # exact up to as many documents, about 0.1 % of rank beyond
LEAST_DOCS = 200      # of a group whose own sketch decides
TIMES = 4.0           # a fence lies as many times as far from the median as its outer quantile
# ratio: (lower quantile or None, upper quantile), far enough out to carry information:
# most texts have neither repeated words nor lines, so their inner quantiles are 0
FENCES: dict[str, tuple[float | None, float]] = {
    "symbol_ratio": (None, 0.9),
    "repeat_ratio": (None, 0.99),
    "line_ratio": (None, 0.99),
    "word_length": (0.1, 0.9),
}
BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(A_WORD)).alias("lines"),
        F.array_remove(F.split(text, WHITE, -1), "").alias("words"))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - 3),
                        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("grams", F.when(F.size("words") >= 3, grams))
    # positions are only sorted by window where some window repeats
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    rows = rows.withColumn("by_gram", F.when(repeats, F.sort_array(
        F.transform("grams", lambda g, i: F.struct(g.alias("h"), i.alias("i"))))))

    def same(g, k):
        return F.coalesce(g["h"] == F.get("by_gram", k)["h"], F.lit(False))

    twice = F.filter("by_gram", lambda g, k: same(g, k - 1) | same(g, k + 1))
    at = F.sort_array(F.transform(twice, lambda g: g["i"]))
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                          lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    return rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"))


def _with_ratios(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return counts.select(
        "*", failed.alias("base_failed"),
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1)).cast("double")).alias("symbol_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)).cast("double")).alias("line_ratio"),
        (F.col("word_chars") / words).alias("word_length"))


def fences(ratios: DataFrame) -> DataFrame:
    """lang, source and (low_x, high_x) of each ratio x."""
    own = (ratios.filter(~F.col("base_failed")).groupBy("lang", "source")
           .agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(x, SKETCH_K).alias(x) for x in FENCES)))
    own = staged(own, "quantile-sketches")

    def merged(*by):
        return own.groupBy(*by).agg(F.sum("n").alias("l_n"), *(F.kll_merge_agg_double(x, SKETCH_K).alias(f"l_{x}") for x in FENCES))

    def quantile(sketch, q):
        return F.kll_sketch_get_quantile_double(sketch, F.lit(q))

    # of all documents: a dozen numbers, needed as constants
    quantiles = [(x, q) for x, (low, high) in FENCES.items() for q in (low, 0.5, high) if q is not None]
    whole = dict(zip(quantiles, merged().select(*(F.when(F.col("l_n") > 0, quantile(f"l_{x}", q)) for x, q in quantiles)).first()))
    by_lang = merged("lang").withColumnRenamed("lang", "l_lang")
    wide = own.join(by_lang, own.lang.eqNullSafe(by_lang.l_lang))
    bounds = []
    for x, (low, high) in FENCES.items():
        def at(q, x=x):
            return (F.when(F.col("n") >= LEAST_DOCS, quantile(x, q)).when(F.col("l_n") >= LEAST_DOCS, quantile(f"l_{x}", q))
                    .otherwise(F.lit(whole[x, q]).cast("double")))

        bounds.append((at(0.5) + TIMES * (at(high) - at(0.5))).alias(f"high_{x}"))
        bounds.append((at(0.5) - TIMES * (at(0.5) - at(low)) if low is not None else F.lit(float("-inf"))).alias(f"low_{x}"))
    return wide.select("lang", "source", *bounds)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed and kept."""
    counts = staged(base_counts(docs), "base-counts")
    ratios = _with_ratios(counts)
    limits = staged(fences(ratios), "fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    inside = F.lit(True)
    for x in FENCES:
        inside = inside & F.col(x).between(F.col(f"low_{x}"), F.col(f"high_{x}"))
    return (ratios.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
            .select(*BASE, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept")))
