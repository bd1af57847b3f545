"""Corpus preparation: training-data operators applied one after another.

Every stage works on all documents its predecessor kept; all but the last
give the columns of ``documents``. ``run`` writes each stage as Parquet and
rereads it, so a lost executor never costs more than one stage.

Defined cases: rows that repeat both id and text are one document; texts that
differ stay apart whatever their ids, null or repeated (only substring_dedup
takes rows of one id as one document, which never cut each other);
stages keep the columns lang and source as they are and recount n_chars;
columns that ``documents`` doesn't have are dropped; an empty table stays
empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfence.llm import jaccard_join, packing, pii_spans, rule_ensemble, substring_dedup
from ringfence.llm.staging import documents, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Near duplicates: sets of 5-word shingles with a Jaccard similarity of 0.8 or
# more. The 3 words and 0.9 of op3_jaccard_join are that query's own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _numbered(docs: DataFrame) -> DataFrame:
    """The document columns, with a null text as it is."""
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scores = rule_ensemble.quality_scores(_numbered(docs), table(spark, sf_dir, "labels"), keep=tuple(COLUMNS[1:]))
    return _numbered(scores.filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first text of each group of linked texts, by id (null last) and
    then by a hash of the text; of rows with its id and text, the smallest."""
    key = ["_hash", "_no_id", "_id"]
    marks = [F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id")]
    first = jaccard_join.component_firsts(_numbered(docs), width=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = (docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"), *marks)
            .join(first.select(F.col("text_hash").alias("_hash"), *marks), key, "left_semi"))
    one = kept.groupBy(*key).agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("row"))
    return one.select("row.*").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of words that a document with a smaller id
    has; all else of a text, white space too, stays as it is."""
    docs = _numbered(docs)
    kept = substring_dedup.remove_repeated_windows(docs, keep=("lang", "source"), joined=False)
    return _numbered(kept.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return pii_spans.masked(_numbered(docs)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed),
]

# Trained models, similarity components and packing are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and reread."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
