"""The numbered queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_query_conf
from . import (ann_codes, bpe_codec, chat_format, filter_audit, jaccard_join, merkle, metric_tree, packing, pii_spans, quality_rules,
               rule_ensemble, substring_dedup, toxicity)
from .oracle import SQL  # noqa: F401 -- read by the entry
from .staging import documents, table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    both = bpe_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


# The control strings of another template, said in both roles of one more conversation.
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    planted = spark.range(2).select(F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.read_back(chat_format.format_chats(chat_format.turn_records(turns)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return ann_codes.nearest(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    found = pii_spans.find_spans(documents(spark, sf_dir))

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii_spans.KINDS[k]}")

    return found.select("doc_id", *map(count, range(len(pii_spans.KINDS))),
                        F.sha2(pii_spans.spans_text("base"), 256).alias("base_sha256"), pii_spans.spans_text("all").alias("spans"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return rule_ensemble.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    kept = substring_dedup.remove_repeated_windows(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return metric_tree.top_scores(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_query_conf(spark)
    id_hash = F.crc32(F.col("doc_id").cast("string"))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(documents(spark, sf_dir), tampered=F.when(id_hash % 3 == 0, lowered).otherwise(F.col("text")))


QUERIES = {f.__name__: f for f in (op1_bpe_codec, op2_chat_format, op3_jaccard_join, op4_quality_rules, op5_best_fit_packing,
                                  op6_toxicity, op7_one_bit_ann, op8_pii, op9_quality_classifier, op10_substring_dedup, op11_metric_tree,
                                  op12_filter_audit, op13_merkle_manifest)}
