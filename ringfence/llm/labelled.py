"""Labelled rows for training: split, bounded sample and held-out mark.

A row may be learned from unless crc32(doc_id as text) mod 5 is 0. Training
takes at most ``limit`` labelled documents, those with the smallest hash of
their id, so a sample does not depend on partitioning; the bound is a
parameter of each classifier, and scoring always covers every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str) -> Column:
    """A null id is not held out, and never labelled."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_ids(labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(doc_id, label) of at most ``limit`` documents. Repeated labels of an
    id count once: 1 if any is 1; null labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    return (rows.filter("doc_id is not null and label is not null").filter(~held_out("doc_id"))
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def with_labels(rows: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """One row of each sampled id, with its label. The broadcast side has at
    most ``limit`` rows of 12 bytes."""
    ids = training_ids(labels, target, limit)
    return rows.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
