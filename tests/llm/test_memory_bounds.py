"""What a task of the text operators holds follows its chunk, not its partition."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ringfence.llm import jaccard_join, staging, substring_dedup


def text_batches(n_batches, rows=400, words=500):
    r = random.Random(8)
    for b in range(n_batches):
        texts = [" ".join(f"w{r.randrange(1 << 20):x}" for _ in range(words)) for _ in range(rows)]
        ids = pa.array(range(b * rows, (b + 1) * rows), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], ["doc_id", "text", "text_hash"])


@pytest.mark.parametrize("work, most_mb", [
    (lambda b: substring_dedup._window_rows(b, 13, 512), 60),
    (lambda b: jaccard_join._pool(b, 5, 80, 20), 30),
    (lambda b: jaccard_join._full_sets(b, 5), 20)], ids=["windows", "pool", "sets"])
def test_arrays_follow_a_chunk(work, most_mb):
    batches = list(text_batches(4))
    assert sum(b.nbytes for b in batches) > 4 << 20
    tracemalloc.start()
    try:
        for _ in work(iter(batches)):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < most_mb


def test_written_stages_have_bounded_row_groups_and_pages(spark):
    cell = F.expr("substring(repeat(sha2(cast(id as string), 256), 1024), 1, 65536)")
    wide = spark.range(0, 1000, 1, 1).select(cell.alias("packed"))
    files = list(Path(staging.staged(wide, "test-wide", "uncompressed")._staged_path.removeprefix("file:")).glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    groups = [m.row_group(k).total_byte_size for m in meta for k in range(m.num_row_groups)]
    assert sum(m.num_rows for m in meta) == 1000
    assert max(groups) < 32 << 20
