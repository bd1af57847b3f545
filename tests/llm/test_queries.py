"""The numbered queries and the pipeline over the smallest tables."""

import os

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ringfence.llm import jaccard_join
from ringfence.llm.queries import QUERIES, SQL
from scripts.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_lists_them():
    assert {*QUERIES, "pipeline"} <= set(queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert len(rows) >= 200
        return
    cur = duck.execute(SQL[name])
    ocols, orows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(ocols) and len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]


def test_pipeline_stages(spark):
    """Each stage on its own input: what it may drop and what it must keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_duplicates", "substring_dedup", "pii", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.staged(stage(spark, docs, SF), f"test-{name}")
        before, after = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before
        if k < 4:
            assert out.columns == docs.columns
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = {i for i in before if labels.get(i) == 1}
            assert len(good & after) >= 0.97 * len(good)
        if name == "near_duplicates":
            links = jaccard_join.jaccard_components(docs, width=5, percent=80).collect()
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert len(after) == len({r.component_id for r in links}) < len(before)
            # of each component one document stays, its first
            assert after == {min(r.doc_id for r in links if r.component_id == c) for c in {r.component_id for r in links}}
            assert all(r.text == texts[r.doc_id] for r in out.collect())
        if name in ("substring_dedup", "pii", "packing"):
            assert after == before
        docs = out
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_on_empty_and_odd_documents(spark):
    from . import cases

    odd = cases.frame(spark, cases.rows())
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, corpus_pipeline.staged(stage(spark, docs, SF), "test-odd")
        got, ids = docs.collect(), {r.doc_id for r in before.collect()}
        assert {r.doc_id for r in got} == ids and bool(got) == (rows is odd)
        places = sorted((r.sequence_id, r.offset, r.length) for r in got)
        assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))
        assert all(0 < r.length and r.offset + r.length <= 1024 for r in got)
