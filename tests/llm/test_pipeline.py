"""The pipeline's stages, each on what the one before it kept."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from quillspark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and ids, name
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        before = ids
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_run_is_the_same_again(spark):
    first, second = (Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and first


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_stages_on_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = "word " * 3000
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "two words", "en", "s", 9)]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "doc_id AS gone", "text AS `row`", "1 AS item", "2 AS spans", "lang AS key", "9 AS __copy", "77 AS __n", "'p' AS __pattern", "3 AS __draw", "4 AS `a.b`", "5 AS mark", "6 AS copies", "7 AS copy", "8 AS size")
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, SF)
            kept = out.collect()
            assert out.columns == table.columns or name == "packing"
            assert {r.doc_id for r in kept} <= {None, 1, 2, 3, 4} and (table is odd or not kept), name
            if table is odd and name != "packing":
                assert {(r["__copy"], r["__n"], r["a.b"], r["size"]) for r in kept} == {(9, 77, 4, 8)}, name
            if table is odd and name not in ("mixture", "packing"):
                assert {r.doc_id for r in kept} >= {None, 1, 2, 4}, name
