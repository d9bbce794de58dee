from __future__ import annotations

import pathlib

import pytest

import corpus_pipeline
from cairnlog.llm import queries

from .conftest import SF

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


def test_stages_take_effect(spark, docs, tmp_path):
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name.replace(" ", "-")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        if name != "packing":
            assert after.columns == docs.columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "exact dedup":
            assert after.count() == after.select("text").distinct().count() == before.select("text").distinct().count()
        if name == "personal data":
            assert after.count() == before.count() and after.where("n_chars <> char_length(text)").count() == 0
            assert after.where(r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'").count() == 0
        if name == "packing":
            assert after.select("doc_id").distinct().count() == before.count()
        before = after


def test_stages_handle_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    before = odd.withColumn("n_chars", F.char_length("text").cast("bigint"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name == "packing":
            assert after.agg(F.sum("length")).first()[0] > 0
        else:
            assert after.columns == before.columns
            assert after.where("score = 7").count() == 1
            assert stage(spark, before.limit(0), SF).collect() == []
            before = after


def test_run(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.columns[:3] == ["doc_id", "start", "length"] and result.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_for_each_of_the_table(spark, name):
    result = queries.QUERIES[name](spark, SF)
    if name == "op11_prefix_trie":  # a row a node: every conversation ends at one
        table = spark.read.parquet(f"{SF}/conversations.parquet")
        assert result.where("depth = 0").first().n_convs == table.select("conv_id").distinct().count()
        return
    table = "pages" if "page_id" in result.columns else "documents"
    rows = result.count()
    whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows == whole or name == "op4_pack_documents" and rows >= whole
