"""Stages and operators on tables whose other columns have odd or clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

ODD = ["a.b", "`q`", "id", "h", "_id", "_h", "key", "node", "kept", "others", "spans", "_none", "item", "words", "c0", "c1", "label", "score", "n_rows", "component_id", "x y"]


@pytest.fixture
def folder(spark, tmp_path):
    at = tmp_path / "sf"
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_name(spark, folder, stage):
    rows = [(i, f"text number {i} " * (i + 3), *range(len(ODD))) for i in range(12)] + [(None, None, *range(len(ODD))), (3, "", *range(len(ODD)))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *(f"c{i}" for i in range(len(ODD)))]).toDF("doc_id", "text", *ODD)
    out = stage[1](spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(tuple(r)[2:] == tuple(range(len(ODD))) for r in got)
    assert stage[1](spark, docs.filter(F.lit(False)), folder).count() == 0


def test_packing_leaves_other_columns_out(spark, folder):
    docs = spark.createDataFrame([(1, "a", 2, 3)], "doc_id bigint, text string, ids int, sequence_id int").toDF("doc_id", "text", "ids", "a.b")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 1
