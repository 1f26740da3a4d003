"""A text of 30 MB through every stage of the pipeline and the token files."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import tokenfile
from tessera.llm.store import shared_dir


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    long = " ".join(f"w{k * 7919 % 100_003}" for k in range(4_500_000))
    assert len(long) > 28_000_000
    rows = [(1, long), (2, "some short text of a few words"), (3, long[:5_000] + " and an end of its own"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.option("parquet.block.size", 1 << 20).parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, folder, stage):
    name, run = stage
    out = run(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    if name == "packing":
        got = {r["doc_id"]: (r["n"], r["whole"]) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()}
        assert set(got) == {1, 2, 3, 4} and all(n == whole for n, whole in got.values()) and got[1][0] > 4_500_000
        return
    got = {r["doc_id"]: r["n"] for r in out.select("doc_id", F.length("text").alias("n")).collect()}
    if name == "toxicity":
        assert 1 in got and 3 in got
    elif name == "suffix_dedup":
        assert set(got) == {1, 2, 3, 4} and got[3] == len(" and an end of its own") and 100 < got[1] < 28_000_000  # its numbers come again after 100,003 words
    else:
        assert set(got) == {1, 2, 3, 4}


def test_token_files(spark, folder):
    path = shared_dir(spark)
    tokenfile.write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    got = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens").collect()}
    assert got[1][0] == 0 and got[2][0] == got[1][1] > 4_500_000 and got[4][1] == 1
