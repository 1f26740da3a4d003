"""The inverted index against plain BM25: segments, early stop, pruning of directories."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted, ranking

SCHEMA = "id bigint, text string"


def plain(rows, words, k1=1.2, b=0.75):
    docs = [(i, [t for t in re.split(r"[\W_]+", (t or "").lower()) if t]) for i, t in rows]
    mean, n, out = sum(len(t) for _, t in docs) / len(docs), len(docs), {}
    df = {w: sum(w in t for _, t in docs) for w in words}
    for i, t in docs:
        tf = Counter(t)
        if any(tf[w] for w in words):
            out[i] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean)) for w in words)
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(60_000)]
    at, rows = 0, []
    for i in range(900):
        n = rnd.choice([0, 1, 5, 20, 60, 400 if i % 50 == 0 else 30])
        rows.append((i * 3, " ".join(words[at : at + n]).title() + (" the" * rnd.choice([0, 1, 9]))))
        at += n
    return [*rows, (5, None), (7, ""), (8, "the " * 500)]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("inverted"))
    docs = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    inverted.add(docs, root, "all", buckets=8)
    return root


QUERIES = [["w1"], ["the", "w7", "w250"], ["W3", "w3", "w4"], ["the"], ["nowhere"], ["nowhere", "w9"]]


@pytest.mark.parametrize("words", QUERIES, ids="-".join)
def test_scores(spark, corpus, index, words):
    got = {r["id"]: r["keyword"] for r in inverted.Index(spark, index).scores(words).collect()}
    assert got == pytest.approx(plain(corpus, sorted({w.lower() for w in words})), abs=1e-6)


@pytest.mark.parametrize("words", QUERIES, ids="-".join)
@pytest.mark.parametrize("k", [1, 10, 5_000])
def test_early_stop_is_exact(spark, corpus, index, words, k):
    want = plain(corpus, sorted({w.lower() for w in words}))
    order = sorted(want, key=lambda i: (-round(want[i], 6), i))[:k]
    assert [r["id"] for r in inverted.Index(spark, index).best(words, k).collect()] == order


def test_early_stop_skips_slices(spark, corpus, index):
    found = inverted.Index(spark, index)
    assert found.stopped(["w250", "the"], 3).count() < found.scores(["w250", "the"]).count()


def test_only_the_words_directories_are_read(spark, index):
    found = inverted.Index(spark, index)
    blocks = found.blocks(["w1", "w2"])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term, [w1,w2])" in plan
    buckets = {r[0] for r in spark.range(1).select(F.explode(F.array(inverted.bucket(F.lit("w1"), 8), inverted.bucket(F.lit("w2"), 8)))).collect()}
    read = {r[0] for r in found.rows.filter(F.col("bucket").isin(list(buckets))).select(F.input_file_name()).distinct().collect()}
    assert read and all(any(f"bucket={b}/" in f for b in buckets) for f in read) and len(read) < len(spark.read.parquet(f"{index}/postings").inputFiles()) / 2
    assert {r["term"] for r in blocks.select("term").collect()} == {"w1", "w2"}


def test_grows_by_segments(spark, corpus, tmp_path):
    root, half = str(tmp_path), len(corpus) // 2
    parts = [corpus[:half], corpus[half:]]
    for name, rows in zip("ab", parts):
        inverted.add(spark.createDataFrame(rows, SCHEMA), root, name, buckets=4)
    files = set(spark.read.parquet(f"{root}/postings/segment=a").inputFiles())
    score = lambda segments: {r["id"]: r["keyword"] for r in inverted.Index(spark, root, segments).scores(["w2", "the"]).collect()}
    assert score(None) == pytest.approx(plain(corpus, ["w2", "the"]), abs=1e-6)
    assert score(["a"]) == pytest.approx(plain(parts[0], ["w2", "the"]), abs=1e-6)
    assert set(spark.read.parquet(f"{root}/postings/segment=a").inputFiles()) == files
    inverted.add(spark.createDataFrame(parts[1][:5], SCHEMA), root, "b", buckets=4)  # replaced
    assert score(["b"]) == pytest.approx(plain(parts[1][:5], ["w2", "the"]), abs=1e-6)


def test_half_written_segments_are_not_there(spark, corpus, tmp_path):
    root = str(tmp_path)
    inverted.add(spark.createDataFrame(corpus[:50], SCHEMA), root, "a", buckets=4)
    want = {r["id"] for r in inverted.Index(spark, root).scores(["the"]).collect()}
    spark.read.parquet(f"{root}/postings/segment=a").write.partitionBy("bucket").parquet(f"{root}/postings/segment=half")
    assert {r["id"] for r in inverted.Index(spark, root).scores(["the"]).collect()} == want


def test_no_documents(spark, tmp_path):
    inverted.add(spark.createDataFrame([], SCHEMA), str(tmp_path), "a")
    found = inverted.Index(spark, str(tmp_path))
    assert found.scores(["x"]).count() == 0 and found.best(["x"], 3).count() == 0


def test_equals_the_scan(spark, corpus, index):
    scanned = ranking.bm25(spark.createDataFrame([(i, t or "") for i, t in corpus], SCHEMA), ["w5", "the"])
    assert inverted.Index(spark, index).scores(["w5", "the"]).exceptAll(scanned).isEmpty()
