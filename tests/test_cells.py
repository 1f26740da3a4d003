"""Cells against plain cosine search: versions, ties, odd vectors, pruning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells

SCHEMA = "snapshot_id string, chunk_id bigint, vector array<float>, path string"


def plain(rows, query, k, versions=None, where=lambda path: True):
    out = []
    for s, i, v, path in rows:
        if v is None or len(v) != len(query) or any(x is None for x in v) or (versions is not None and s not in versions) or not where(path):
            continue
        a, b = np.array(v, np.float32).astype(float), np.array(query, float)
        norm = math.sqrt(a @ a) * math.sqrt(b @ b)
        if norm and math.isfinite(norm):
            out.append((-round(float(a @ b) / norm, 6), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def rows():
    rnd, out = np.random.default_rng(2), []
    centres = rnd.normal(size=(25, 12))
    for i in range(1_500):
        out.append((f"v{i % 3}", i, (centres[i % 25] + rnd.normal(size=12) * 0.15).astype(np.float32).tolist(), f"p{i % 4}/x"))
    odd = [None, [], [0.0] * 12, [1.0] * 5, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [2.0] * 5]
    out += [("v1", 9_000 + i, v, "odd") for i, v in enumerate(odd)]
    return out + [("v0", 9_100 + i, out[4][2], "tie") for i in range(5)]


@pytest.fixture(scope="module")
def root(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("cells"))
    cells.add(spark.createDataFrame(rows, SCHEMA).repartition(3), at, cells=25)
    return at


def ids(pruned):
    return [r["chunk_id"] for r in pruned.hits.collect()]


@pytest.mark.parametrize("k", [1, 7, 3_000])
def test_equals_plain_search(spark, rows, root, k):
    index, rnd = cells.CellIndex(spark, root), random.Random(k)
    for q in (rows[4][2], rows[77][2], [rnd.gauss(0, 1) for _ in range(12)], [1.0] * 5):
        assert ids(index.search(q, k)) == plain(rows, q, k)
        assert ids(index.search(q, k, ["v1", "v2"])) == plain(rows, q, k, {"v1", "v2"})
        assert [r["chunk_id"] for r in index.top(q, k, ["v1"]).collect()] == plain(rows, q, k, {"v1"})
        got = index.search(q, k, ["v0"], F.col("path").startswith("p2"))
        assert ids(got) == plain(rows, q, k, {"v0"}, lambda p: p.startswith("p2"))


def test_near_cells_alone_are_read(spark, rows, root):
    index = cells.CellIndex(spark, root)
    found = index.search(rows[77][2], 5)
    assert found.fraction < 0.4 and found.cells_read < found.cells / 2
    assert found.rows == len(rows)
    plan = found.hits._jdf.queryExecution().executedPlan().toString()
    assert "In(cell, [" in plan
    assert index.search([0.0] * 12, 5).hits.count() == 0


def test_versions_are_pruned_at_run_time(spark, rows, root):
    sources = spark.createDataFrame([("s", "v2", 1), ("t", "v0", 2)], "source string, snapshot_id string, product int")
    at = f"{root}-sources"
    sources.write.parquet(at)
    latest = spark.read.parquet(at).filter("product = 1").select("snapshot_id")
    found = cells.CellIndex(spark, root).search(rows[5][2], 4, F.broadcast(latest))
    assert "dynamicpruning" in found.hits._jdf.queryExecution().executedPlan().toString()
    assert ids(found) == plain(rows, rows[5][2], 4, {"v2"}) and found.rows == sum(r[0] == "v2" for r in rows)


def test_versions_are_added_and_replaced(spark, rows, tmp_path):
    at = str(tmp_path)
    add = lambda some: cells.add(spark.createDataFrame(some, SCHEMA), at, cells=8)
    add([r for r in rows if r[0] == "v0"])
    files = set(spark.read.parquet(f"{at}/vectors/snapshot_id=v0").inputFiles())
    add([r for r in rows if r[0] == "v1"])
    assert set(spark.read.parquet(f"{at}/vectors/snapshot_id=v0").inputFiles()) == files
    q = rows[9][2]
    assert ids(cells.CellIndex(spark, at).search(q, 9)) == plain([r for r in rows if r[0] != "v2"], q, 9)
    add([r for r in rows if r[0] == "v1" and r[1] < 100])
    assert ids(cells.CellIndex(spark, at).search(q, 9)) == plain([r for r in rows if r[0] == "v0" or (r[0] == "v1" and r[1] < 100)], q, 9)


def test_no_vectors(spark, tmp_path):
    cells.add(spark.createDataFrame([("v", 1, None, "p")], SCHEMA), str(tmp_path))
    assert ids(cells.CellIndex(spark, str(tmp_path)).search([1.0, 0.0], 3)) == []
