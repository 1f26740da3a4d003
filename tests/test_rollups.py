"""Coverage by deltas against the full recomputation (A-03, A-17)."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import coverage, indexing, rollups

FILES = "id long, path string, content_hash string, domain string, indexed boolean"
CHUNKS = "file_id long, comment_ratio double, cyclomatic_complexity int"


def make(spark, listing, chunks):
    return spark.createDataFrame(listing, FILES), spark.createDataFrame(chunks, CHUNKS)


def version(spark, n, files):
    """A listing with ids of its own, and chunks that follow from path and content."""
    listing, chunks = [], []
    for k, (path, (content, domain, indexed)) in enumerate(sorted(files.items())):
        listing.append((n * 1000 + k, path, content, domain, indexed))
        r = random.Random(path + content)
        chunks += [(n * 1000 + k, r.choice([None, 0.1, 0.7]), r.choice([None, 1, 9])) for _ in range(r.randrange(4))]
    return make(spark, listing, chunks)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions_equal_recomputation(spark, tmp_path):
    """Files that come, go, change, move to another domain, or get indexed, over four versions."""
    r, root, files, before = random.Random(3), str(tmp_path), {}, None
    fresh = lambda: (str(r.randrange(5)), r.choice([None, "unknown", "code", "tests"]), r.random() < 0.6)
    for n in range(4):
        if n == 3:
            files = {p: f for p, f in files.items() if f[1] != "code"}  # a domain dies out
        else:
            files = {p: f if r.random() < 0.6 else fresh() for p, f in files.items() if r.random() < 0.8}
            files |= {f"p{n}-{k}": fresh() for k in range(12)}
        now = version(spark, n, files)
        state = rollups.refresh(root, str(n), *now) if before is None else rollups.refresh(root, str(n), *now, str(n - 1), *before)
        assert rows(rollups.coverage(state)) == rows(coverage.domain_coverage(*now))
        assert rows(rollups.coverage_map(state)) == rows(coverage.coverage_map(now[0]))
        before = now
    again = rollups.state(spark, root, "3")
    assert "code" not in {r["domain"] for r in again.collect()}


def test_only_changed_files_are_measured(spark, tmp_path):
    """The chunks of a file that stays hold other values in the second run, which must not show."""
    files, chunks = make(spark, [(1, "a", "x", "code", True), (2, "b", "y", "code", True)], [(1, 0.5, 1), (2, 0.5, 3)])
    rollups.refresh(str(tmp_path), "1", files, chunks)
    new, later = make(spark, [(1, "a", "x", "code", True), (3, "b", "z", "code", True)], [(1, 99.0, 99), (1, 99.0, 99), (3, 0.25, 5)])
    gone = spark.createDataFrame([(1, 77.0, 77), (2, 0.5, 3)], CHUNKS)
    got = rollups.coverage(rollups.refresh(str(tmp_path), "2", new, later, "1", files, gone)).first()
    assert (got["total_files"], got["indexed_chunks"], got["avg_comment_ratio"], got["avg_complexity"]) == (2, 2, 0.375, 3.0)


def test_empty_repeated_and_own_base(spark, tmp_path):
    none = make(spark, [], [])
    root = str(tmp_path)
    assert rows(rollups.refresh(root, "0", *none)) == []
    twice = make(spark, [(1, "a", "x", None, True), (2, "a", "x", None, True), (3, "b", None, None, None)], [(1, 0.5, 1), (2, 0.5, 1)])
    assert [(r["domain"], r["total_files"], r["indexed_files"]) for r in rollups.coverage(rollups.refresh(root, "1", *twice, "0", *none)).collect()] == [("unknown", 3, 2)]
    once = make(spark, [(9, "a", "x", None, True)], [(9, 0.5, 1)])
    for _ in range(2):  # a version that is written again is the same
        got = rollups.coverage(rollups.refresh(root, "2", *once, "1", *twice)).collect()
        assert [(r["total_files"], r["indexed_files"], r["indexed_chunks"], r["avg_comment_ratio"]) for r in got] == [(1, 1, 1, 0.5)]
    with pytest.raises(ValueError):
        rollups.refresh(root, "2", *once, "2", *once)


def test_index_keeps_coverage(spark, tmp_path):
    def docs(**texts):
        return spark.createDataFrame([(p.replace("__", "/"), bytearray(t, "utf-8")) for p, t in texts.items()], "path string, content binary")

    body, root = "the words of a page that is long enough to be a chunk of its own\n" * 12, str(tmp_path)
    indexing.index(docs(**{"docs__a.md": body, "src__b.txt": body + "b", "src__c.txt": body + "c"}), root, "p", "s", "1")
    indexing.index(docs(**{"docs__a.md": body, "src__b.txt": body * 3, "tests__d.txt": body}), root, "p", "s", "2")
    files = spark.read.parquet(f"{root}/files").filter("snapshot_id = 's@2'").withColumn("indexed", F.lit(True))
    chunks = spark.read.parquet(f"{root}/chunks").filter("snapshot_id = 's@2' and error is null")
    kept = rollups.coverage(rollups.state(spark, f"{root}/coverage", "s@2"))
    assert rows(kept) == rows(coverage.domain_coverage(files, chunks)) and kept.count() >= 2
    indexing.index(docs(**{"docs__a.md": body}), root, "p", "s", "2", force=True)
    assert [r["total_files"] for r in rollups.coverage(rollups.state(spark, f"{root}/coverage", "s@2")).collect()] == [1]
