"""The running digest of sorted members: groups across batches, NULLs, a flat directory."""

import hashlib
import random

from tessera.operators import summaries


def test_groups_across_batches(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.choice([1, 2, None]), rnd.choice([None, *"xyzuvw"])) for _ in range(500)] + [("empty", 1, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = summaries.folded(spark.createDataFrame(rows, "g string, k int, h string"), ["g", "k"], "h", "hash").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {}
    for g, k, h in rows:
        groups.setdefault((g, k), []).append(h)
    assert len(got) == len(groups)
    assert {(r["g"], r["k"]): r["hash"] for r in got} == {key: hashlib.sha256(":".join(sorted(h for h in hs if h is not None)).encode()).hexdigest() for key, hs in groups.items()}
    assert summaries.folded(spark.createDataFrame([], "g string, h string"), ["g"], "h", "hash").count() == 0


def test_a_flat_directory_is_not_collected(spark):
    files = spark.range(300_000).selectExpr("concat('d/', id) as path", "sha2(cast(id as string), 256) as content_hash")
    got = {r["path"]: r["hash"] for r in summaries.directory_hashes(files).collect()}
    members = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(300_000))
    flat = hashlib.sha256(":".join(members).encode()).hexdigest()
    assert got == {"d": flat, "": hashlib.sha256(flat.encode()).hexdigest()}
    plan = summaries.folded(files, ["path"], "content_hash", "hash")._jdf.queryExecution().executedPlan().toString()
    assert "ollect" not in plan and "MapInArrow" in plan
