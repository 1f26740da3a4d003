"""Streams whose state is bounded: windows in update mode and the latest version of every source (T-02, T-03, A-06)."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.streaming import edits, latest

DAY = 24 * 3600 * 1000


def write(spark, folder, name, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{folder}/{name}")
    return df


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def found(df):
    return sorted((r["source_id"], r["version"]) for r in df.collect())


def test_latest_version_over_batches(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "source_id string, version string, ts string"
    first = write(spark, src, "a", [("s", "v1", "2024-01-01"), ("s", "v2", "2024-01-02"), ("t", "w1", "2024-01-01"), (None, "x", "2024-01-01"), ("u", None, "2024-01-01")], schema)
    run = lambda: found(latest.written_latest(stream(spark, src, first.schema), out))
    assert run() == [("s", "v2"), ("t", "w1")] == found(latest.latest(first))
    before = spark.conf.get(latest.PROVIDER)
    write(spark, src, "b", [("s", "v1b", "2024-01-01 20:00:00"), ("t", "w3", "2024-01-03"), ("t", "w2", "2024-01-03")], schema)
    assert run() == [("s", "v2"), ("t", "w3")]
    assert run() == [("s", "v2"), ("t", "w3")]  # nothing new
    assert spark.conf.get(latest.PROVIDER) == before


def test_quiet_sources_are_forgotten_and_late_rows_dropped(spark, tmp_path):
    """A source a day for 40 days: the state holds those of the last days, the table all."""
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "source_id string, version string, ts string"
    day = lambda k: str(datetime.date(2024, 1, 1) + datetime.timedelta(days=k))
    spark.conf.set(latest.PROVIDER, latest.ROCKS)
    try:
        sizes = []
        for k in range(0, 40, 8):
            df = write(spark, src, f"d{k:02}", [(f"s{j}", "v", day(j)) for j in range(k, k + 8)], schema)
            run = edits.written(latest.changes(stream(spark, src, df.schema), idle_ms=3 * DAY), f"{out}/latest", f"{out}/state")
            run.awaitTermination()
            sizes.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
        write(spark, src, "late", [("s39", "old", day(2)), ("s2", "older", day(1))], schema)
        run = edits.written(latest.changes(stream(spark, src, df.schema), idle_ms=3 * DAY), f"{out}/latest", f"{out}/state")
        run.awaitTermination()
    finally:
        spark.conf.unset(latest.PROVIDER)
    assert max(sizes) <= 2 * 16, sizes  # a value and a timer a source
    assert found(latest.latest(spark.read.parquet(f"{out}/latest"))) == sorted((f"s{j}", "v") for j in range(40))


def test_windows_in_update_mode(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "path string, ts string"
    a = write(spark, src, "a", [("p", "2024-01-01 10:00:00"), ("p", "2024-01-02 10:00:00"), ("q", "2024-01-02 11:00:00")], schema)
    run = lambda: sorted((str(r["window_start"]), r["path"], r["edits"]) for r in edits.written_windows(stream(spark, src, a.schema), out).collect())
    whole = lambda df: sorted((str(r["window_start"]), r["path"], r["edits"]) for r in edits.edit_windows(df).collect())
    assert run() == whole(a)
    b = write(spark, src, "b", [("p", "2024-01-02 12:00:00"), ("q", "2024-02-20 00:00:00")], schema)
    assert run() == whole(a.unionAll(b))
    late = write(spark, src, "c", [("p", "2024-01-02 13:00:00"), ("q", "2024-02-20 01:00:00")], schema)
    assert run() == whole(a.unionAll(b).unionAll(late.filter("path = 'q'")))  # all windows of the first row are closed


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The folder of a batch that is written again, as after a driver that was lost before it could note the end."""
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "path string, ts string"
    a = write(spark, src, "a", [("p", "2024-01-01 10:00:00")], schema)
    want = edits.written_windows(stream(spark, src, a.schema), out).collect()
    import glob
    import os

    for done in glob.glob(f"{out}/state/commits/*") + glob.glob(f"{out}/state/commits/.*.crc"):
        os.remove(done)
    got = edits.written_windows(stream(spark, src, a.schema), out).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 7


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_nothing_to_say(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "source_id string, version string, ts timestamp")
    assert latest.latest(df).count() == 0
