"""Streams of changes: extensions that show the batch operators over time (T-02, T-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edit_windows(changes: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """T-03: edits of each path in sliding windows; works on a stream and on a table alike."""
    kind = changes.schema["ts"].dataType
    if changes.isStreaming:  # watermarks need instants; there and back in the session's time zone
        changes = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = changes.groupBy(F.window("ts", length, step).alias("w"), "path").agg(F.count("*").alias("edits"))
    return counts.select(F.col("w.start").cast(kind).alias("window_start"), "path", "edits")


def index_changes(changes: DataFrame, index: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """T-02: index what has come since the last run, each batch's last state of a path once."""

    def batch(rows: DataFrame, _: int) -> None:
        index(rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "ts").alias("r")).select("path", "r.*"))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(rows: DataFrame, folder: str, state: str) -> StreamingQuery:
    """What has come since the last run, a folder a batch: a batch that is replayed writes its folder again and changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def written_windows(changes: DataFrame, folder: str, late: str = "1 day") -> DataFrame:
    """T-03: the windows of a stream of changes that is there now.

    A batch writes the windows that it changed, and a window's last batch tells its edits.  The state holds the windows
    whose end the newest change is not ``late`` past; older changes that come later are dropped.
    """
    run = written(edit_windows(changes, late=late), f"{folder}/windows", f"{folder}/state")
    run.awaitTermination()
    rows = changes.sparkSession.read.parquet(f"{folder}/windows")
    return rows.groupBy("window_start", "path").agg(F.max_by("edits", "batch").alias("edits"))
