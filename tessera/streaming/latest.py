"""The latest version of every source of a stream, with a state that forgets sources that are quiet (A-06, T-02)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.edits import written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Latest(StatefulProcessor):
    """One value a source: the time and name of its newest version; equal times go to the greater name."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, version string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = best = tuple(self.newest.get()) if self.newest.exists() else None
        for part in rows:
            newest = part["us"].max()
            top = (int(newest), part.loc[part["us"] == newest, "version"].max())
            best = top if best is None else max(best, top)
        if best != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.newest.update(best)
            self.handle.registerTimer(self._end(best))
            yield pd.DataFrame({"source_id": [key[0]], "version": [best[1]], "us": [best[0]]})

    def _end(self, version: tuple[int, str]) -> int:
        return version[0] // 1000 + self.idle_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest(versions: DataFrame) -> DataFrame:
    """A-06 of a table (source_id, version, ts): rows without a source, version or time take no part, ties go to the greater version."""
    rows = versions.dropna(subset=["source_id", "version", "ts"])
    return rows.groupBy("source_id").agg(F.max(F.struct("ts", "version")).alias("_m")).select("source_id", "_m.version", "_m.ts")


def changes(versions: DataFrame, late: str = "1 day", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """The stream's sources whose newest version has changed, batch by batch (source_id, version, ts).

    Rows that come ``late`` after the newest are dropped.  A source is forgotten once the watermark is
    ``idle_ms`` past its newest version; what it brings later is newer than that, since older rows are late, so nothing old is given as new.
    """
    kind, instant = versions.schema["ts"].dataType, F.col("ts").cast("timestamp")  # watermarks need instants; there and back in the session's time zone
    rows = versions.select("source_id", "version", instant.alias("ts"), F.unix_micros(instant).alias("us")).dropna()
    marked = rows.withWatermark("ts", late).groupBy("source_id")
    out = marked.transformWithStateInPandas(_Latest(idle_ms), "source_id string, version string, us long", "Update", "EventTime")
    return out.select("source_id", "version", F.timestamp_micros("us").cast(kind).alias("ts"))


def written_latest(versions: DataFrame, folder: str, late: str = "1 day", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """The latest versions of a stream that is there now, as all its batches have written them below ``folder``."""
    spark = versions.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # states of this kind need it
    try:
        run = written(changes(versions, late, idle_ms), f"{folder}/latest", f"{folder}/latest-state")
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return latest(spark.read.parquet(f"{folder}/latest"))
