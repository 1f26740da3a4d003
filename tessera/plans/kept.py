"""Indexes that registered queries read: built once a session for a folder of tables, and again when a table changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.operators import lineage

_KEPT: dict[tuple, object] = {}


def kept(table: DataFrame, name: str, build: Callable[[str], None], opened: Callable[[str], object]) -> object:
    """The opened index ``name`` of a table; ``build`` writes it to a folder that goes when the driver ends."""
    spark = table.sparkSession
    key = (spark.sparkContext.applicationId, name, *_files(table))
    if key not in _KEPT:
        path = lineage.shared_folder(spark)
        build(path)
        _KEPT[key] = opened(path)
    return _KEPT[key]


def _files(table: DataFrame) -> list[tuple]:
    """The table's files with their sizes and times."""
    spark, out = table.sparkSession, []
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for f in sorted(table.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(conf).getFileStatus(p)
        out.append((f, status.getLen(), status.getModificationTime()))
    return out
