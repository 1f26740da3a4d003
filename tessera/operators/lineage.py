"""Cutting the lineage of iterative plans, where executors can be lost at any time, and spreading rows over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared one, which goes when the driver ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _temporary(spark)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _temporary(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder; a local master without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        base = context.getConf().get("spark.checkpoint.dir") or _temporary(df.sparkSession)
        context.setCheckpointDir(base)
    return df.checkpoint()


def tasks(spark: SparkSession) -> int:
    """So many tasks take all cores and follow the session's shuffles."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores, for work that grows with rows: scans deal by bytes, and millions of narrow rows are one split."""
    return df.repartition(tasks(df.sparkSession), *keys)
