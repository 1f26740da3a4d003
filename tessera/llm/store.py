"""Where the operators keep tables that every executor must be able to read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
    return _LOCAL[0]


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow hand whole texts to Python in batches of ``rows``: the default of 10,000 can take gigabytes an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Of intermediate tables: what a task holds of them when it writes, and at most when it reads.
ROW_GROUP_BYTES = 32 << 20


def column(name: str) -> Column:
    """A column by its plain name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run: Callable) -> DataFrame:
    """``mapInArrow`` that keeps the columns, whatever their names; ``run`` finds them by their numbers."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def materialise(df: DataFrame, compact: bool = False, **options) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage and survives lost executors.

    ``compact``: by two tasks a core, or one for eight shuffle partitions, so that tables of keys and links don't
    come as thousands of small files; a task takes one shuffle partition after the other.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if compact:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.options(**{"parquet.block.size": ROW_GROUP_BYTES, **options}).parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Let the driver delete the folder when it ends: what a returned DataFrame reads can't go before."""
    p, fs = _filesystem(spark, path)
    fs.deleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables, once nothing reads them any more."""
    for t in tables:
        for f in t.inputFiles()[:1]:
            p, fs = _filesystem(t.sparkSession, f.rpartition("/")[0])
            if p.getName().startswith("tessera-"):
                fs.delete(p, True)
                fs.cancelDeleteOnExit(p)
