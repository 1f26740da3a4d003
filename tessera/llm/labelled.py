"""Bounded, reproducible samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import materialise

#: At most so many labelled rows fit a classifier; which ones is decided by a hash of the id.
MAX_ROWS = 30_000


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, label int) of at most ``max_rows`` label rows of ids outside the held-out remainder.

    An id that several rows of documents have names no text, and is left out: so there are no more texts than label rows.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & (remainder(F.col("_id"), mod) != held_out))
    rows = materialise(rows.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows))
    # At most max_rows pairs of numbers, so these sides are broadcast whatever the corpus' size.
    ids = docs.select(F.col("doc_id").alias("_id")).join(F.broadcast(rows.select("_id").distinct()), "_id", "left_semi")
    once = ids.groupBy("_id").agg(F.count("*").alias("n")).filter("n = 1").select("_id")
    return docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(rows.join(F.broadcast(once), "_id")), "_id").select("text", "label")
