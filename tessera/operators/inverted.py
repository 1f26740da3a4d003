"""An inverted index for keyword search (R-02): persisted postings, read for a query's terms only.

``add`` writes one *segment* (a version) of the index:

* ``postings/segment=S/bucket=B``: a row for each term and *slice* of documents (128 in the order of reading) with the
  ids, counts and lengths of the documents of the slice that hold the term, and the block's greatest count and least
  length.  Buckets are hashes of terms, rows are sorted by term, so a query reads its terms' directories and, within
  their files, its terms' row groups.  A term of every document is a row a slice, dealt by ranges of slices, so no
  task gets all of it.
* ``stats/segment=S``, written last: documents and terms of the segment.  A segment without it is not there.

Scores need the number of documents, the mean length and the terms' document counts over the chosen segments, so
an index grows by segments without anything being rewritten.  For the k best, a slice's score is bounded by what the
greatest counts and least lengths of its blocks can give; the slices with the highest bounds give a threshold,
and only slices whose bound reaches it are scored.  The result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranking import terms

#: Directories of a segment, documents of a slice, slices that are shuffled together, and parts that a directory is dealt to: files don't grow with the tasks that read.
BUCKETS, SLICE, RANGE, PARTS = 64, 128, 1 << 10, 16
K1, B = 1.2, 0.75
#: Scores are rounded to so many digits, and bounds given the slack of one in the last.
DIGITS = 6


def add(docs: DataFrame, root: str, segment: str, buckets: int = BUCKETS, slice_: int = SLICE) -> None:
    """Write the segment of documents (id, text); one of the same name is replaced.  Null texts are empty.

    ``slice_``, a power of two, is how many documents a slice has: fewer and longer rows, against coarser bounds.
    """
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    number = F.shiftright(F.monotonically_increasing_id(), slice_.bit_length() - 1)
    read = docs.select("id", number.alias("slice"), terms(F.coalesce("text", F.lit(""))).alias("terms"))
    # A slice lies in one task, so its blocks are made where its documents are read, and only they are shuffled.
    made = read.mapInArrow(_blocks, f"term string, slice bigint, n int, max_tf int, min_len int, ids array<{kind}>, tfs array<int>, lens array<int>")
    blocks = made.withColumn("bucket", bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64(F.floor(F.col("slice") / RANGE)), F.lit(PARTS)))
    at = f"{root}/postings/segment={segment}"
    blocks.sortWithinPartitions("bucket", "term", "slice").write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(at)
    total = spark.read.schema(_schema(kind)).parquet(at).agg(F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0)))
    row = [(docs.count(), total.first()[0], buckets, kind)]
    spark.createDataFrame(row, "documents bigint, terms bigint, buckets int, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{root}/stats/segment={segment}")


def counted(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words the different words, and of each pair of a word and a list that holds it, sorted by word, both numbers and the count."""
    coded, n = words.flatten().dictionary_encode(), max(len(words), 1)
    lists = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
    pairs, count = np.unique(np.asarray(coded.indices).astype(np.int64) * n + lists, return_counts=True)
    return coded.dictionary, pairs // n, pairs % n, count.astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of documents (id, slice, terms), slice by slice; no more than a batch and a slice are held."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        slices = np.asarray(rows.column("slice").combine_chunks())
        ends = [*(np.flatnonzero(np.diff(slices)) + 1).tolist()]
        for low, high in zip([0, *ends], ends):
            yield from _block(rows.slice(low, high - low))
        held = rows.slice(ends[-1] if ends else 0)
    if held is not None and held.num_rows:
        yield from _block(held)


def _block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row a term of the documents of one slice."""
    rows = rows.take(pc.sort_indices(rows.column("id"))).combine_chunks()
    words = pa.chunked_array(rows.column("terms").chunks).combine_chunks()
    length = np.diff(np.asarray(words.offsets)).astype(np.int32)
    known, word, doc, tf = counted(words)
    if not len(word):
        return
    first = np.flatnonzero(np.diff(word, prepend=-1))
    offsets = pa.array(np.append(first, len(word)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (rows.column("id").combine_chunks().take(pa.array(doc)), pa.array(tf), pa.array(length[doc]))]
    k = len(first)
    numbers = [pa.array(np.full(k, rows.column("slice")[0].as_py(), np.int64)), pa.array(np.diff(np.append(first, len(word))).astype(np.int32)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length[doc], first))]
    yield pa.RecordBatch.from_arrays([known, *numbers, *lists], names=["term", "slice", "n", "max_tf", "min_len", "ids", "tfs", "lens"])


def _schema(kind: str) -> str:
    return f"term string, slice bigint, n int, max_tf int, min_len int, ids array<{kind}>, tfs array<int>, lens array<int>, segment string, bucket int"


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """The chosen segments of an index below ``root``, all of them by default; files are listed once."""

    def __init__(self, spark: SparkSession, root: str, segments: Sequence[str] | None = None):
        stats = spark.read.schema("documents bigint, terms bigint, buckets int, id_type string, segment string").parquet(f"{root}/stats")
        if segments is not None:
            stats = stats.filter(F.col("segment").isin(list(segments)))
        found = stats.groupBy("buckets", "id_type").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()  # a row a layout
        if len(found) > 1:
            raise ValueError("the segments have different buckets or ids")
        self.documents, self.terms, self.buckets, self.kind = (found[0]["documents"], found[0]["terms"], found[0]["buckets"], found[0]["id_type"]) if found else (0, 0, BUCKETS, "bigint")
        self.rows = spark.read.schema(_schema(self.kind)).parquet(f"{root}/postings") if found else spark.createDataFrame([], _schema(self.kind))
        self.there = stats.select("segment")

    def postings(self) -> DataFrame:
        """All rows of the segments that have their statistics."""
        return self.rows.join(self.there, "segment", "left_semi")

    def blocks(self, words: Sequence[str]) -> DataFrame:
        """The words' rows; their buckets are partition filters, the words reach the row groups."""
        of = [bucket(F.lit(w), self.buckets) for w in words]
        return self.postings().filter(F.col("bucket").isin(of) & F.col("term").isin(list(words)))

    def _weights(self, words: Sequence[str]) -> Column:
        """A row's inverse document frequency by its term."""
        df = {r["term"]: r["df"] for r in self.blocks(words).groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a word
        out = F.lit(0.0)
        for word, n in df.items():
            out = F.when(F.col("term") == word, math.log(1 + (self.documents - n + 0.5) / (n + 0.5))).otherwise(out)
        return out

    def _part(self, tf: Column, length: Column) -> Column:
        mean = self.terms / self.documents if self.terms else 1.0
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))

    def _scored(self, blocks: DataFrame, idf: Column) -> DataFrame:
        rows = blocks.select(idf.alias("idf"), F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
        part = F.col("idf") * self._part(F.col("p.tfs"), F.col("p.lens"))
        return rows.groupBy(F.col("p.ids").alias("id")).agg(F.round(F.sum(part), DIGITS).alias("keyword"))

    def scores(self, query: Sequence[str]) -> DataFrame:
        """R-02: id and BM25 score of every document that holds a word of the query."""
        words = sorted({w.lower() for w in query})
        return self._scored(self.blocks(words), self._weights(words))

    def best(self, query: Sequence[str], k: int) -> DataFrame:
        """The ``k`` best of ``scores``, ties by id."""
        return self.stopped(query, k).orderBy(F.desc("keyword"), "id").limit(k)

    def stopped(self, query: Sequence[str], k: int) -> DataFrame:
        """Scores of the documents of every slice that can hold one of the ``k`` best."""
        words = sorted({w.lower() for w in query})
        blocks, idf = self.blocks(words), self._weights(words)
        bounds = blocks.groupBy("segment", "slice").agg(F.sum(idf * self._part(F.col("max_tf"), F.col("min_len"))).alias("bound"))
        seeds = F.broadcast(bounds.orderBy(F.desc("bound")).limit(k).select("segment", "slice"))  # k rows
        first = self._scored(blocks.join(seeds, ["segment", "slice"], "left_semi"), idf).orderBy(F.desc("keyword")).limit(k).agg(F.count("*").alias("n"), F.min("keyword").alias("least")).first()
        least = first["least"] if first["n"] == k else 0.0
        reach = bounds.filter(F.col("bound") + 10.0**-DIGITS >= least).select("segment", "slice")
        return self._scored(blocks.join(reach, ["segment", "slice"], "left_semi"), idf)
