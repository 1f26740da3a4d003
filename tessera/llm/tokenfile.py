"""Token-ID / binary output: documents as Parquet list columns that can be read selectively.

``write_token_files`` range-partitions the documents by id, encodes each text where it lands and writes one
row a document: id, position in the file order, token count and the ids as ``array<int>``.  Ids are dictionary
encoded (their alphabet is small), numbers delta encoded (format version 2), row groups and pages have set
sizes, and the writer leaves page indexes, so a reader fetches only the columns, row groups and pages it needs.

Defined results: a null text is an empty one and has the end id alone; null ids come first in the order, ties
among equal ids go by the text's checksum; repeated rows are kept; an empty table gives files without rows;
other columns of the input are left out unless named in ``metadata``, and written under their own names, but for those that
the files' columns have already (in any case), which get ``_`` at their ends; a very long text is encoded by stretches, and its
ids are one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.store import column
from tessera.llm.textblocks import blocks
from tessera.llm.tokens import encoder

#: The files' own columns, and what a reader adds.
OWN = {"doc_id", "text", "file_part", "first_token", "n_tokens", "tokens", "start", "part_start", "part_tokens", "ids_crc32"}
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, file_part, first_token (of the part's ids before it), n_tokens, tokens."""
    width = 1 + len(keep)
    names = [*(f"c{i}" for i in range(width)), "file_part", "first_token", "n_tokens", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(width)):
                ids, at = enc.encode(data, offsets)
                n = high - low
                full = np.full(len(ids) + n, end_id, np.int32)
                full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
                bounds = at + np.arange(n + 1)
                start = before + bounds
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(x).slice(low, n) for x in range(width)),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(start[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(full)),
                    ],
                    names=names,
                )
                before = int(start[-1])

    kept = docs.select("doc_id", *map(column, keep), "text")
    plain = kept.toDF(*(f"c{i}" for i in range(width + 1)))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields[:width]))
    out = plain.mapInArrow(run, f"{schema}, file_part int, first_token bigint, n_tokens bigint, tokens array<int>")
    return out.toDF(*kept.columns[:width], *names[width:])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, metadata: Sequence[str] = ()) -> None:
    """Write the documents' ids, in ascending doc_id, under ``path``; ``metadata`` names columns to write beside them."""
    keys = [F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")).asc_nulls_first()]
    names = {c: c + "_" * (c.lower() in OWN) for c in metadata}
    docs = docs.select("doc_id", *(column(c).alias(n) for c, n in names.items()), "text")
    metadata = list(names.values())
    ordered = docs.repartitionByRange(*keys, F.monotonically_increasing_id())
    (
        encode_documents(ordered.sortWithinPartitions(*keys), tokenizer, end_id, metadata)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before; unused columns are not read."""
    files = spark.read.parquet(path)
    # One row a file, so this side is broadcast: a million files take some 20 MB.
    sizes = files.groupBy("file_part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = sizes.select("file_part", (F.sum("part_tokens").over(Window.orderBy("file_part")) - F.col("part_tokens")).alias("part_start"))
    return files.join(F.broadcast(before), "file_part").withColumn("start", F.col("part_start") + F.col("first_token")).drop("part_start", "first_token", "file_part")


def token_checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` replaced by ``ids_crc32``: the checksum of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("tokens"))
            at = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            names = [n for n in batch.schema.names if n != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "tokens")
    return tokens.mapInArrow(run, f"{schema}, ids_crc32 bigint")
