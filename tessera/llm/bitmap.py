"""Bitmaps of fixed size that tell rows that can't have a partner from rows that may have one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import map_rows

BITS = 24
_BYTES = 4096  # of what bitmap_construct_agg gives


def bitmap(keys: DataFrame, key: Column) -> bytes:
    """2**BITS bits; bit (key mod 2**BITS) is set for every bigint key.  Two MB for any number of keys."""
    bits = keys.select((F.pmod(key, F.lit(1 << BITS)) + 1).alias("bit")).filter("bit is not null")
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(1 << BITS - 3)
    for row in parts.collect():  # 512 rows at most
        low = (row["part"] - 1) * _BYTES
        out[low : low + len(row["bits"])] = row["bits"]
    return bytes(out)


def holds(packed: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of these 64-bit keys are set."""
    bit = keys.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (np.frombuffer(packed, np.uint8)[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def rows_with(rows: DataFrame, key: Column, packed: bytes, have: bool = True) -> DataFrame:
    """The rows whose key's bit is set - or isn't -, in one pass without a shuffle."""
    name = "key" + "_" * max(map(len, rows.columns))  # no other column's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(holds(packed, np.asarray(batch.column(batch.num_columns - 1))) == have)
            for low in range(0, len(some), 256):
                yield batch.take(pa.array(some[low : low + 256]))

    return map_rows(rows.select("*", key.alias(name)), run).drop(name)
