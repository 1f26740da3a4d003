"""Sharding: a reproducible shuffle by a Feistel permutation over global row numbers.

Rows get numbers 0 to N-1 in the order of their id (then of the text's checksum, then of a hash of the row).
A Feistel network permutes the pairs (number / b, number mod b) of an a x b grid with a * b >= N; a number
that leaves 0 to N-1 walks on along its cycle until it is back.  Position p goes to shard p mod S, slot p / S:
shards' sizes differ by one at most, and anyone can compute where a number went.  DataFrame functions only.

Numbers come from one range-partitioned sort whose result is written to the shared folder, so that every
later read sees the same partitions, and from the partitions' cumulated sizes (one row a partition).  Equal
rows are spread by range partitioning on their scan position as well.

Defined results: null ids come first; a null text has no bytes and checksum 0; repeated rows get places of
their own; an empty table gives no rows; an input column named like a new one is replaced.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import materialise

ROUNDS, WALKS = 6, 64


def _quotient(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def _round(key: Column, number: Column, seed: int) -> Column:
    """A number of 48 bits from a half of the position, by MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), number.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def grid(n: int) -> tuple[int, int]:
    """Sides a, b with a * b >= n, nearly equal, and little to spare."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` of ``n``; a bijection of 0 to n-1."""
    a, b = grid(n)

    def once(x: Column) -> Column:
        def step(half: Column, k: Column) -> Column:
            left, right = half["left"], half["right"]
            on_left = F.struct(((left + _round(right, k, seed)) % a).alias("left"), right.alias("right"))
            on_right = F.struct(left.alias("left"), ((right + _round(left, k, seed)) % b).alias("right"))
            return F.when(k % 2 == 0, on_left).otherwise(on_right)

        halves = F.struct(_quotient(x, b).alias("left"), (x % b).alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step, lambda half: half["left"] * b + half["right"])

    # A cycle holds at most a * b - n numbers outside; beyond WALKS of them the odds are below (2 / sqrt(n)) ** WALKS.
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), number.cast("bigint"), lambda x, i: F.when((i > 0) & (x < n), x).otherwise(once(x)), lambda x: F.when(x < n, x).otherwise(F.raise_error("the cycle walk did not return").cast("bigint")))
    return walk


def numbered(rows: DataFrame, keys: list[Column]) -> tuple[DataFrame, int]:
    """The rows with ``row_number`` (from 0, in the order of ``keys``), and how many they are."""
    order = [*keys, F.xxhash64(*[c for c, kind in rows.dtypes if "map" not in kind and "variant" not in kind])]
    ordered = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    held = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    # One row a partition, so this side is broadcast: 100,000 partitions take some 2 MB.
    out = held.withColumn("_part", part).join(F.broadcast(before), "_part")
    number = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)
    return out.withColumn("row_number", number).drop("_part", "_before", "_at"), held.count()


def shard(rows: DataFrame, n_shards: int, keys: list[Column], seed: int = 0) -> DataFrame:
    """The rows with row_number, position, shard and slot."""
    rows = rows.drop("row_number", "position", "shard", "slot", "_at", "_part", "_before")
    out, n = numbered(rows, keys)
    out = out.withColumn("position", permuted(F.col("row_number"), max(n, 1), seed))
    return out.withColumn("shard", (F.col("position") % n_shards).cast("int")).withColumn("slot", _quotient(F.col("position"), n_shards))


def shard_documents(docs: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """doc_id, size (bytes of the text plus 16), text_crc32 and the place of each document; texts stay where they are."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(narrow, n_shards, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32")], seed)


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 0) -> None:
    """The documents as one folder a shard, rows in slot order; a shard is written by one task per 1,000,000 of its slots."""
    placed = shard(docs, n_shards, [F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")).asc_nulls_first()], seed)
    piece = _quotient(F.col("slot"), 1_000_000)
    placed.withColumn("_piece", piece).repartition("shard", "_piece").sortWithinPartitions("shard", "slot").drop("_piece").write.partitionBy("shard").parquet(path)
