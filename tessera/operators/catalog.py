"""Tables with keys: inserts, upserts, updates, deletes and cascades as rewrites (M-01 to M-08, J-10, J-11, J-13, D-03, D-04, D-10).

Plain Parquet has no MERGE, so each operation gives the table's new content; ``publish`` writes it as a new
version and moves the pointer last.  Nothing is read from the path that is being written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConflictError(ValueError):
    """A row whose key is there already (M-05)."""


class CheckError(ValueError):
    """A row that breaks a table's check."""


def check(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, all of which must meet the condition (NULL passes, as in SQL checks)."""
    if not rows.filter(~condition).isEmpty():
        raise CheckError(message)
    return rows


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """M-01, M-05: append; an equal key among the rows or in the table raises ConflictError (NULLs are distinct)."""
    keyed = rows.dropna(subset=list(key))
    twice = keyed.groupBy(*key).count().filter("count > 1")
    if not twice.isEmpty() or not table.join(keyed, list(key), "left_semi").isEmpty():
        raise ConflictError(f"duplicate key {', '.join(key)}")
    return table.unionByName(rows)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """M-03, M-04: append the rows whose key isn't there; rows with a NULL in the key never conflict."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    fresh = rows.filter(whole).dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")
    return table.unionByName(fresh.select(*rows.columns)).unionByName(rows.filter(~whole))


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """M-02, D-10: new rows win where keys are equal, except in the columns ``keep``; one shuffle on the key."""
    old, new = table.alias("o"), rows.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    hit = F.col(f"n.{key[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in key:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c in keep:
            return F.when(F.col(f"o.{key[0]}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return old.join(new, on, "full_outer").select(*(pick(c).alias(c) for c in table.columns))


def update(table: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """M-06: one pass that rewrites the rows that match."""
    return table.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def update_from(table: DataFrame, changes: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """M-07, J-11: a batch of updates as one join; rows without a change stay."""
    new = changes.select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = table.join(new, list(key), "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """M-08: what a DELETE leaves; a condition that is NULL deletes nothing."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """J-10, J-13: delete by a list of keys."""
    return table.join(keys, list(on), "left_anti")


def cascade(gone: DataFrame, links: Sequence[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """M-08: what stays of each table of a lineage.

    links: (table, its column that names the parent, its own id), from the first child down.  A child goes
    where its parent went, and takes its own children along.
    """
    out, gone = [], gone.toDF("_gone")
    for table, parent, own in links:
        lost = table.join(gone, table[parent] == gone["_gone"], "left_semi")
        out.append(table.join(gone, table[parent] == gone["_gone"], "left_anti"))
        gone = lost.select(F.col(own).alias("_gone"))
    return out


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-04: path and its change between two listings (path, content_hash); a rename is a deletion and an addition."""
    a, b = old.select("path", F.col("content_hash").alias("old_hash")), new.select("path", F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def not_indexed(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """D-03: versions (source_id, version_identifier) that still need indexing."""
    done = snapshots.filter("indexed").select("source_id", "version_identifier")
    return wanted.join(done, ["source_id", "version_identifier"], "left_anti")


def publish(df: DataFrame, root: str, version: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table's new version, then name it the current one."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{root}/v={version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/CURRENT")


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()["value"]
    return spark.read.parquet(f"{root}/v={version}")
