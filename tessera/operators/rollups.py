"""Coverage kept up to date from version to version (A-03, A-17): the changed files' signed partials on stored ones.

A version's state has a row a domain, with sums that can be added and subtracted exactly.  The next version's is the
base's plus the measures of the files that came, less those of the files that went.  A file that changed is both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells two listed files apart, beside their ids.
LISTED = ("path", "content_hash", "domain", "indexed")
#: Averages of a file, in decimals: their sums don't depend on the order, and come back to zero.
EXACT = "decimal(20,12)"
SUMS = ("files", "indexed", "chunks", "measured", "ratio", "complexity")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-04 in both directions: (old_id, new_id, domain, n) with n < 0 for what went and n > 0 for what came.

    old, new: (id, path, content_hash, domain, indexed).  A file that both list alike cancels out; a listing may hold a path twice,
    and NULLs are equal to each other.
    """
    both = old.select("id", *LISTED, F.lit(-1).alias("sign")).unionByName(new.select("id", *LISTED, F.lit(1).alias("sign")))
    rows = both.groupBy(*LISTED).agg(
        F.sum("sign").alias("n"), F.max(F.when(F.col("sign") < 0, F.col("id"))).alias("old_id"), F.max(F.when(F.col("sign") > 0, F.col("id"))).alias("new_id")
    )
    return rows.filter("n <> 0").select("old_id", "new_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), "indexed", "n")


def partials(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sums by domain of files (id, domain, indexed, n) and of what their chunks (file_id, comment_ratio, cyclomatic_complexity) measure.

    Only the chunks of these files are aggregated.  A file without chunks has no averages.
    """
    mine = chunks.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    per_file = mine.groupBy(F.col("file_id").alias("id")).agg(
        F.count("*").alias("chunks"), F.avg(F.coalesce(F.col("comment_ratio").cast("double"), F.lit(0.0))).cast(EXACT).alias("ratio"),
        F.avg(F.coalesce(F.col("cyclomatic_complexity").cast("double"), F.lit(0.0))).cast(EXACT).alias("complexity"),
    )
    rows, n = files.join(per_file, "id", "left"), F.col("n")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value * n), F.lit(0))

    return rows.groupBy("domain").agg(
        F.sum("n").alias("files"), total(F.col("indexed").cast("bigint")).alias("indexed"), total(F.col("chunks")).alias("chunks"),
        total(F.col("chunks").isNotNull().cast("bigint")).alias("measured"),
        *(F.coalesce(F.sum(F.col(c) * n.cast("decimal(10,0)")), F.lit(0)).cast("decimal(38,12)").alias(c) for c in ("ratio", "complexity")),
    )


def merged(*states: DataFrame) -> DataFrame:
    """The sums of several states; a domain without files is none."""
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    kinds = {"ratio": "decimal(38,12)", "complexity": "decimal(38,12)"}
    return rows.groupBy("domain").agg(*(F.sum(c).cast(kinds.get(c, "bigint")).alias(c) for c in SUMS)).filter("files <> 0")


def state(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def refresh(
    root: str, version: str, files: DataFrame, chunks: DataFrame, base: str | None = None, old_files: DataFrame | None = None, old_chunks: DataFrame | None = None
) -> DataFrame:
    """Write a version's state below ``root`` and give it.

    With a ``base``, whose listing and chunks are ``old_files`` and ``old_chunks``, what both versions list alike is neither measured nor
    aggregated.  A version that is written again is replaced, and its own state can't be its base.
    """
    spark = files.sparkSession
    if base is None:
        old_files, old_chunks = files.limit(0), chunks.limit(0)
    elif base == version:
        raise ValueError("a version is not its own base")
    moves = changed(old_files, files)
    came = partials(moves.filter("n > 0").withColumnRenamed("new_id", "id").drop("old_id"), chunks)
    went = partials(moves.filter("n < 0").withColumnRenamed("old_id", "id").drop("new_id"), old_chunks)
    before = [] if base is None else [state(spark, root, base)]
    merged(*before, came, went).coalesce(1).write.mode("overwrite").parquet(f"{root}/version={version}")
    return state(spark, root, version)


def coverage(rows: DataFrame) -> DataFrame:
    """A-03 of a state, as ``coverage.domain_coverage`` has it."""
    mean = [F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("measured")), F.lit(0.0)), 6) for c in ("ratio", "complexity")]
    return rows.select(
        "domain", F.col("files").alias("total_files"), F.col("indexed").alias("indexed_files"), F.col("chunks").alias("indexed_chunks"),
        F.round(F.col("indexed").cast("decimal(18,0)") * 100 / F.col("files"), 2).cast("double").alias("coverage_rate"),
        mean[0].alias("avg_comment_ratio"), mean[1].alias("avg_complexity"),
    )


def coverage_map(rows: DataFrame) -> DataFrame:
    """A-17 of a state, as ``coverage.coverage_map`` has it."""
    return rows.rollup("domain").agg(F.grouping("domain").cast("int").alias("is_total"), F.sum("files").alias("files"), F.sum("indexed").alias("indexed_files"))
