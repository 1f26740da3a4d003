"""Counts, coverage, freshness and alerts (A-01 to A-17, D-13, F-14, J-05 to J-07, R-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files at the root that should be indexed.
IMPORTANT_NAMES = ("package.json", "go.mod", "Dockerfile", "docker-compose.yml")
#: Case-insensitive patterns of paths that should be indexed.
IMPORTANT_PATTERNS = ("%README.md", "%/docs/adr/%", "%/docs/design/%", "%/docs/decisions/%")


class FailureRateError(RuntimeError):
    """More failures than a step may have."""


def products_with_stats(products: DataFrame, sources: DataFrame, snapshots: DataFrame, wiki: DataFrame) -> DataFrame:
    """A-01, J-05: each side is aggregated by product before it meets the others, so nothing fans out."""
    done = snapshots.filter("indexed").groupBy("source_id").agg(F.max("indexed_at").alias("at"))
    by_product = sources.join(done, sources["id"] == done["source_id"], "left").groupBy("product_id").agg(F.count_distinct(sources["id"]).alias("sources"), F.max("at").alias("last_indexed_at"))
    pages = wiki.groupBy("product_id").agg(F.max("generated_at").alias("wiki_generated_at"))
    rows = products.join(by_product, products["id"] == by_product["product_id"], "left").drop("product_id").join(pages, products["id"] == pages["product_id"], "left")
    return rows.select("id", "name", F.coalesce("sources", F.lit(0)).cast("int").alias("source_count"), "last_indexed_at", "wiki_generated_at").orderBy("name")


def domain_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A-02, J-06: grouped by the raw domain, so a NULL and a literal 'unknown' are two rows."""
    per_file = chunks.groupBy("file_id").agg(F.count("*").alias("chunks"))
    rows = files.join(per_file, files["id"] == per_file["file_id"], "left").groupBy("domain").agg(F.count_distinct("id").alias("file_count"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"))
    return rows.select(F.coalesce("domain", F.lit("unknown")).alias("domain"), "file_count", "chunk_count")


def domain_coverage(snapshot_files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A-03, J-07: coverage by domain; the averages are averages of the files' averages."""
    per_file = chunks.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("chunks"), F.avg(F.coalesce("comment_ratio", F.lit(0.0))).alias("ratio"), F.avg(F.coalesce("cyclomatic_complexity", F.lit(0))).alias("complexity"))
    rows = snapshot_files.join(per_file, "id", "left").groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain"))
    seen = F.count_if("indexed")
    return rows.agg(
        F.count("*").alias("total_files"), seen.alias("indexed_files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("indexed_chunks"),
        F.round(seen.cast("decimal(18,0)") * 100 / F.count("*"), 2).cast("double").alias("coverage_rate"),
        F.round(F.coalesce(F.avg("ratio"), F.lit(0.0)), 6).alias("avg_comment_ratio"), F.round(F.coalesce(F.avg("complexity"), F.lit(0.0)), 6).alias("avg_complexity"),
    )


def coverage_map(snapshot_files: DataFrame) -> DataFrame:
    """A-17: per domain and in total (domain NULL, is_total 1)."""
    rows = snapshot_files.select(F.coalesce("domain", F.lit("unknown")).alias("domain"), "indexed").rollup("domain")
    return rows.agg(F.grouping("domain").cast("int").alias("is_total"), F.count("*").alias("files"), F.count_if("indexed").alias("indexed_files"))


def unindexed_important(snapshot_files: DataFrame) -> DataFrame:
    """F-14: paths that should be indexed and aren't; the folder patterns need a folder before them."""
    wanted = F.col("file_path").isin(*IMPORTANT_NAMES)
    for pattern in IMPORTANT_PATTERNS:
        wanted = wanted | F.col("file_path").ilike(pattern)
    return snapshot_files.filter(~F.col("indexed") & wanted).select("file_path").orderBy("file_path")


def chunks_with_commit(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """J-01: latest chunks whose commit is known, with their file's path."""
    rows = chunks.filter(F.col("is_latest") & F.col("git_commit_hash").isNotNull())
    if files is None:
        return rows
    return rows.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")


def stale(chunks: DataFrame, as_of: str, days: int) -> DataFrame:
    """D-13: latest chunks of a known commit that were indexed more than ``days`` before ``as_of``."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return chunks_with_commit(chunks).filter(F.col("indexed_at") < limit)


def source_tokens(chunks: DataFrame, by: str = "chunk_type") -> DataFrame:
    """A-08."""
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def fill_rate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A-12: rows, and for each column the percentage that is filled."""
    total = F.count("*")
    return rows.agg(total.alias("rows"), *(F.round(F.try_divide(F.count(c).cast("double") * 100, total), 2).alias(f"{c}_rate") for c in columns))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """A-13, F-09."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def check_failure_rate(results: DataFrame, failed: str = "failed", most: float = 0.3) -> tuple[int, int]:
    """A-16: (rows, failures); raises when strictly more than ``most`` failed."""
    row = results.agg(F.count("*").alias("n"), F.count_if(failed).alias("bad")).first()
    return check_failures(row["n"], row["bad"], most)


def check_failures(n: int, failed: int, most: float) -> tuple[int, int]:
    """The same for numbers that are known already."""
    if n and failed / n > most:
        raise FailureRateError(f"{failed} of {n} failed")
    return n, failed


def alerts(coverage: DataFrame, important: DataFrame, adr_total: int = 10, adr_indexed: int = 5, test_rate: float = 20.0) -> DataFrame:
    """R-12: what should worry: READMEs not indexed, decision records not indexed, tests hardly covered."""
    readme = important.filter(F.lower("file_path").endswith("readme.md")).select(F.lit("readme_not_indexed").alias("alert"), F.col("file_path").alias("subject"))
    tests = coverage.filter((F.col("domain") == "tests") & (F.col("coverage_rate") < test_rate)).select(F.lit("low_test_coverage"), "domain")
    few = coverage.filter((F.col("domain") == "architecture") & (F.col("total_files") >= adr_total) & (F.col("indexed_files") < adr_indexed)).select(F.lit("few_decisions_indexed"), "domain")
    return readme.unionAll(tests).unionAll(few)
