"""Indexing a version of a source from files to embeddings (D-01 to D-03, D-09, A-15, C-23, S-15, S-16).

One lazy plan a table: scan, ignore filter, content types, chunks with their errors, keys and hashes, embeddings.
The tables are written to a staging version and the snapshot's row last, so readers never see half a version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ask, cells, chunking, coverage, inverted, rollups, search, summaries
from tessera.sources import content_type, ignore


#: Directories of a version's keywords: a version is a repository's, so its postings are small.
KEYWORD_BUCKETS = 8
#: Documents of a slice of its keywords: chunks are short.
KEYWORD_SLICE = 4096


@dataclass(frozen=True)
class Result:
    """A-15: what an index run did; ``skipped`` when the version was indexed before."""

    files: int = 0
    failed: int = 0
    chunks: int = 0
    skipped: bool = False


def by_name_and_content(path: Column, content: Column) -> tuple[Column, Column]:
    """U-02: content type and language; another detector may stand in its place."""
    return content_type.content_type(path, content), content_type.language(path, content)


def prepare_files(docs: DataFrame, snapshot_id: str, patterns: tuple[str, ...] = (), detect: Callable[[Column, Column], tuple[Column, Column]] = by_name_and_content) -> DataFrame:
    """Files (id, snapshot_id, path, size, content_type, language, domain, content_hash, content) of documents (path, content bytes)."""
    rows = docs.filter(~ignore.ignored(F.col("path"), patterns))
    body, (kind, language) = F.col("content").cast("string"), detect(F.col("path"), F.col("content"))
    return rows.select(
        F.xxhash64(F.lit(snapshot_id), "path").alias("id"), F.lit(snapshot_id).alias("snapshot_id"), "path", F.octet_length("content").cast("bigint").alias("size"),
        kind.alias("content_type"), language.alias("language"),
        text.classify_domain(F.col("path")).alias("domain"), F.sha2("content", 256).alias("content_hash"), body.alias("content"),
    )


def prepare_chunks(files: DataFrame, product: str, source: str, version: str, limits: chunking.Limits = chunking.Limits()) -> DataFrame:
    """Chunks of files with id, key, content hash, metrics and defaults (level 2, latest); parse errors stay as rows."""
    rows = chunking.chunk_files(files, limits, carried=("path",))
    key = text.chunk_key(F.lit(product), F.lit(source), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("ordinal"), F.lit(version))
    rows = rows.withColumn("chunk_key", F.when(F.col("error").isNull(), key)).withColumn("_m", text.code_lines(F.col("content")))
    return rows.withColumns(
        {
            "id": F.xxhash64("chunk_key"), "content_hash": text.content_hash(F.col("content")), "is_latest": F.lit(True), "git_commit_hash": F.lit(version),
            "lines_of_code": F.col("_m.loc"), "comment_ratio": text.comment_ratio(F.col("_m")).cast("decimal(3,2)"), "cyclomatic_complexity": text.branch_count(F.col("content")),
        }
    ).drop("_m")


def stats(chunks: DataFrame) -> DataFrame:
    """C-23: files, files that could not be parsed, chunks and their complexity, by kind of chunk."""
    complexity = F.col("cyclomatic_complexity")
    return chunks.groupBy("chunk_type").agg(
        F.count_distinct("file_id").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull()).alias("chunks"),
        F.round(F.avg(complexity), 4).alias("mean_complexity"), F.max(complexity).alias("max_complexity"),
    )


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def indexed(spark: SparkSession, root: str, snapshot_id: str) -> bool:
    return there(spark, f"{root}/snapshots") and not spark.read.parquet(f"{root}/snapshots").filter(F.col("id") == snapshot_id).isEmpty()


def opening(body: Column) -> Column:
    """The offline summary: how a text begins."""
    return F.substring(body, 1, 400)


def _before(spark: SparkSession, root: str, source: str) -> DataFrame:
    """The summaries of the source's indexed versions."""
    none = spark.createDataFrame([], "summary_type string, target_path string, arch_type string, source_hash string, content string")
    if not there(spark, f"{root}/snapshots") or not there(spark, f"{root}/summaries"):
        return none
    mine = spark.read.parquet(f"{root}/snapshots").filter(F.col("source_id") == source).select(F.col("id").alias("snapshot_id"))
    return spark.read.parquet(f"{root}/summaries").join(search.small(mine), "snapshot_id", "left_semi").select(*none.columns)


def _listing(spark: SparkSession, root: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """A version's files, each marked whether it could be parsed, and its chunks."""
    chunks = spark.read.parquet(f"{root}/chunks/snapshot_id={snapshot_id}")
    bad = chunks.filter("error is not null").select(F.col("file_id").alias("id"), F.lit(False).alias("_parsed")).distinct()
    files = spark.read.parquet(f"{root}/files/snapshot_id={snapshot_id}").select("id", "path", "content_hash", "domain")
    return files.join(bad, "id", "left").withColumn("indexed", F.coalesce("_parsed", F.lit(True))).drop("_parsed"), chunks.filter("error is null")


def _cover(spark: SparkSession, root: str, source_id: str, snapshot_id: str) -> None:
    """A-03, A-17: the version's coverage from that of the source's last indexed one."""
    before = None
    if there(spark, f"{root}/snapshots"):
        mine = spark.read.parquet(f"{root}/snapshots").filter((F.col("source_id") == source_id) & (F.col("id") != snapshot_id))
        before = mine.agg(F.max_by("id", F.struct("indexed_at", "id"))).first()[0]
    if before is not None and there(spark, f"{root}/coverage/version={before}"):
        rollups.refresh(f"{root}/coverage", snapshot_id, *_listing(spark, root, snapshot_id), before, *_listing(spark, root, before))
    else:
        rollups.refresh(f"{root}/coverage", snapshot_id, *_listing(spark, root, snapshot_id))


def index(docs: DataFrame, root: str, product: str, source: str, version: str, embedder: ask.Embedder | None = None, patterns: tuple[str, ...] = (), limits: chunking.Limits = chunking.Limits(), most_failed: float = 1.0, most_unwritten: float = 0.3, write: Callable[[Column], Column] = opening, force: bool = False, source_id: str | None = None, detect: Callable[[Column, Column], tuple[Column, Column]] = by_name_and_content, measure: Callable[[DataFrame], None] | None = None, classify: Callable[[DataFrame], DataFrame] | None = None) -> Result:
    """D-01, D-09: write files, chunks, coverage, keywords, embeddings and their cells, summaries and their embeddings of a version below ``root``, partitioned by snapshot, then its snapshot row.

    What an earlier version of the source has a summary of is not summarised again.  Files that can't be parsed are left
    out one by one (D-02), and raise beyond ``most_failed`` of all; more than ``most_unwritten`` of a step's summaries that the model fails to write raise (A-16).

    ``classify`` may fill in the files' languages from their contents (S-13, ``content_model.filled``).
    ``measure`` gets what ``stats`` tells of the chunks (U-08).
    A version that has its row is left alone (D-03) unless ``force`` writes its tables anew; leftovers of a run that broke off are overwritten.
    """
    spark, snapshot_id = docs.sparkSession, f"{source}@{version}"
    source_id, known = source_id or source, indexed(spark, root, snapshot_id)
    if known and not force:
        return Result(skipped=True)
    at = f"snapshot_id={snapshot_id}"
    prepared = prepare_files(docs, snapshot_id, patterns, detect)
    counted, chunked = Observation(), Observation()
    (classify(prepared) if classify else prepared).drop("snapshot_id").observe(counted, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/files/{at}")
    files = spark.read.parquet(f"{root}/files/{at}")
    # Numbers are taken by the jobs that write: a file's first chunk has the ordinal 0, one that can't be parsed a row with its error.
    bad, first = F.col("error").isNotNull(), F.col("ordinal") == 0
    numbers = (F.count_if(bad).alias("failed"), F.count_if(bad | first).alias("files"), F.count_if(~bad).alias("chunks"))
    prepare_chunks(files, product, source, version, limits).observe(chunked, *numbers).write.mode("overwrite").parquet(f"{root}/chunks/{at}")
    chunks = spark.read.parquet(f"{root}/chunks/{at}")
    _, failed = coverage.check_failures(chunked.get["files"], chunked.get["failed"], most_failed)
    _cover(spark, root, source_id, snapshot_id)
    good = chunks.filter("error is null")
    inverted.add(good.select("id", F.col("content").alias("text")), f"{root}/keywords", snapshot_id, KEYWORD_BUCKETS, KEYWORD_SLICE)
    context = good.select(F.col("id").alias("chunk_id"), "path", ask.embedding_context(F.col("content"), F.col("path"), name=F.col("chunk_name"), parent=F.col("parent_name")).alias("content"))
    embedder = embedder or ask.HashingEmbedder()
    ask.embed(context, embedder).select("chunk_id", "path", "vector").write.mode("overwrite").parquet(f"{root}/embeddings/{at}")
    cells.add(spark.read.parquet(f"{root}/embeddings/{at}").withColumn("snapshot_id", F.lit(snapshot_id)), f"{root}/cells")
    bad_files = chunks.filter("error is not null").select(F.col("file_id").alias("id")).distinct()
    parsed = files.join(search.small(bad_files), "id", "left_anti").withColumn("snapshot_id", F.lit(snapshot_id))
    before = _before(spark, root, source_id)
    all_ = summaries.summarise_all(parsed, before, write, most_unwritten)
    all_.drop("snapshot_id").write.mode("overwrite").parquet(f"{root}/summaries/{at}")
    kept = spark.read.parquet(f"{root}/summaries/{at}").withColumn("snapshot_id", F.lit(snapshot_id))
    none = spark.createDataFrame([], "summary_id bigint, content_hash string, vector array<float>")
    vectors = summaries.upsert_vectors(kept, none, lambda rows: ask.embed(rows, embedder))
    vectors.write.mode("overwrite").parquet(f"{root}/summary_embeddings/{at}")
    if measure:
        measure(stats(chunks))
    if not known:
        row = spark.createDataFrame([(snapshot_id, source_id, version, True)], "id string, source_id string, version_identifier string, indexed boolean")
        row.withColumn("indexed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/snapshots")
    return Result(counted.get["n"], failed, chunked.get["chunks"])
