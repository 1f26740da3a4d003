"""Directory trees, roll-ups and change-driven summaries (A-05, A-16, D-05 to D-10, H-07, H-08, S-08, S-09)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.coverage import check_failure_rate
from tessera.operators.lineage import cut

ARCHITECTURE_TYPES = ("overview", "tech_stack", "data_flow", "components")
PROMPT_BYTES = 8_000
#: Parts of a group whose lines are cut to a prompt by tasks of their own.
PARTS = 64


def directories(files: DataFrame) -> DataFrame:
    """H-07: path, parent, depth, direct files and subdirectories of every directory above a file (the root is '')."""
    dirs = files.select(F.explode(text.ancestors(F.col("path"))).alias("path")).distinct()
    dirs = dirs.withColumn("parent", F.when(F.col("path") != "", text.dirname(F.col("path")))).withColumn("depth", text.depth(F.col("path")))
    direct = files.groupBy(text.dirname(F.col("path")).alias("path")).agg(F.count("*").alias("files"))
    below = dirs.filter("path <> ''").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("subdirs"))
    rows = dirs.join(direct, "path", "left").join(below, "path", "left")
    return rows.select("path", "parent", "depth", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("subdirs", F.lit(0)).alias("subdirs"))


def recursive_counts(files: DataFrame) -> DataFrame:
    """H-08: files under each directory at any depth, by language, as one map a directory."""
    rows = files.select(F.explode(text.ancestors(F.col("path"))).alias("path"), "language").groupBy("path", "language").agg(F.count("*").alias("n"))
    return rows.groupBy("path").agg(F.sum("n").alias("files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))


def folded(rows: DataFrame, group: Sequence[str], member: str, name: str) -> DataFrame:
    """D-06, D-07: for each group the SHA-256 of its members' hashes, sorted and joined by colons; members that are NULL don't count.

    Rows arrive sorted within their group and are fed to a running digest, which goes on from one Arrow batch to the next: a group
    of any size takes a task one batch of memory, and nothing is collected.
    """
    plain = rows.select(*group, F.col(member).cast("string").alias("_member"))
    dealt = plain.repartition(*group).sortWithinPartitions(*group, "_member")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:-1]) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, empty = None, hashlib.sha256(), True
        done: list[tuple] = []

        def batch_of(part: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], part.column(i).type) for i in range(len(group))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([h for _, h in done], pa.string())], names=[*group, name])

        batch = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(group)))))
            members = batch.column(len(group)).to_pylist()
            for now, part in groupby(zip(keys, members), itemgetter(0)):
                if now != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest, empty = now, hashlib.sha256(), True
                some = [m for _, m in part if m is not None]
                if some:
                    digest.update((":" * (not empty) + ":".join(some)).encode())
                    empty = False
            if len(done) >= 10_000:
                yield batch_of(batch)
                done.clear()
        if key is not None:
            done.append((key, digest.hexdigest()))
            yield batch_of(batch)

    return dealt.mapInArrow(run, schema)


def directory_hashes(files: DataFrame) -> DataFrame:
    """D-06, D-07: a hash for every directory from its files' and its subdirectories' hashes, deepest first.

    One fold a depth; a parent's hash changes if and only if something under it did.
    """
    own = files.select(text.dirname(F.col("path")).alias("path"), F.col("content_hash").alias("hash"))
    depth = text.depth(F.col("path"))
    deepest = files.agg(F.max(text.depth(text.dirname(F.col("path"))))).first()[0]
    done = None
    level = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        parts = own.filter(depth == d)
        if level is not None:
            parts = parts.unionAll(level.select(text.dirname(F.col("path")).alias("path"), "hash"))
        level = cut(folded(parts, ["path"], "hash", "hash"))
        done = level if done is None else done.unionAll(level)
    return done if done is not None else own.limit(0)


def group_hashes(rows: DataFrame, group: str, hash_: str) -> DataFrame:
    """D-07 for one level."""
    return folded(rows, [group], hash_, "source_hash")


def changed(now: DataFrame, summaries: DataFrame, key: str = "path") -> DataFrame:
    """D-05, D-08: what has no summary of its current source_hash."""
    return now.join(summaries.select(key, "source_hash"), [key, "source_hash"], "left_anti")


def prompt_body(chunks: DataFrame, most: int = PROMPT_BYTES) -> DataFrame:
    """D-05: file_id and its chunks in order, cut to ``most`` bytes; files' chunks are bounded by the file."""
    joined = chunks.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n").alias("body"))
    return joined.select("file_id", F.substring(F.col("body").cast("binary"), 1, most).cast("string").alias("body"))


def summarise(now: DataFrame, summaries: DataFrame, write: Callable[[Column], Column], key: str = "path") -> DataFrame:
    """D-05, D-10: new summaries (key, source_hash, content, content_hash) where something changed, old ones elsewhere.

    now: key, source_hash, body.  write: the language model as a column function.
    """
    new = changed(now, summaries, key).select(key, "source_hash", write(F.col("body")).alias("content"))
    new = new.withColumn("content_hash", F.sha2("content", 256))
    return summaries.join(new.select(key), key, "left_anti").unionByName(new)


#: What a summary is of, and what it was written from.
KEY = ("summary_type", "target_path", "arch_type")
SUMMARY = ("snapshot_id", *KEY, "depth", "source_hash", "content", "content_hash")


def bounded_body(rows: DataFrame, group: Sequence[str], most: int = PROMPT_BYTES) -> DataFrame:
    """group and body: the lines (path, line) in the order of their paths, as many as ``most`` bytes hold, the first one cut to it.

    A running sum picks the lines before they are collected, so a group of any size leaves a bounded row.  What a part of the group
    alone leaves no room for has none in the group, so ``PARTS`` parts are cut by tasks of their own first.
    """

    def held_by(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
        summed = rows.withColumn("_sum", F.sum(F.octet_length("line") + 1).over(order)).withColumn("_n", F.count("*").over(order))
        return summed.filter((F.col("_sum") <= most + 1) | (F.col("_n") == 1)).drop("_sum", "_n")

    parts = held_by(rows.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(PARTS))), *group, "_part").drop("_part")
    held = held_by(parts, *group)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"])
    body = F.substring(F.array_join(lines, "\n").cast("binary"), 1, most).cast("string")
    return held.groupBy(*group).agg(body.alias("body"))


def renewed(now: DataFrame, old: DataFrame, write: Callable[[Column], Column], most_failed: float = 0.3) -> DataFrame:
    """D-05, D-08, A-16: summaries of ``now`` (KEY, snapshot_id, depth, source_hash, body): old contents where the source is the same, else written.

    A summary that the model fails to write (NULL) is left out; more than ``most_failed`` of those written raise.
    """
    held = old.filter("content is not null").dropDuplicates([*KEY, "source_hash"]).select(*(F.col(c).alias(f"_old_{c}") for c in (*KEY, "source_hash", "content")))
    condition = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in (*KEY, "source_hash")])
    mine = ("snapshot_id", *KEY, "depth", "source_hash")
    kept = now.join(held, condition).select(*mine, F.col("_old_content").alias("content"))
    new = now.join(held, condition, "left_anti").select(*mine, write(F.col("body")).alias("content"))
    rows = kept.withColumn("_new", F.lit(False)).unionAll(new.withColumn("_new", F.lit(True)))
    rows = cut(rows.withColumn("content_hash", F.sha2("content", 256)))
    check_failure_rate(rows.filter("_new").select(F.col("content").isNull().alias("failed")), most=most_failed)
    return rows.filter("content is not null").select(*SUMMARY)


def of_files(files: DataFrame) -> DataFrame:
    """What file summaries are written from: files (snapshot_id, path, content_hash, content)."""
    body = F.substring(F.col("content").cast("binary"), 1, PROMPT_BYTES).cast("string")
    return files.select("snapshot_id", F.lit("file").alias("summary_type"), F.col("path").alias("target_path"), F.lit(None).cast("string").alias("arch_type"), F.lit(None).cast("int").alias("depth"), F.col("content_hash").alias("source_hash"), body.alias("body"))


def of_directories(children: DataFrame, depth: int) -> DataFrame:
    """D-06, D-07: what the summaries of one depth are written from: the summaries of their files and subdirectories."""
    group = ("snapshot_id", "target_path")
    rows = children.select("snapshot_id", text.dirname(F.col("target_path")).alias("target_path"), F.col("target_path").alias("path"), "source_hash", F.concat("target_path", F.lit(": "), "content").alias("line"))
    hashes = folded(rows, group, "source_hash", "source_hash")
    bodies = bounded_body(rows, group)
    return hashes.join(bodies, list(group)).select("snapshot_id", F.lit("directory").alias("summary_type"), "target_path", F.lit(None).cast("string").alias("arch_type"), F.lit(depth).alias("depth"), "source_hash", "body")


def of_architecture(directories_: DataFrame) -> DataFrame:
    """D-08: what the four architecture summaries of each snapshot are written from: its directories' summaries."""
    rows = directories_.select("snapshot_id", F.col("target_path").alias("path"), "source_hash", F.concat("target_path", F.lit(": "), "content").alias("line"))
    hashes = folded(rows, ["snapshot_id"], "source_hash", "source_hash")
    per = hashes.join(bounded_body(rows, ("snapshot_id",)), "snapshot_id")
    kinds = F.explode(F.array(*[F.lit(k) for k in ARCHITECTURE_TYPES])).alias("arch_type")
    per = per.select("snapshot_id", "source_hash", "body", kinds)
    return per.select("snapshot_id", F.lit("architecture").alias("summary_type"), F.lit("").alias("target_path"), "arch_type", F.lit(None).cast("int").alias("depth"), "source_hash", F.concat("arch_type", F.lit("\n"), "body").alias("body"))


def architecture(directories_: DataFrame, write: Callable[[Column], Column]) -> DataFrame:
    """The four architecture texts of each snapshot from its directories' numbers (snapshot_id, hash, files); counts are summed, not lost."""
    counts = directories_.groupBy("snapshot_id").agg(F.sum("files").alias("files"), F.count("*").alias("directories"))
    per = folded(directories_, ["snapshot_id"], "hash", "source_hash").join(counts, "snapshot_id")
    kinds = F.explode(F.array(*[F.lit(k) for k in ARCHITECTURE_TYPES])).alias("arch_type")
    rows = per.select("snapshot_id", "source_hash", "files", "directories", kinds)
    return rows.withColumn("content", write(F.format_string("%s: %d files in %d directories", "arch_type", "files", "directories")))


def summarise_all(files: DataFrame, old: DataFrame, write: Callable[[Column], Column], most_failed: float = 0.3) -> DataFrame:
    """D-09: the summaries (SUMMARY) of files, then of directories from the deepest up, then of the architecture.

    Each step reads what the one before wrote; nothing whose source_hash has a summary in ``old`` is written again, and each
    depth of directories has a failure gate of its own.
    """
    done = renewed(of_files(files), old, write, most_failed)
    level, directories_ = None, None
    depth = done.agg(F.max(text.depth(text.dirname(F.col("target_path"))))).first()[0]
    for d in range(depth if depth is not None else -1, -1, -1):
        here = done.filter(text.depth(text.dirname(F.col("target_path"))) == d)
        if level is not None:  # the directories a level deeper
            here = here.unionAll(level)
        level = renewed(of_directories(here, d), old, write, most_failed)
        directories_ = level if directories_ is None else directories_.unionAll(level)
    if directories_ is None:
        return done
    return done.unionAll(directories_).unionAll(renewed(of_architecture(directories_), old, write, most_failed))


def summary_id() -> Column:
    return F.xxhash64("snapshot_id", *(F.coalesce(F.col(k), F.lit("")) for k in KEY))


def upsert_vectors(summaries: DataFrame, old: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """D-10: summary_id, content_hash, vector of each summary; only contents that changed are embedded again."""
    now = summaries.select(summary_id().alias("summary_id"), "content_hash", "content")
    kept = now.join(old.select("summary_id", "content_hash", "vector"), ["summary_id", "content_hash"]).select("summary_id", "content_hash", "vector")
    new = embed(now.join(old.select("summary_id", "content_hash"), ["summary_id", "content_hash"], "left_anti"))
    return kept.unionAll(new.select("summary_id", "content_hash", "vector"))


def edit_frequency(commits: DataFrame, since: str) -> DataFrame:
    """S-09: edits of each path since a time, and the last one."""
    return commits.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).groupBy("path").agg(F.count("*").alias("edits"), F.max("ts").alias("last_edit"))


def last_commit(commits: DataFrame) -> DataFrame:
    """S-08: the commit that last changed each path."""
    last = F.max(F.struct("ts", "event_id", "hash", "author"))
    return commits.groupBy("path").agg(last.alias("c")).select("path", "c.hash", "c.author", "c.ts")
