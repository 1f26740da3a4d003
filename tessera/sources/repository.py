"""Git repositories as a data source, and their history (S-01 to S-11, S-19, S-20, U-06).

``spark.read.format("repository")`` lists a revision once on the driver and reads its blobs by slices of the
list; ``repository_history`` does the same with commits.  The repository must lie where every executor can read it.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size bigint, content binary, content_hash string, version string"
SLICE = 256


def git(repo: str, *args: str, text: bool = True):
    run = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=600)
    if run.returncode:
        raise RuntimeError(run.stderr.decode(errors="replace").strip())
    return run.stdout.decode(errors="replace") if text else run.stdout


def resolve(repo: str, ref: str = "HEAD") -> str:
    """S-04: a local branch, a remote one, a tag, HEAD or a commit, in this order, as a commit hash."""
    for name in (f"refs/heads/{ref}", f"refs/remotes/origin/{ref}", f"refs/tags/{ref}", ref):
        try:
            return git(repo, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}").strip()
        except RuntimeError:
            continue
    raise ValueError(f"no such revision: {ref}")


def fetch(url: str, directory: str, ref: str | None = None) -> str:
    """S-03: clone, or fetch and check out the remote's state by force; returns the folder.

    The clone is managed: its branch follows the remote one, moved tags move, and what the remote has dropped goes.
    """
    if os.path.isdir(os.path.join(directory, ".git")):
        git(directory, "fetch", "--tags", "--force", "--prune", "--prune-tags", "origin")
        git(directory, "remote", "set-head", "origin", "--auto")
    else:
        subprocess.run(["git", "clone", url, directory], check=True, capture_output=True, timeout=3600)
    if ref:
        _check_out(directory, ref)
    return directory


def _check_out(directory: str, ref: str) -> None:
    known = lambda name: subprocess.run(["git", "-C", directory, "show-ref", "--verify", "--quiet", name]).returncode == 0
    if known(f"refs/remotes/origin/{ref}"):
        git(directory, "checkout", "--force", "-B", ref, f"refs/remotes/origin/{ref}")
        return
    git(directory, "checkout", "--force", "--detach")
    if known(f"refs/heads/{ref}"):
        git(directory, "branch", "-D", ref)
    git(directory, "checkout", "--force", "--detach", f"refs/tags/{ref}" if known(f"refs/tags/{ref}") else f"{ref}^{{commit}}")


@dataclass
class Slice(InputPartition):
    entries: list[tuple[str, str, int]]


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.slice = options["path"], int(options.get("slice", SLICE))
        self.version = resolve(self.repo, options.get("ref", "HEAD"))

    def partitions(self) -> list[InputPartition]:
        entries = []
        for line in git(self.repo, "ls-tree", "-r", "-l", "-z", self.version).split("\0"):
            if line:
                meta, path = line.split("\t", 1)
                _, kind, blob, size = meta.split()
                if kind == "blob":
                    entries.append((path, blob, int(size)))
        return [Slice(entries[i : i + self.slice]) for i in range(0, len(entries), self.slice)] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        """The slice's blobs through one process, one after the other."""
        command = ["git", "-C", self.repo, "cat-file", "--batch"]
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
            for path, blob, size in partition.entries:
                run.stdin.write(blob.encode() + b"\n")
                run.stdin.flush()
                head = run.stdout.readline().split()
                if len(head) < 3:  # "<id> missing": a file that can't be read is skipped
                    continue
                content = run.stdout.read(int(head[2]))
                run.stdout.read(1)
                yield path, size, content, hashlib.sha256(content).hexdigest(), self.version
            run.stdin.close()


@dataclass
class Commits(InputPartition):
    first: int
    hashes: list[str]


class HistoryReader(DataSourceReader):
    """The driver lists the commits' hashes; what each changed is read by slices of the list."""

    def __init__(self, options: dict):
        self.repo, self.slice = options["path"], int(options.get("slice", SLICE))
        self.version = resolve(self.repo, options.get("ref", "HEAD"))

    def partitions(self) -> list[InputPartition]:
        hashes = git(self.repo, "rev-list", "--first-parent", "--reverse", self.version).split()
        return [Commits(i, hashes[i : i + self.slice]) for i in range(0, len(hashes), self.slice)] or [Commits(0, [])]

    def read(self, partition: Commits) -> Iterator[tuple]:
        if not partition.hashes:
            return
        log = git(self.repo, "log", "--no-walk=unsorted", "--first-parent", "-m", "--name-only", "-M", "--root", "--format=%x01%H%x02%an%x02%cI", *partition.hashes)
        place = {h: partition.first + i for i, h in enumerate(partition.hashes)}
        for commit in log.split("\x01")[1:]:
            head, *paths = commit.strip().split("\n")
            hash_, author, ts = head.split("\x02")
            yield from ((p, hash_, author, ts, place[hash_]) for p in paths if p)


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_history"

    def schema(self) -> str:
        return "path string, hash string, author string, ts string, event_id bigint"

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


def documents(spark: SparkSession, repo: str, ref: str = "HEAD") -> DataFrame:
    """S-02, S-05, S-06."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("path", repo).option("ref", ref).load()


def history(spark: SparkSession, repo: str, ref: str = "HEAD") -> DataFrame:
    """S-07 to S-09: path, hash, author, ts, event_id: one row a changed path and commit, against the first parent.

    A rename counts under the new name; the first commit changes every file.
    """
    spark.dataSource.register(HistorySource)
    out = spark.read.format("repository_history").option("path", repo).option("ref", ref).load()
    return out.withColumn("ts", F.to_utc_timestamp(F.to_timestamp("ts"), F.current_timezone()).cast("timestamp_ntz"))


def metadata(url: str, default_ref: str | None = None, local_path: str | None = None) -> dict[str, str]:
    """S-11."""
    return {k: v for k, v in (("url", url), ("default_ref", default_ref), ("localPath", local_path)) if v}


@dataclass(frozen=True)
class Settings:
    """S-19: what the environment sets."""

    chunk_workers: int = 4
    embedding_workers: int = 8
    embedding_batch: int = 100

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        return cls(**{f: int(env[f"TESSERA_{f.upper()}"]) for f in cls.__dataclass_fields__ if f"TESSERA_{f.upper()}" in env})


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """S-20: cost of usage (model, input_tokens, output_tokens) by prices per 1,000 tokens (model, input_price, output_price)."""
    rows = usage.join(prices, "model", "left")
    return rows.withColumn("cost", F.col("input_tokens") / 1000 * F.col("input_price") + F.col("output_tokens") / 1000 * F.col("output_price"))
