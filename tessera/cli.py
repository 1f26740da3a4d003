"""The command line: products, sources, indexing of repositories, questions and wikis over one folder of tables.

    python -m tessera --root DIR product list | product show NAME | source list [--product NAME] | source show ID
    python -m tessera --root DIR index git --url URL --product NAME [--ref REF] [--force-init] [--generate-wiki]
    python -m tessera --root DIR find --product NAME [--limit N] WORD...
    python -m tessera --root DIR ask --product NAME [--show-sources] QUESTION
    python -m tessera --root DIR wiki generate --product NAME [--out DIR]

Without a model of one's own (``main(model=..., embedder=...)``) answers and pages are the prompts themselves, and embeddings hash words.
The folder holds what ``indexing.index`` writes, and ``sources``, a row a source with its product.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ask, catalog, cells, indexing, inverted, rollups, search, versions
from tessera.sources import repository

SOURCES = "id string, product string, url string, default_ref string"


class Store:
    """The tables below a folder; one that isn't there yet is empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.parquet(path) if indexing.there(self.spark, path) else self.spark.createDataFrame([], schema)

    def sources(self) -> DataFrame:
        rows = versions.read(self.spark, f"{self.root}/sources").rows
        return self.spark.createDataFrame([], SOURCES) if rows is None else rows

    def snapshots(self) -> DataFrame:
        return self.table("snapshots", "id string, source_id string, version_identifier string, indexed boolean, indexed_at timestamp").withColumn("created_at", F.col("indexed_at"))

    def add_source(self, source: str, product: str, url: str, ref: str | None) -> None:
        """M-04: a source is added once, whoever else adds one at the same time; it keeps its product."""
        new = self.spark.createDataFrame([(source, product, url, ref)], SOURCES)
        if self.sources().filter(F.col("id") == source).isEmpty():
            versions.change(self.spark, f"{self.root}/sources", lambda old: (new if old is None else catalog.insert_or_ignore(old, new, ["id"])).coalesce(1))

    def latest(self, product: str) -> DataFrame:
        """snapshot_id: the latest indexed version of each of the product's sources."""
        mine = self.sources().filter(F.col("product") == product).select(F.col("id").alias("source_id"))
        return search.small(search.latest_snapshots(self.snapshots().join(mine, "source_id", "left_semi")).select(F.col("id").alias("snapshot_id")))

    def find(self, product: str) -> Callable[[Sequence[float]], tuple[DataFrame, DataFrame]]:
        """For a query's vector the chunks and summaries (chunk_id, path, content, score) of a hybrid search."""
        latest, chunks = self.latest(product), self.spark.read.parquet(f"{self.root}/chunks").filter("error is null")
        index = cells.CellIndex(self.spark, f"{self.root}/cells")
        summaries = self.spark.read.parquet(f"{self.root}/summaries")
        about = self.spark.read.parquet(f"{self.root}/summary_embeddings").select(F.col("summary_id").alias("chunk_id"), "vector")
        from tessera.operators.summaries import summary_id

        summaries = summaries.withColumn("id", summary_id())

        def run(vector: Sequence[float]) -> tuple[DataFrame, DataFrame]:
            # Versions are partitions of vectors, chunks and summaries: of all three only the latest are read.
            code = index.search(vector, versions=latest).hits.select("snapshot_id", "chunk_id", "path", "score")
            held = chunks.join(latest, "snapshot_id").select("snapshot_id", F.col("id").alias("chunk_id"), "content")
            code = held.join(F.broadcast(code), ["snapshot_id", "chunk_id"]).select("chunk_id", "path", "content", "score")  # a top-k
            found = search.search_summaries(summaries, about, vector, within=latest).join(summaries.select("id", "content"), "id")
            return code, found.select(F.col("id").alias("chunk_id"), F.col("target_path").alias("path"), "content", "score")

        return run


    def coverage(self, product: str) -> DataFrame:
        """A-03 of the product's latest versions, by domain, from their stored sums; versions of older runs have none."""
        latest = [r["snapshot_id"] for r in self.latest(product).collect()]  # a row a source
        held = [rollups.state(self.spark, f"{self.root}/coverage", x) for x in latest if indexing.there(self.spark, f"{self.root}/coverage/version={x}")]
        return rollups.coverage(rollups.merged(*held)).orderBy("domain") if held else self.spark.createDataFrame([], "domain string")

    def words(self, product: str, query: Sequence[str], limit: int) -> DataFrame:
        """path, start_line, end_line, keyword: the product's chunks that tell most of the words (R-02)."""
        versions = [r["snapshot_id"] for r in self.latest(product).collect()]  # a row a source
        best = inverted.Index(self.spark, f"{self.root}/keywords", versions).best(query, limit)
        chunks = self.spark.read.parquet(f"{self.root}/chunks").filter(F.col("snapshot_id").isin(versions))
        return chunks.join(F.broadcast(best), "id").select("path", "start_line", "end_line", "keyword").orderBy(F.desc("keyword"), "path", "start_line")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--root", default=os.environ.get("TESSERA_ROOT", "tessera-data"))
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("product", "source"):
        actions = commands.add_parser(name).add_subparsers(dest="action", required=True)
        listed = actions.add_parser("list")
        if name == "source":
            listed.add_argument("--product")
        actions.add_parser("show").add_argument("name")
    git = commands.add_parser("index").add_subparsers(dest="action", required=True).add_parser("git")
    git.add_argument("--url", required=True)
    git.add_argument("--product", required=True)
    git.add_argument("--ref")
    git.add_argument("--force-init", action="store_true")
    git.add_argument("--generate-wiki", action="store_true")
    find = commands.add_parser("find")
    find.add_argument("--product", required=True)
    find.add_argument("--limit", type=int, default=search.DEFAULT_LIMIT)
    find.add_argument("words", nargs="+")
    commands.add_parser("coverage").add_argument("--product", required=True)
    question = commands.add_parser("ask")
    question.add_argument("--product", required=True)
    question.add_argument("--show-sources", action="store_true")
    question.add_argument("question")
    wiki = commands.add_parser("wiki").add_subparsers(dest="action", required=True).add_parser("generate")
    wiki.add_argument("--product", required=True)
    wiki.add_argument("--out")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, embedder: ask.Embedder | None = None, model: Callable[[str], str] = lambda prompt: prompt, say: Callable[[str], None] = print) -> int:
    args = parser().parse_args(argv)
    spark, embedder = spark or SparkSession.builder.appName("tessera").getOrCreate(), embedder or ask.HashingEmbedder()
    store = Store(spark, args.root)
    tell = lambda rows: [say(json.dumps(r.asDict(), default=str, ensure_ascii=False)) for r in rows]
    if args.command in ("product", "source"):
        return _listed(args, store, tell)
    if args.command == "index":
        _index(args, store, embedder, say)
        if not args.generate_wiki:
            return 0
        args.out = None
    if args.command == "find":
        tell(store.words(args.product, args.words, args.limit).collect())
        return 0
    if args.command == "coverage":
        tell(store.coverage(args.product).collect())
        return 0
    if args.command == "ask":
        search.check_search(args.question, product_id=args.product)
        code, structure = store.find(args.product)(embedder.embed([args.question])[0])
        got = ask.ask(args.question, code, structure, model)
        say(got["answer"])
        for source in got["sources"] if args.show_sources else ():
            say(json.dumps(source, ensure_ascii=False))
        return 0
    out = args.out or os.path.join(args.root, "wiki", args.product)
    for section, path in ask.generate_wiki(ask.section_contexts(store.find(args.product), embedder), model, out).items():
        say(f"{section}: {path}")
    return 0


def _listed(args: argparse.Namespace, store: Store, tell: Callable) -> int:
    indexed = store.snapshots().filter("indexed").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("versions"), F.max("indexed_at").alias("last_indexed_at"))
    rows = store.sources().join(indexed, "id", "left").withColumn("versions", F.coalesce("versions", F.lit(0)))
    if args.command == "product":
        if args.action == "list":
            rows = rows.groupBy("product").agg(F.count("*").alias("sources"), F.sum("versions").alias("versions"), F.max("last_indexed_at").alias("last_indexed_at")).orderBy("product")
        else:
            rows = rows.filter(F.col("product") == args.name).orderBy("id")
    elif args.action == "show":
        rows = store.snapshots().filter(F.col("source_id") == args.name).drop("created_at").orderBy("id")
    else:
        rows = (rows.filter(F.col("product") == args.product) if args.product else rows).orderBy("id")
    found = rows.collect()  # catalogue rows, one a product, source or version
    tell(found)
    return 0 if found or args.action == "list" else 1


def _index(args: argparse.Namespace, store: Store, embedder: ask.Embedder, say: Callable[[str], None]) -> None:
    spark = store.spark
    source = spark.range(1).select(text.source_name(F.lit(args.url))).first()[0]
    folder = os.path.join(args.root, "repositories", hashlib.sha256(args.url.encode()).hexdigest()[:16])
    store.add_source(source, args.product, args.url, args.ref)
    with versions.lease(spark, args.root, source, ""):  # all refs of a source share its clone
        repository.fetch(args.url, folder, args.ref)
        version = repository.resolve(folder, args.ref or "HEAD")
        done = indexing.index(repository.documents(spark, folder, version), args.root, args.product, source.replace("/", "_"), version, embedder, force=args.force_init, source_id=source)
    say(json.dumps({"source": source, "version": version, "files": done.files, "failed": done.failed, "chunks": done.chunks, "skipped": done.skipped}))
