"""Every registered query of the engine with its SQL oracle, by name.

A query binds an operator to the driver's tables in the roles of ``tessera.sources.views``; its oracle is
written over the same roles in SQL.  Queries without SQL are checked by tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ask, catalog, cells, chunking, coverage, gocode, graph, indexing, inverted, kpis, lineage, linechunks, ranking, rollups, scopes, search, summaries, tour, versions
from tessera.plans.kept import kept
from tessera.plans.oracle_views import with_views
from tessera.sources import content_model, content_type, ignore, repository
from tessera.sources.views import Views
from tessera.streaming import edits, latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-02-15"


def query(sql: str | None = None):
    def register(f: Callable[[Views], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return register


# Vector and hybrid search


def _add_cells(v: Views, root: str) -> None:
    files = v.files.select(F.col("id").alias("chunk_id"), "snapshot_id", "path", "content_type")
    rows = v.embeddings.join(files, "chunk_id", "left")  # a vector without a file is of no version
    cells.add(rows.select("snapshot_id", "chunk_id", "path", "content_type", "model", "vector"), root)


def _cells(v: Views) -> cells.CellIndex:
    return kept(v.table("embeddings"), "cells", lambda root: _add_cells(v, root), lambda root: cells.CellIndex(v.spark, root))


def _where(path_prefix: str | None = None, content_type: str | None = None) -> Column | None:
    conditions = ([F.col("path").startswith(path_prefix)] if path_prefix else []) + ([F.col("content_type") == content_type] if content_type else [])
    return reduce(Column.__and__, conditions) if conditions else None


def _within(v: Views, product: int) -> DataFrame:
    """The latest versions of a product's sources, broadcast if they are few; the vectors' versions are pruned by it at run time."""
    mine = v.sources.filter(F.col("product_id") == product).select(F.col("id").alias("source_id"))
    latest = search.latest_snapshots(v.snapshots.join(mine, "source_id", "left_semi")).select(F.col("id").alias("snapshot_id"))
    return search.small(latest)


@query("""SELECT s.chunk_id, f.path, s.score FROM scored s JOIN files f ON f.id = s.chunk_id JOIN latest l ON l.id = f.snapshot_id JOIN sources o ON o.id = l.source_id
WHERE o.product_id = 1 ORDER BY s.score DESC, s.chunk_id LIMIT 10""")
def search_by_product(v: Views) -> DataFrame:
    return _cells(v).top(v.query_vector(), versions=_within(v, 1)).select("chunk_id", "path", "score")


@query("""SELECT s.chunk_id, f.path, s.score FROM scored s JOIN files f ON f.id = s.chunk_id JOIN latest l ON l.id = f.snapshot_id JOIN sources o ON o.id = l.source_id
WHERE o.product_id = 2 AND starts_with(f.path, 'src1') AND f.content_type = 'text/plain' ORDER BY s.score DESC, s.chunk_id LIMIT 5""")
def search_by_product_filtered(v: Views) -> DataFrame:
    return _cells(v).top(v.query_vector(), 5, _within(v, 2), _where("src1", "text/plain")).select("chunk_id", "path", "score")


@query("""SELECT s.chunk_id, f.path, s.score FROM scored s JOIN files f ON f.id = s.chunk_id JOIN latest l ON l.id = f.snapshot_id WHERE l.source_id = 'src3' ORDER BY s.score DESC, s.chunk_id LIMIT 10""")
def search_by_source(v: Views) -> DataFrame:
    latest = search.latest_snapshot(v.snapshots, "src3").select(F.col("id").alias("snapshot_id"))
    return _cells(v).top(v.query_vector(), versions=F.broadcast(latest)).select("chunk_id", "path", "score")  # one row


@query("SELECT s.chunk_id, f.path, s.score FROM scored s JOIN files f ON f.id = s.chunk_id WHERE f.snapshot_id = 'src2/en' ORDER BY s.score DESC, s.chunk_id LIMIT 10")
def search_by_snapshot(v: Views) -> DataFrame:
    return _cells(v).top(v.query_vector(), versions=["src2/en"]).select("chunk_id", "path", "score")


@query("SELECT f.snapshot_id, count(*) AS n, sum(list_sum(list_transform(e.vector, lambda x: round(x * 10000)::BIGINT)))::BIGINT AS total FROM vectors e LEFT JOIN files f ON f.id = e.chunk_id GROUP BY 1")
def cell_index_contents(v: Views) -> DataFrame:
    """The cell index, built anew: every vector under its version, whole."""
    root = lineage.shared_folder(v.spark)
    _add_cells(v, root)
    total = F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, x: s + F.round(x.cast("double") * 10_000).cast("bigint"))
    version = F.when(F.col("snapshot_id") != "__HIVE_DEFAULT_PARTITION__", F.col("snapshot_id")).alias("snapshot_id")
    return cells.CellIndex(v.spark, root).vectors.groupBy(version).agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@query("SELECT chunk_id, model, score FROM scored ORDER BY score DESC, chunk_id LIMIT 10")
def search_similar_global(v: Views) -> DataFrame:
    return _cells(v).top(v.query_vector()).select("chunk_id", "model", "score")


@query("""SELECT query_id, rank, chunk_id, score FROM (SELECT a.chunk_id AS query_id, b.chunk_id, round(list_cosine_similarity(a.vector, b.vector), 6) AS score,
 row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 6) DESC, b.chunk_id)::INT AS rank
 FROM vectors a, vectors b WHERE a.chunk_id % 100 = 0) WHERE rank <= 5""")
def batch_topk(v: Views) -> DataFrame:
    queries = v.embeddings.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.batch_top_k(v.embeddings, queries, 5)


_SUMMARY = """SELECT s.id, s.snapshot_id, s.summary_type, s.target_path, s.arch_type, c.score FROM summaries s JOIN scored c ON c.chunk_id = s.id"""


@query(f"{_SUMMARY} WHERE s.snapshot_id = 'src5/en' AND s.summary_type IN ('file', 'directory') ORDER BY c.score DESC, s.id LIMIT 5")
def summary_search_typed(v: Views) -> DataFrame:
    return search.search_summaries(v.summaries, v.embeddings, v.query_vector(), types=["file", "directory"], snapshot_id="src5/en")


@query(f"{_SUMMARY} WHERE s.snapshot_id = 'src5/en' ORDER BY c.score DESC, s.id LIMIT 8")
def summary_search_all(v: Views) -> DataFrame:
    return search.search_summaries(v.summaries, v.embeddings, v.query_vector(), 8, snapshot_id="src5/en")


@query(f"{_SUMMARY} WHERE s.snapshot_id = 'src4/en' AND s.summary_type = 'architecture' ORDER BY c.score DESC, s.id LIMIT 5")
def summary_search_architecture(v: Views) -> DataFrame:
    return search.search_summaries(v.summaries, v.embeddings, v.query_vector(), types=["architecture"], snapshot_id="src4/en")


@query(f"{_SUMMARY} JOIN latest l ON l.id = s.snapshot_id JOIN sources o ON o.id = l.source_id WHERE o.product_id = 0 ORDER BY c.score DESC, s.id LIMIT 5")
def summary_search_by_product(v: Views) -> DataFrame:
    return search.search_summaries(v.summaries, v.embeddings, v.query_vector(), within=_latest_of(v, 0))


def _latest_of(v: Views, product: int) -> DataFrame:
    return search.latest_of_product(v.snapshots, v.sources, product)


@query(f"""SELECT 'chunk' AS kind, chunk_id AS id, score FROM (SELECT s.chunk_id, s.score FROM scored s JOIN files f ON f.id = s.chunk_id JOIN latest l ON l.id = f.snapshot_id JOIN sources o ON o.id = l.source_id
WHERE o.product_id = 1 ORDER BY s.score DESC, s.chunk_id LIMIT 10) UNION ALL SELECT 'summary', id, score FROM ({_SUMMARY} JOIN latest l ON l.id = s.snapshot_id JOIN sources o ON o.id = l.source_id WHERE o.product_id = 1 ORDER BY c.score DESC, s.id LIMIT 5)""")
def hybrid_union(v: Views) -> DataFrame:
    q, latest = v.query_vector(), _latest_of(v, 1)
    return search.hybrid(search.search_within(v.embeddings, v.files, latest, q), search.search_summaries(v.summaries, v.embeddings, q, within=latest))


@query("""SELECT c.id, c.file_id, c.ordinal, p.id AS prev_id, n.id AS next_id FROM chunks c LEFT JOIN chunks p ON p.file_id = c.file_id AND p.ordinal = c.ordinal - 1
LEFT JOIN chunks n ON n.file_id = c.file_id AND n.ordinal = c.ordinal + 1 WHERE c.chunk_type = 'assistant'""")
def search_with_neighbors(v: Views) -> DataFrame:
    return search.neighbours(v.chunks.filter("chunk_type = 'assistant'"), v.chunks)


@query("SELECT id, ordinal, chunk_type FROM chunks WHERE file_id = 4 AND ordinal BETWEEN 1 AND 3 ORDER BY ordinal")
def context_window(v: Views) -> DataFrame:
    return search.context_window(v.chunks, 4, 2).select("id", "ordinal", "chunk_type")


@query("SELECT h.file_id, h.ordinal AS hit_ordinal, c.ordinal, c.id FROM chunks h JOIN chunks c ON c.file_id = h.file_id AND c.ordinal BETWEEN h.ordinal - 2 AND h.ordinal + 1 WHERE h.chunk_type = 'user'")
def context_of_hits(v: Views) -> DataFrame:
    return search.context_of_hits(v.chunks.filter("chunk_type = 'user'"), v.chunks, 2, 1)


@query("""WITH h AS (SELECT chunk_id FROM scored ORDER BY score DESC, chunk_id LIMIT 20)
SELECT h.chunk_id, f.path, s.source_id, s.version_identifier, f.content_hash FROM h JOIN files f ON f.id = h.chunk_id JOIN snapshots s ON s.id = f.snapshot_id""")
def provenance(v: Views) -> DataFrame:
    return search.provenance(search.similar_chunks(v.embeddings, v.query_vector(), 20), v.files, v.snapshots)


@query("""SELECT d.model AS doc, round(sum(best), 6) AS max_sim FROM (SELECT e.model, e.chunk_id % 7 AS token, max(list_inner_product(e.vector, q.vector)) AS best
FROM vectors e, vectors q WHERE q.chunk_id % 100 = 0 GROUP BY ALL) d GROUP BY d.model""")
def max_sim(v: Views) -> DataFrame:
    q = v.embeddings.filter("chunk_id % 100 = 0").select(F.col("vector").alias("query_vector"))
    return search.max_sim(q, v.embeddings.select(F.col("model").alias("doc"), (F.col("chunk_id") % 7).alias("token"), "vector"))


# Snapshots, lists and lookups


@query("SELECT id, source_id FROM latest")
def latest_snapshot_per_source(v: Views) -> DataFrame:
    return search.latest_snapshots(v.snapshots).select("id", "source_id")


@query("SELECT id, source_id, indexed_at, created_at FROM snapshots WHERE source_id = 'src7' AND indexed ORDER BY indexed_at DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 1")
def latest_snapshot_one(v: Views) -> DataFrame:
    return search.latest_snapshot(v.snapshots, "src7").select("id", "source_id", "indexed_at", "created_at")


@query("SELECT s.id, r.ref_name FROM git_refs r JOIN snapshots s ON s.id = r.snapshot_id JOIN sources o ON o.id = r.source_id WHERE r.ref_name = 'fr' AND o.product_id = 1")
def snapshot_by_ref(v: Views) -> DataFrame:
    refs = v.git_refs.filter("ref_name = 'fr'").join(v.sources.filter("product_id = 1").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return refs.select(F.col("snapshot_id").alias("id"), "ref_name").join(v.snapshots.select("id"), "id")


@query("SELECT id, name, created_at FROM products ORDER BY created_at DESC")
def list_products(v: Views) -> DataFrame:
    return v.products.orderBy(F.desc("created_at"), "id")


@query("SELECT id, name FROM products WHERE name = 'ASIA'")
def product_by_name(v: Views) -> DataFrame:
    return v.products.filter("name = 'ASIA'").select("id", "name")


@query("SELECT id, name, source_type FROM sources WHERE product_id = 2 ORDER BY created_at DESC")
def sources_by_product(v: Views) -> DataFrame:
    return v.sources.filter("product_id = 2").orderBy(F.desc("created_at")).select("id", "name", "source_type")


@query("SELECT id, product_id FROM sources WHERE source_type = 'local' ORDER BY created_at DESC")
def sources_by_type(v: Views) -> DataFrame:
    return v.sources.filter("source_type = 'local'").orderBy(F.desc("created_at")).select("id", "product_id")


@query("SELECT id, indexed FROM snapshots WHERE source_id = 'src1' AND version_identifier = 'de'")
def snapshot_by_version(v: Views) -> DataFrame:
    return v.snapshots.filter("source_id = 'src1' and version_identifier = 'de'").select("id", "indexed")


@query("SELECT id, indexed_at FROM snapshots WHERE indexed ORDER BY indexed_at DESC NULLS FIRST, id")
def indexed_snapshots(v: Views) -> DataFrame:
    return v.snapshots.filter("indexed").orderBy(F.desc_nulls_first("indexed_at"), "id").select("id", "indexed_at")


@query("SELECT id, ref_name, snapshot_id FROM git_refs WHERE source_id = 'src4' ORDER BY ref_name")
def refs_by_source(v: Views) -> DataFrame:
    return v.git_refs.filter("source_id = 'src4'").orderBy("ref_name").select("id", "ref_name", "snapshot_id")


@query("SELECT id, path, size, content_type FROM files WHERE snapshot_id = 'src0/en' ORDER BY path")
def files_by_snapshot(v: Views) -> DataFrame:
    return v.files.filter("snapshot_id = 'src0/en'").select("id", "path", "size", "content_type").orderBy("path")


@query("SELECT path, content_hash FROM files WHERE snapshot_id = 'src0/en'")
def file_hashes(v: Views) -> DataFrame:
    return v.files.filter("snapshot_id = 'src0/en'").select("path", "content_hash")


@query("SELECT id, path FROM files WHERE snapshot_id = 'src1/en' AND content_type = 'text/markdown' ORDER BY path")
def files_by_content_type(v: Views) -> DataFrame:
    return v.files.filter("snapshot_id = 'src1/en' and content_type = 'text/markdown'").select("id", "path").orderBy("path")


@query("SELECT id, path FROM files WHERE snapshot_id = 'src1/en' AND domain = 'unknown' ORDER BY path")
def files_by_domain(v: Views) -> DataFrame:
    return v.files.filter("snapshot_id = 'src1/en' and domain = 'unknown'").select("id", "path").orderBy("path")


@query("SELECT b.id, b.path FROM files a JOIN files b ON a.content_hash = b.content_hash WHERE a.id = 3 ORDER BY b.created_at DESC")
def files_by_hash(v: Views) -> DataFrame:
    mine = search.small(v.files.filter("id = 3").select("content_hash"))
    return v.files.join(mine, "content_hash").orderBy(F.desc("created_at")).select("id", "path")


@query("SELECT id, chunk_type, token_count FROM chunks WHERE file_id = 7 ORDER BY ordinal")
def chunks_by_file(v: Views) -> DataFrame:
    return v.chunks.filter("file_id = 7").orderBy("ordinal").select("id", "chunk_type", "token_count")


@query("SELECT id, depth, target_path FROM summaries WHERE snapshot_id = 'src2/en' AND summary_type = 'directory' ORDER BY depth DESC, target_path")
def directory_summaries(v: Views) -> DataFrame:
    return v.summaries.filter("snapshot_id = 'src2/en' and summary_type = 'directory'").select("id", "depth", "target_path").orderBy(F.desc("depth"), "target_path")


@query("SELECT id, arch_type, content FROM summaries WHERE snapshot_id = 'src2/en' AND summary_type = 'architecture' AND arch_type = 'data_flow'")
def architecture_summary(v: Views) -> DataFrame:
    return v.summaries.filter("snapshot_id = 'src2/en' and summary_type = 'architecture' and arch_type = 'data_flow'").select("id", "arch_type", "content")


@query("SELECT snapshot_id, summary_type, count(*) AS n, coalesce(max(CASE WHEN summary_type = 'directory' THEN depth END), 0)::INT AS max_depth FROM summaries GROUP BY ALL")
def summary_counts(v: Views) -> DataFrame:
    return v.summaries.groupBy("snapshot_id", "summary_type").agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("summary_type") == "directory", F.col("depth"))), F.lit(0)).alias("max_depth"))


@query("SELECT s.snapshot_id, count(*) AS n FROM vectors e JOIN summaries s ON s.id = e.chunk_id GROUP BY 1")
def summary_embedding_counts(v: Views) -> DataFrame:
    return v.embeddings.withColumnRenamed("chunk_id", "id").join(v.summaries, "id").groupBy("snapshot_id").agg(F.count("*").alias("n"))


@query("SELECT to_id, dep_type, symbol FROM dependencies WHERE from_id = 1 ORDER BY dep_type, symbol NULLS LAST")
def dependencies_of_chunk(v: Views) -> DataFrame:
    return v.dependencies.filter("from_id = 1").orderBy("dep_type", F.asc_nulls_last("symbol")).select("to_id", "dep_type", "symbol")


@query("SELECT from_id, symbol FROM dependencies WHERE to_id = 10 AND dep_type = 'N' ORDER BY symbol NULLS LAST, from_id")
def incoming_by_type(v: Views) -> DataFrame:
    return v.dependencies.filter("to_id = 10 and dep_type = 'N'").orderBy(F.asc_nulls_last("symbol"), "from_id").select("from_id", "symbol")


@query("SELECT id, product_id, output_path, generated_at FROM wiki ORDER BY generated_at DESC")
def list_wiki(v: Views) -> DataFrame:
    return v.wiki.orderBy(F.desc("generated_at"))


# Aggregates and coverage


@query("""SELECT p.id, p.name, count(DISTINCT s.id)::INT AS source_count, max(CASE WHEN ss.indexed THEN ss.indexed_at END) AS last_indexed_at, max(w.generated_at) AS wiki_generated_at
FROM products p LEFT JOIN sources s ON s.product_id = p.id LEFT JOIN snapshots ss ON ss.source_id = s.id AND ss.indexed LEFT JOIN wiki w ON w.product_id = p.id GROUP BY p.id, p.name ORDER BY p.name""")
def products_with_stats(v: Views) -> DataFrame:
    return coverage.products_with_stats(v.products, v.sources, v.snapshots, v.wiki)


@query("""SELECT coalesce(f.domain, 'unknown') AS domain, count(DISTINCT f.id) AS file_count, coalesce(sum(c.n), 0)::BIGINT AS chunk_count
FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.file_id = f.id GROUP BY f.domain""")
def domain_coverage_raw(v: Views) -> DataFrame:
    return coverage.domain_counts(v.files, v.chunks)


@query("""SELECT coalesce(sf.domain, 'unknown') AS domain, count(*) AS total_files, sum(CASE WHEN sf.indexed THEN 1 ELSE 0 END)::BIGINT AS indexed_files, coalesce(sum(c.n), 0)::BIGINT AS indexed_chunks,
 round(sum(CASE WHEN sf.indexed THEN 1 ELSE 0 END) * 100.0 / count(*), 2)::DOUBLE AS coverage_rate, round(coalesce(avg(c.r), 0.0), 6) AS avg_comment_ratio, round(coalesce(avg(c.x), 0.0), 6) AS avg_complexity
FROM snapshot_files sf LEFT JOIN (SELECT file_id, count(*) AS n, avg(coalesce(comment_ratio, 0.0)) AS r, avg(coalesce(cyclomatic_complexity, 0)) AS x FROM chunks GROUP BY 1) c ON c.file_id = sf.id GROUP BY 1""")
def domain_coverage_stats(v: Views) -> DataFrame:
    return coverage.domain_coverage(v.snapshot_files, v.chunks)


@query("SELECT coalesce(domain, 'unknown') AS domain, grouping(coalesce(domain, 'unknown'))::INT AS is_total, count(*) AS files, count(*) FILTER (indexed) AS indexed_files FROM snapshot_files GROUP BY ROLLUP (coalesce(domain, 'unknown'))")
def coverage_map(v: Views) -> DataFrame:
    return coverage.coverage_map(v.snapshot_files)


#: Three versions of the files: which are there, which have other contents and chunks, and which are in another domain.
_VERSIONS = (("v1", "id % 10 <> 3", "false", "false"), ("v2", "id % 10 <> 7", "id % 10 = 5", "false"), ("v3", "id % 10 <> 1", "id % 10 = 5", "id % 10 = 6"))
_VERSION_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS version, id, CASE WHEN {moved} THEN 'moved' ELSE coalesce(domain, 'unknown') END AS domain, indexed, {edited} AS edited FROM snapshot_files WHERE {there}"
    for n, there, edited, moved in _VERSIONS
)


def _mean(value: str) -> str:
    """The mean to six digits, half up, in whole numbers: sums of doubles fall to either side where it ends in a five."""
    total, n = f"sum(round(({value}) * 1e12)::HUGEINT)::HUGEINT", f"count({value})::HUGEINT"
    return f"CASE WHEN count({value}) = 0 THEN 0.0 ELSE ((2 * {total} + {n} * 1000000) // (2 * {n} * 1000000))::DOUBLE / 1e6 END"


def _coverage_states(v: Views) -> list[tuple[str, DataFrame]]:
    """Each version's state from the one before, below a folder that goes when the driver ends."""
    root, before, out = lineage.shared_folder(v.spark), (), []
    hashes = v.files.select("id", "content_hash")
    for name, there, edited, moved in _VERSIONS:
        files = v.snapshot_files.filter(there).join(hashes, "id").select(
            "id", F.col("file_path").alias("path"), F.when(F.expr(edited), F.concat("content_hash", F.lit("!"))).otherwise(F.col("content_hash")).alias("content_hash"),
            F.when(F.expr(moved), "moved").otherwise(F.col("domain")).alias("domain"), "indexed",
        )
        ratio = F.when(F.expr(edited.replace("id", "file_id")), F.col("comment_ratio") + 1).otherwise(F.col("comment_ratio"))
        chunks = v.chunks.select("file_id", ratio.alias("comment_ratio"), "cyclomatic_complexity")
        out.append((name, rollups.refresh(root, name, files, chunks, *before)))
        before = (name, files, chunks)
    return out


@query(f"""WITH f AS ({_VERSION_SQL}), c AS (SELECT file_id, count(*) AS n, avg(coalesce(comment_ratio, 0.0)) AS r, avg(coalesce(comment_ratio + 1, 0.0)) AS r1, avg(coalesce(cyclomatic_complexity, 0)) AS x FROM chunks GROUP BY 1)
SELECT version, domain, count(*) AS total_files, count(*) FILTER (indexed) AS indexed_files, coalesce(sum(n), 0)::BIGINT AS indexed_chunks, round(count(*) FILTER (indexed) * 100.0 / count(*), 2)::DOUBLE AS coverage_rate,
 {_mean("CASE WHEN edited THEN r1 ELSE r END")} AS avg_comment_ratio, {_mean("x")} AS avg_complexity FROM f LEFT JOIN c ON c.file_id = f.id GROUP BY 1, 2""")
def coverage_by_version(v: Views) -> DataFrame:
    return reduce(DataFrame.unionByName, (rollups.coverage(s).withColumn("version", F.lit(name)) for name, s in _coverage_states(v)))


@query(f"WITH f AS ({_VERSION_SQL}) SELECT domain, grouping(domain)::INT AS is_total, count(*) AS files, count(*) FILTER (indexed) AS indexed_files FROM f WHERE version = 'v3' GROUP BY ROLLUP (domain)")
def coverage_map_by_version(v: Views) -> DataFrame:
    return rollups.coverage_map(_coverage_states(v)[-1][1])


@query("""SELECT file_path FROM snapshot_files WHERE NOT indexed AND (file_path ILIKE '%README.md' OR file_path ILIKE '%/docs/adr/%' OR file_path ILIKE '%/docs/design/%' OR file_path ILIKE '%/docs/decisions/%'
 OR file_path IN ('package.json', 'go.mod', 'Dockerfile', 'docker-compose.yml')) ORDER BY file_path""")
def unindexed_important_files(v: Views) -> DataFrame:
    return coverage.unindexed_important(v.snapshot_files)


@query("SELECT c.id, c.git_commit_hash, c.indexed_at, f.path AS file_path FROM chunks c JOIN files f ON f.id = c.file_id WHERE c.is_latest AND c.git_commit_hash IS NOT NULL")
def chunks_with_git_info(v: Views) -> DataFrame:
    return coverage.chunks_with_commit(v.chunks, v.files).select("id", "git_commit_hash", "indexed_at", "file_path")


@query(f"SELECT id, git_commit_hash, indexed_at FROM chunks WHERE is_latest AND git_commit_hash IS NOT NULL AND indexed_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY indexed_at, id")
def stale_chunks(v: Views) -> DataFrame:
    return coverage.stale(v.chunks, AS_OF, 30).select("id", "git_commit_hash", "indexed_at").orderBy("indexed_at", "id")


@query(f"SELECT count(*) AS stale_count FROM chunks WHERE is_latest AND git_commit_hash IS NOT NULL AND indexed_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def stale_count(v: Views) -> DataFrame:
    return coverage.stale(v.chunks, AS_OF, 30).agg(F.count("*").alias("stale_count"))


@query("SELECT chunk_type, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY 1")
def source_token_stats(v: Views) -> DataFrame:
    return coverage.source_tokens(v.chunks)


@query("SELECT s.source_id, s.id, s.indexed_at FROM snapshots s JOIN latest l ON l.id = s.id")
def index_status(v: Views) -> DataFrame:
    return search.latest_snapshots(v.snapshots).select("source_id", "id", "indexed_at")


@query("SELECT count(DISTINCT p.id) AS products, count(DISTINCT s.id) AS sources, count(DISTINCT ss.id) AS snapshots, count(DISTINCT f.id) AS files FROM products p LEFT JOIN sources s ON s.product_id = p.id LEFT JOIN snapshots ss ON ss.source_id = s.id LEFT JOIN files f ON f.snapshot_id = ss.id")
def global_stats(v: Views) -> DataFrame:
    src = v.sources.join(v.products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    snap = v.snapshots.join(src.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    files = v.files.join(snap.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")
    count = lambda df, name: df.agg(F.count_distinct("id").alias(name))
    return count(v.products, "products").join(count(src, "sources")).join(count(snap, "snapshots")).join(count(files, "files"))


@query("SELECT count(*) AS rows, round(100.0 * count(comment_ratio) / count(*), 2)::DOUBLE AS comment_ratio_rate, round(100.0 * count(cyclomatic_complexity) / count(*), 2)::DOUBLE AS cyclomatic_complexity_rate, round(100.0 * count(git_commit_hash) / count(*), 2)::DOUBLE AS git_commit_hash_rate FROM chunks")
def metadata_fill_rate(v: Views) -> DataFrame:
    return coverage.fill_rate(v.chunks, ["comment_ratio", "cyclomatic_complexity", "git_commit_hash"])


@query("SELECT content_hash, count(*) AS copies FROM files GROUP BY 1 HAVING count(*) > 1")
def dup_by_hash(v: Views) -> DataFrame:
    return coverage.duplicate_keys(v.files, "content_hash")


@query("SELECT snapshot_id, count(*) AS copies FROM files GROUP BY 1 HAVING count(*) > 1")
def dup_key_having(v: Views) -> DataFrame:
    return coverage.duplicate_keys(v.files, "snapshot_id")


@query("SELECT language, coalesce(domain, 'unknown') AS domain, count(*) AS n FROM files GROUP BY ALL")
def language_histogram(v: Views) -> DataFrame:
    return v.files.groupBy("language", F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT event_type = 'error' AS failed, count(*) AS n FROM events GROUP BY 1")
def pipeline_stats(v: Views) -> DataFrame:
    return v.table("events").groupBy((F.col("event_type") == "error").alias("failed")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT coalesce(domain, 'unknown') AS domain, count(*) AS total_files, count(*) FILTER (indexed) AS indexed_files, round(count(*) FILTER (indexed) * 100.0 / count(*), 2) AS rate FROM snapshot_files GROUP BY 1)
SELECT 'readme_not_indexed' AS alert, file_path AS subject FROM snapshot_files WHERE NOT indexed AND file_path ILIKE '%readme.md'
UNION ALL SELECT 'low_test_coverage', domain FROM c WHERE domain = 'tests' AND rate < 50 UNION ALL SELECT 'few_decisions_indexed', domain FROM c WHERE domain = 'architecture' AND total_files >= 10 AND indexed_files < 500""")
def kpi_alerts(v: Views) -> DataFrame:
    return coverage.alerts(coverage.domain_coverage(v.snapshot_files, v.chunks), coverage.unindexed_important(v.snapshot_files), adr_indexed=500, test_rate=50.0)


# Changes of tables


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT path, content_hash AS h FROM files WHERE id % 10 <> 3) a FULL JOIN (SELECT path, CASE WHEN id % 10 = 5 THEN sha256(content || '!') ELSE content_hash END AS h FROM files WHERE id % 10 <> 7) b ON a.path = b.path""")
def file_diff(v: Views) -> DataFrame:
    new = v.files.filter("id % 10 <> 7").select("path", F.when(F.col("id") % 10 == 5, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return catalog.file_diff(v.files.filter("id % 10 <> 3"), new)


@query("""SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.t ELSE o.source_type END AS source_type, coalesce(o.created_at, n.c) AS created_at FROM sources o
FULL JOIN (SELECT id, 'pdf' AS t, created_at + 1 AS c FROM sources WHERE created_at < 5 UNION ALL SELECT 'new', 'notion', 99) n ON n.id = o.id""")
def upsert_source(v: Views) -> DataFrame:
    old = v.sources.select("id", "source_type", "created_at")
    new = old.filter("created_at < 5").select("id", F.lit("pdf").alias("source_type"), (F.col("created_at") + 1).alias("created_at"))
    new = new.unionAll(v.spark.createDataFrame([("new", "notion", 99)], "id string, source_type string, created_at int"))
    return catalog.upsert(old, new, ["id"], keep=["created_at"])


@query("""WITH t AS (SELECT DISTINCT from_id, to_id, dep_type, symbol FROM dependencies WHERE symbol IS NOT NULL UNION ALL SELECT from_id, to_id, dep_type, symbol FROM dependencies WHERE symbol IS NULL),
n AS (SELECT from_id, to_id, dep_type, symbol FROM dependencies)
SELECT * FROM t UNION ALL SELECT DISTINCT * FROM n WHERE symbol IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.from_id = n.from_id AND t.to_id = n.to_id AND t.dep_type = n.dep_type AND t.symbol = n.symbol)
UNION ALL SELECT * FROM n WHERE symbol IS NULL""")
def dep_insert_ignore(v: Views) -> DataFrame:
    key = ["from_id", "to_id", "dep_type", "symbol"]
    d = v.dependencies.select(*key)
    old = d.filter("symbol is not null").distinct().unionAll(d.filter("symbol is null"))
    return catalog.insert_or_ignore(old, d, key)


@query("SELECT id, CASE WHEN id = 'src1/de' THEN true ELSE indexed END AS indexed, CASE WHEN id = 'src1/de' THEN 12345 ELSE indexed_at END AS indexed_at FROM snapshots")
def mark_indexed(v: Views) -> DataFrame:
    done = {"indexed": F.lit(True), "indexed_at": F.lit(12345).cast("bigint")}
    return catalog.update(v.snapshots, F.col("id") == "src1/de", done).select("id", "indexed", "indexed_at")


@query("SELECT c.id, CASE WHEN u.id IS NOT NULL THEN u.s ELSE c.comment_ratio END AS comment_ratio FROM chunks c LEFT JOIN (SELECT id, ordinal / 10.0 AS s FROM chunks WHERE chunk_type = 'user') u ON u.id = c.id")
def update_importance_batch(v: Views) -> DataFrame:
    changes = v.chunks.filter("chunk_type = 'user'").select("id", (F.col("ordinal") / 10).alias("comment_ratio"))
    return catalog.update_from(v.chunks.select("id", "comment_ratio"), changes, ["id"], ["comment_ratio"])


@query("SELECT id, path FROM files WHERE NOT (snapshot_id = 'src0/en' AND path IN (SELECT path FROM files WHERE id % 3 = 0))")
def delete_by_paths(v: Views) -> DataFrame:
    gone = v.files.filter("id % 3 = 0 and snapshot_id = 'src0/en'").select("snapshot_id", "path")
    return catalog.delete_keys(v.files, gone, ["snapshot_id", "path"]).select("id", "path")


@query("""SELECT 'snapshots' AS t, count(*) AS n FROM snapshots WHERE source_id NOT IN (SELECT id FROM sources WHERE product_id = 1)
UNION ALL SELECT 'files', count(*) FROM files f JOIN snapshots s ON s.id = f.snapshot_id WHERE s.source_id NOT IN (SELECT id FROM sources WHERE product_id = 1)
UNION ALL SELECT 'vectors', count(*) FROM vectors e WHERE e.chunk_id NOT IN (SELECT f.id FROM files f JOIN snapshots s ON s.id = f.snapshot_id JOIN sources o ON o.id = s.source_id WHERE o.product_id = 1)""")
def cascade_delete(v: Views) -> DataFrame:
    gone = v.sources.filter("product_id = 1").select("id")
    left = catalog.cascade(gone, [(v.snapshots, "source_id", "id"), (v.files, "snapshot_id", "id"), (v.embeddings, "chunk_id", "chunk_id")])
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n") for name, t in zip(("snapshots", "files", "vectors"), left)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("SELECT w.s AS source_id, w.l AS version_identifier FROM (SELECT DISTINCT source AS s, lang AS l FROM documents) w WHERE NOT EXISTS (SELECT 1 FROM snapshots x WHERE x.indexed AND x.source_id = w.s AND x.version_identifier = w.l)")
def versions_to_index(v: Views) -> DataFrame:
    wanted = v.table("documents").select(F.col("source").alias("source_id"), F.col("lang").alias("version_identifier")).distinct()
    return catalog.not_indexed(wanted, v.snapshots)


@query("SELECT id, name, source_type FROM sources UNION ALL SELECT 'brand-new', 'brand-new', 'git'")
def insert_source(v: Views) -> DataFrame:
    new = v.spark.createDataFrame([("brand-new", "brand-new", "git")], "id string, name string, source_type string")
    return catalog.insert(v.sources.select("id", "name", "source_type"), new, ["name"])


@query("SELECT id, name, product_id FROM sources UNION ALL SELECT id || '-copy', name || ' (copy)', product_id FROM sources WHERE product_id = 1")
def committed_sources(v: Views) -> DataFrame:
    """M-05 with the commit of what was checked: the copies are inserted on the version that their names were compared with."""
    root, rows = lineage.shared_folder(v.spark), v.sources.select("id", "name", "product_id")
    versions.commit(rows, root, 0)
    copies = rows.filter("product_id = 1").select(F.concat("id", F.lit("-copy")).alias("id"), F.concat("name", F.lit(" (copy)")).alias("name"), "product_id")
    return versions.read(v.spark, root, versions.change(v.spark, root, lambda old: catalog.insert(old, copies, ["name"]))).rows


# Hierarchies and graphs


@query("SELECT n.parent AS id, EXISTS (SELECT 1 FROM hierarchy e WHERE e.parent = n.parent) AS has_children FROM (SELECT parent FROM hierarchy UNION SELECT child FROM hierarchy) n")
def has_children(v: Views) -> DataFrame:
    return graph.has_children(_nodes(v.hierarchy), v.hierarchy)


@query("SELECT n.parent AS id, EXISTS (SELECT 1 FROM hierarchy e WHERE e.child = n.parent) AS has_parent FROM (SELECT parent FROM hierarchy UNION SELECT child FROM hierarchy) n")
def has_parent(v: Views) -> DataFrame:
    return graph.has_parent(_nodes(v.hierarchy), v.hierarchy)


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("id")).union(edges.select("child")).distinct()


@query("SELECT child AS id FROM hierarchy WHERE parent = 'n3' ORDER BY ordinal")
def child_chunks(v: Views) -> DataFrame:
    return graph.children(v.hierarchy, _nodes(v.hierarchy), "n3")


@query("SELECT child, min(parent) AS parent FROM chain GROUP BY child")
def parent_chunk(v: Views) -> DataFrame:
    return graph.parent_of(v.chain)


@query("SELECT parent, count(*) AS child_count FROM hierarchy GROUP BY 1")
def count_children(v: Views) -> DataFrame:
    return v.hierarchy.groupBy("parent").agg(F.count("*").alias("child_count"))


@query("""WITH RECURSIVE t(node, depth, sort) AS (SELECT 'r1', 1, [0::BIGINT] UNION ALL SELECT h.child, t.depth + 1, list_append(t.sort, h.ordinal) FROM t JOIN hierarchy h ON h.parent = t.node WHERE t.depth < 3)
SELECT node, depth::INT AS depth, row_number() OVER (ORDER BY sort) AS place FROM t""")
def subtree(v: Views) -> DataFrame:
    return tour.below(tour.tour(v.hierarchy), "r1", 3).select("node", F.col("depth").cast("int").alias("depth"), "place")


@query("""WITH RECURSIVE t(node, root, depth, sort) AS (SELECT DISTINCT parent, parent, 0, [0::BIGINT] FROM hierarchy WHERE parent NOT IN (SELECT child FROM hierarchy)
 UNION ALL SELECT h.child, t.root, t.depth + 1, list_append(t.sort, h.ordinal) FROM t JOIN hierarchy h ON h.parent = t.node),
n AS (SELECT node, root, depth, sort, row_number() OVER (PARTITION BY root ORDER BY sort) AS place FROM t)
SELECT a.node, a.root, a.depth::BIGINT AS depth, a.place, (SELECT max(b.place) FROM n b WHERE b.root = a.root AND b.sort[1:len(a.sort)] = a.sort) AS last FROM n a WHERE a.depth < 2
UNION ALL SELECT node, root, depth, place, place FROM n WHERE depth = 2""")
def preorder_intervals(v: Views) -> DataFrame:
    return tour.tour(v.hierarchy)


@query("""WITH RECURSIVE t(node, up, depth) AS (SELECT child, parent, 1 FROM chain UNION ALL SELECT t.node, c.parent, t.depth + 1 FROM t JOIN chain c ON c.child = t.up)
SELECT node, arg_max(up, depth) AS root, max(depth)::INT AS depth FROM t GROUP BY node UNION ALL SELECT DISTINCT parent, parent, 0 FROM chain WHERE parent NOT IN (SELECT child FROM chain)""")
def depth(v: Views) -> DataFrame:
    return graph.path_to_root(v.chain).select("node", "root", F.col("depth").cast("int").alias("depth"))


@query("""WITH RECURSIVE t(node, up, p) AS (SELECT child, parent, child || '>' || parent FROM chain UNION ALL SELECT t.node, c.parent, t.p || '>' || c.parent FROM t JOIN chain c ON c.child = t.up)
SELECT node, arg_max(p, length(p)) AS path FROM t GROUP BY node""")
def path_to_root(v: Views) -> DataFrame:
    return graph.paths(v.chain).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query()
def cycle_nodes(v: Views) -> DataFrame:
    tables = {"hierarchy": v.hierarchy, "chain": v.chain, "dependencies": v.dependencies.select(F.col("from_id").alias("parent"), F.col("to_id").alias("child"))}
    nodes = [graph.cycle_nodes(e).select(F.lit(name).alias("edges"), F.col("node").cast("string").alias("node")) for name, e in tables.items()]
    return nodes[0].unionAll(nodes[1]).unionAll(nodes[2])


@query("""SELECT coalesce(o.n, i.n) AS node, coalesce(o.d, 0) AS out_degree, coalesce(i.d, 0) AS in_degree FROM (SELECT from_id AS n, count(*) AS d FROM dependencies GROUP BY 1) o FULL JOIN (SELECT to_id AS n, count(*) AS d FROM dependencies GROUP BY 1) i ON i.n = o.n""")
def dep_out_in_degree(v: Views) -> DataFrame:
    return graph.degrees(v.dependencies)


def _page_sql(rounds: int) -> str:
    step = """SELECT n.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(sum(r.rank * e.w / o.total), 0) + (SELECT coalesce(sum(rank), 0) FROM {r} WHERE node NOT IN (SELECT a FROM o)) / (SELECT count(*) FROM nodes)) AS rank
 FROM nodes n LEFT JOIN e ON e.b = n.node LEFT JOIN o ON o.a = e.a LEFT JOIN {r} r ON r.node = e.a GROUP BY n.node"""
    parts = [
        "e AS (SELECT from_id AS a, to_id AS b, count(*)::DOUBLE AS w FROM dependencies GROUP BY ALL)",
        "nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e)", "o AS (SELECT a, sum(w) AS total FROM e GROUP BY a)", "r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)",
    ]
    parts += [f"r{k + 1} AS ({step.format(r=f'r{k}')})" for k in range(rounds)]
    return "WITH " + ",\n".join(parts) + f"\nSELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query(_page_sql(5))
def pagerank(v: Views) -> DataFrame:
    return graph.pagerank(v.dependencies.select("from_id", "to_id")).withColumn("rank", F.round("rank", 9))


@query("""WITH d AS (SELECT to_id AS id, count(*) AS refs, count(DISTINCT from_id) AS callers FROM dependencies GROUP BY 1)
SELECT id, round((refs - (SELECT min(refs) FROM d)) / ((SELECT max(refs) FROM d) - (SELECT min(refs) FROM d))::DOUBLE * 0.6 + (callers - (SELECT min(callers) FROM d)) / ((SELECT max(callers) FROM d) - (SELECT min(callers) FROM d))::DOUBLE * 0.4, 4) AS importance FROM d""")
def importance_score(v: Views) -> DataFrame:
    parts = v.dependencies.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("refs"), F.count_distinct("from_id").alias("callers"))
    return graph.importance(parts, {"refs": 0.6, "callers": 0.4})


@query("""WITH c AS (SELECT chunk_type AS name, id, [CASE WHEN ordinal % 2 = 0 THEN 'assistant' ELSE 'user' END] AS calls FROM chunks)
SELECT DISTINCT a.id AS from_id, b.id AS to_id, 'call' AS dep_type, b.name AS symbol FROM c a JOIN c b ON list_contains(a.calls, b.name) AND a.id <> b.id""")
def derive_edges(v: Views) -> DataFrame:
    calls = F.array(F.when(F.col("ordinal") % 2 == 0, "assistant").otherwise("user"))
    return graph.derive_edges(v.chunks.select("id", F.col("chunk_type").alias("name"), calls.alias("calls")))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size, lower(replace(p_brand, '#', '')) AS brand, 'lib/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) AS long FROM part),
s AS (SELECT id, name, CASE WHEN p_size < 10 THEN brand ELSE long END AS package FROM p), k AS (SELECT package, name, min(id) AS to_id FROM s GROUP BY 1, 2),
c AS (SELECT l_orderkey, 'example.org/x/' || long AS path, name FROM lineitem JOIN p ON p.id = l_partkey),
r AS (SELECT path, arg_max(package, length(package)) AS package FROM (SELECT DISTINCT path FROM c) d JOIN (SELECT DISTINCT package FROM s) n ON ends_with('/' || d.path, '/' || n.package) GROUP BY path)
SELECT DISTINCT -1 - l_orderkey AS from_id, to_id, 'call' AS dep_type, c.name AS symbol FROM c JOIN r ON r.path = c.path JOIN k ON k.package = r.package AND k.name = c.name
UNION SELECT s.id, k.to_id, 'call', s.name FROM s JOIN k ON k.package = s.package AND k.name = s.name WHERE s.id <> k.to_id""")
def derive_edges_scoped(v: Views) -> DataFrame:
    """Parts are symbols of packages by kind and brand, the small ones of their brand alone; orders import and call what they hold."""
    brand = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    long = F.concat(F.lit("lib/"), F.lower("p_type"), F.lit("/"), brand)
    parts = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") < 10, brand).otherwise(long).alias("package"), long.alias("long"))
    held = v.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("id")).join(parts, "id")
    scope, alias, none = F.col("l_orderkey").cast("string").alias("scope"), F.concat(F.lit("p"), F.col("id")), F.lit(None).cast("string")
    imports = held.select(scope, alias.alias("alias"), F.concat(F.lit("example.org/x/"), F.col("long")).alias("path"))
    kind = F.lit("call").alias("dep_type")
    bought = held.select((-1 - F.col("l_orderkey")).alias("from_id"), scope, none.alias("package"), alias.alias("qualifier"), F.col("name").alias("symbol"), kind)
    inner = parts.select(F.col("id").alias("from_id"), none.alias("scope"), "package", none.alias("qualifier"), F.col("name").alias("symbol"), kind)
    return scopes.edges(bought.unionAll(inner), imports, parts.select("id", "package", "name"))


# Directories and summaries


@query("SELECT file_id, sha256(string_agg(content_hash, ':' ORDER BY content_hash)) AS source_hash FROM chunks GROUP BY file_id")
def merkle_dir_hash(v: Views) -> DataFrame:
    return summaries.group_hashes(v.chunks, "file_id", "content_hash")


@query("""WITH d2 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(content_hash, ':' ORDER BY content_hash)) AS hash FROM files GROUP BY 1),
d1 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(hash, ':' ORDER BY hash)) AS hash FROM d2 GROUP BY 1)
SELECT * FROM d2 UNION ALL SELECT * FROM d1 UNION ALL SELECT '', sha256(string_agg(hash, ':' ORDER BY hash)) FROM d1""")
def merkle_tree(v: Views) -> DataFrame:
    return summaries.directory_hashes(v.files)


@query("""WITH d AS (SELECT DISTINCT unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path FROM files)
SELECT d.path, CASE WHEN d.path = '' THEN NULL WHEN contains(d.path, '/') THEN split_part(d.path, '/', 1) ELSE '' END AS parent, CASE WHEN d.path = '' THEN 0 ELSE len(string_split(d.path, '/')) END::INT AS depth,
 (SELECT count(*) FROM files f WHERE regexp_replace(f.path, '/[^/]*$', '') = d.path) AS files,
 (SELECT count(*) FROM d x WHERE x.path <> '' AND d.path = CASE WHEN contains(x.path, '/') THEN split_part(x.path, '/', 1) ELSE '' END) AS subdirs FROM d""")
def directory_tree(v: Views) -> DataFrame:
    return summaries.directories(v.files)


@query("""WITH d AS (SELECT unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path, language FROM files),
g AS (SELECT path, language, count(*) AS n FROM d GROUP BY ALL) SELECT path, sum(n)::BIGINT AS files, string_agg(language || '=' || n, ',' ORDER BY language) AS languages FROM g GROUP BY path""")
def dir_recursive_counts(v: Views) -> DataFrame:
    rows = summaries.recursive_counts(v.files)
    pairs = F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("path", "files", F.array_join(pairs, ",").alias("languages"))


@query("""WITH now AS (SELECT file_id AS path, sha256(string_agg(content_hash, ':' ORDER BY content_hash)) AS source_hash FROM chunks GROUP BY 1)
SELECT path, source_hash FROM now WHERE path % 4 <> 1 OR path % 8 = 1""")
def changed_summaries(v: Views) -> DataFrame:
    now = summaries.group_hashes(v.chunks, "file_id", "content_hash").withColumnRenamed("file_id", "path")
    old = now.filter("path % 4 = 1").withColumn("source_hash", F.when(F.col("path") % 8 == 1, "old").otherwise(F.col("source_hash")))
    return summaries.changed(now, old)


@query("SELECT file_id, string_agg(content, chr(10) ORDER BY ordinal) AS body FROM chunks GROUP BY 1")
def prompt_body(v: Views) -> DataFrame:
    return summaries.prompt_body(v.chunks, 2**31 - 1)


@query("SELECT path, count(*) AS edits, max(ts) AS last_edit FROM commits WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def edit_frequency(v: Views) -> DataFrame:
    return summaries.edit_frequency(v.commits, "2024-01-15")


@query("SELECT path, hash, author, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM commits) WHERE rn = 1")
def last_commit_per_file(v: Views) -> DataFrame:
    return summaries.last_commit(v.commits)


# Text and chunks


@query(r"""SELECT doc_id AS id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '//')))::INT AS loc,
 len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS nonblank FROM documents""")
def line_metrics(v: Views) -> DataFrame:
    return v.files.select("id", text.code_lines(F.col("content")).alias("m")).select("id", F.col("m.loc"), F.col("m.nonblank"))


_CODE = ["package a\n\n// one\nfunc f() {\n\tif a && b {\n\t}\n}\n", "/* x */ y\n/* open\nstill\nclose */\nz := 1\n\n", "", "// all\n// comments"]


def _case(v: Views, values: list) -> DataFrame:
    """id of every document, and the value that stands at id modulo the number of values."""
    return v.table("documents").select(F.col("doc_id").alias("id"), F.get(F.array(*[F.lit(x) for x in values]), (F.col("doc_id") % len(values)).cast("int")).alias("value"))


def _case_sql(columns: list[str], rows: list[tuple]) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x).lower()
    values = ", ".join(f"({i}, {', '.join(map(text, r))})" for i, r in enumerate(rows))
    return f"SELECT d.doc_id AS id, {', '.join(columns)} FROM documents d JOIN (VALUES {values}) t(k, {', '.join(columns)}) ON t.k = d.doc_id % {len(rows)}"


@query(_case_sql(["loc", "comment_ratio", "complexity"], [(5, 0.166667, 3), (1, 0.8, 1), (0, 0.0, 1), (0, 1.0, 1)]))
def comment_ratio(v: Views) -> DataFrame:
    rows = _case(v, _CODE).withColumn("m", text.code_lines(F.col("value")))
    return rows.select("id", F.col("m.loc"), F.round(text.comment_ratio(F.col("m")), 6).alias("comment_ratio"), text.branch_count(F.col("value")).alias("complexity"))


_MARKDOWN = [(1, "intro\n# A\ntext\n```\n# no\n```\n## B\n| x |\n# still table |\nend\n# C"), (2, "no heading"), (3, "# only\n\n#x\n"), (4, "```\n# never closed")]


_SECTIONS = [[(0, 1, 1), (1, 2, 6), (2, 7, 10), (3, 11, 11)], [(0, 1, 1)], [(0, 1, 2), (1, 3, 4)], [(0, 1, 2)]]


@query("SELECT d.doc_id AS id, section, start_line, end_line FROM documents d JOIN (VALUES " + ", ".join(f"({k}, {a}, {b}, {c})" for k, x in enumerate(_SECTIONS) for a, b, c in x) + ") t(k, section, start_line, end_line) ON t.k = d.doc_id % 4")
def md_sections(v: Views) -> DataFrame:
    return chunking.sections(_case(v, [t for _, t in _MARKDOWN]).withColumnRenamed("value", "text"))


@query("SELECT id, 'p/' || split_part(path, '/', 1) || '/' || path || '#L1-L' || len(string_split(content, chr(10))) || ':0@' || language AS chunk_key FROM files")
def chunk_key(v: Views) -> DataFrame:
    source, lines = F.split("path", "/")[0], F.size(F.split("content", "\n"))
    return v.files.select("id", text.chunk_key(F.lit("p"), source, F.col("path"), F.lit(1), lines, F.lit(0), F.col("language")).alias("chunk_key"))


_PATHS = ["a/x_test.go", "tests/b.py", "scripts/run.py", "x/deploy.sh", "docs/a.go", "README.md", "Dockerfile", "k8s/a.json", "main.tf", "src/main.go", "spec/x.rb", "my/docker-compose.yml"]
_DOMAINS = ["tests", "tests", "ops", "ops", "architecture", "architecture", "infra", "infra", "infra", "code", "tests", "infra"]


@query(_case_sql(["path", "domain"], list(zip(_PATHS, _DOMAINS))))
def domain_classify(v: Views) -> DataFrame:
    return _case(v, _PATHS).select("id", F.col("value").alias("path"), text.classify_domain(F.col("value")).alias("domain"))


@query("SELECT id, token_count FROM chunks WHERE token_count >= 100")
def min_token_filter(v: Views) -> DataFrame:
    return v.chunks.select("id", text.est_tokens(F.col("content")).alias("token_count")).filter("token_count >= 100")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z+]+://', ''), '\\.git/?$', '') AS source_name FROM pages")
def source_name(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.source_name(F.col("url")).alias("source_name"))


@query("SELECT id, CASE WHEN h > 9223372036854775807 THEN h - 18446744073709551616 ELSE h END::BIGINT AS lock FROM (SELECT id, ('0x' || substr(sha256(source_id || ':' || ref_name), 1, 16))::UBIGINT::HUGEINT AS h FROM git_refs)")
def lock_ids(v: Views) -> DataFrame:
    return v.git_refs.select("id", text.lock_id(F.col("source_id"), F.col("ref_name")).alias("lock"))


@query("SELECT id, term FROM (SELECT id, unnest(list_distinct(list_filter(string_split_regex(lower(content), '[^a-z]+'), lambda x: x <> ''))) AS term FROM chunks WHERE chunk_type = 'system') UNION SELECT id, 'from' FROM chunks WHERE chunk_type = 'system' AND list_contains(string_split_regex(lower(content), '[^a-z]+'), 'the')")
def query_expansion(v: Views) -> DataFrame:
    asked = v.chunks.filter("chunk_type = 'system'").select(F.col("id").alias("query_id"), F.regexp_replace(F.lower("content"), "[^a-z]+", " ").alias("query"))
    return ranking.expand_terms(asked, v.spark.createDataFrame([("the", "from")], "term string, synonym string")).withColumnRenamed("query_id", "id")


_TYPES = [("a.go", "text/x-go", "Go"), ("b/c.PY", "text/x-python", "Python"), ("Dockerfile", "text/x-dockerfile", "Dockerfile"), ("x.unknown", "text/plain", None), ("m.d/noend", "text/plain", None), ("r.md", "text/markdown", "Markdown")]


@query(_case_sql(["path", "content_type", "language"], _TYPES))
def content_types(v: Views) -> DataFrame:
    return _case(v, [p for p, _, _ in _TYPES]).select("id", F.col("value").alias("path"), content_type.content_type(F.col("value")).alias("content_type"), content_type.language(F.col("value")).alias("language"))


@query("""SELECT page_id, CASE WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') THEN 'text/html' ELSE 'text/plain' END AS content_type FROM pages""")
def sniffed_types(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", content_type.content_type(F.concat(F.lit("page/"), F.col("page_id").cast("string")), F.col("html")).alias("content_type"))


@query(r"""WITH d AS (SELECT doc_id AS id, lang AS class, doc_id IN (SELECT doc_id FROM labels) AS known, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
t AS MATERIALIZED (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(w) AS word FROM d) GROUP BY ALL),
c AS MATERIALIZED (SELECT class, word, sum(n) AS n FROM t JOIN d USING (id) WHERE known GROUP BY ALL),
k AS (SELECT class, ln(count(*) / (SELECT count(*) FROM d WHERE known)) AS share FROM d WHERE known GROUP BY 1),
s AS (SELECT class, ln(sum(n) + (SELECT count(DISTINCT word) FROM c)) AS size FROM c GROUP BY 1),
seen AS (SELECT id, sum(n) AS seen FROM t WHERE word IN (SELECT word FROM c) GROUP BY 1),
g AS (SELECT t.id, c.class, sum(t.n * ln(c.n + 1.0)) AS gain FROM t JOIN c USING (word) GROUP BY ALL)
SELECT id, class AS language, held_out FROM (SELECT d.id, k.class, NOT d.known AS held_out, row_number() OVER (PARTITION BY d.id ORDER BY round(share - coalesce(seen, 0) * size + coalesce(gain, 0), 6) DESC, k.class) AS r
 FROM d CROSS JOIN k JOIN s ON s.class = k.class LEFT JOIN seen ON seen.id = d.id LEFT JOIN g ON g.id = d.id AND g.class = k.class) WHERE r = 1""")
def content_languages(v: Views) -> DataFrame:
    """The language of every document from its words, as those that have labels teach it."""
    docs = v.table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class"), "text")
    known = v.table("labels").select(F.col("doc_id").alias("id")).distinct()
    told = content_model.classify(docs.select("id", "text"), content_model.train(docs.join(known, "id", "left_semi").select("class", "text")))
    return told.join(known.withColumn("_known", F.lit(True)), "id", "left").select("id", F.col("class").alias("language"), F.col("_known").isNull().alias("held_out"))


_IGNORE = [("a/node_modules/x.js", True), ("src/main.go", False), ("keep.log", True), ("docs/a.md", False), ("private/x.txt", True), ("private/keep.txt", False), ("a/b/build", True), ("builder/x", False), ("x.pyc", True)]


@query(_case_sql(["path", "ignored"], _IGNORE))
def ignore_filter(v: Views) -> DataFrame:
    return _case(v, [p for p, _ in _IGNORE]).select("id", F.col("value").alias("path"), ignore.ignored(F.col("value"), ["# mine", "private/*", "!private/keep.txt"]).alias("ignored"))


# Lines, their characters with line ends before each, and their tokens one by one before each; then the cuts one after the other.
_LINES_SQL = r"""l AS MATERIALIZED (SELECT id, string_split(content, chr(10)) AS l FROM files),
b AS MATERIALIZED (SELECT id, l, len(l) AS n, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda x: length(x) + 1)), 0)::BIGINT) AS c,
 list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda x: ceil(length(x) / 4))), 0)::BIGINT) AS t FROM l)"""
_CHUNK_SQL = """SELECT id, row_number() OVER (PARTITION BY id ORDER BY p)::INT - 1 AS ordinal, p::INT + 1 AS start_line, e::INT AS end_line, array_to_string(l[p + 1:e], chr(10)) AS content,
 ceil(length(array_to_string(l[p + 1:e], chr(10))) / 4)::INT AS token_count FROM w WHERE ceil(length(array_to_string(l[p + 1:e], chr(10))) / 4) >= 5"""


@query(rf"""WITH RECURSIVE {_LINES_SQL},
w0(id, p, e, nxt) AS (SELECT id, 0::BIGINT, NULL::BIGINT, 0::BIGINT FROM b UNION ALL
 SELECT id, nxt, e2, CASE WHEN e2 IS NULL THEN n ELSE CASE WHEN carried > nxt THEN carried ELSE e2 END END FROM (
  SELECT *, list_max(list_filter(range(0, e2), lambda a: t[a + 1] <= t[e2 + 1] - 20)) AS carried FROM (
   SELECT w0.id, w0.nxt, b.n, b.t, list_min(list_filter(range(greatest(w0.nxt, coalesce(w0.e, 0)) + 1, b.n + 1), lambda j: b.c[j + 1] >= b.c[w0.nxt + 1] + 4 * 120 - 2)) AS e2
   FROM w0 JOIN b ON b.id = w0.id WHERE w0.nxt < b.n))),
w AS (SELECT w0.id, w0.p, coalesce(w0.e, b.n) AS e, b.l FROM w0 JOIN b ON b.id = w0.id WHERE NOT (w0.e IS NULL AND w0.nxt = 0))
{_CHUNK_SQL}""")
def chunk_lines(v: Views) -> DataFrame:
    """Every document by lines (C-05): 120 tokens aimed at, 20 carried over."""
    return linechunks.chunks(v.files.select("id", "content"), "plain", chunking.Limits(least=5, target=120, overlap=20))


@query(rf"""WITH RECURSIVE {_LINES_SQL},
w0(id, p, e, nxt) AS (SELECT id, 0::BIGINT, NULL::BIGINT, 0::BIGINT FROM b UNION ALL
 SELECT id, nxt, e2, coalesce(e2, n) FROM (
  SELECT id, nxt, n, CASE WHEN u IS NOT NULL AND (j IS NULL OR u < j) THEN u ELSE list_max(list_filter(range(0, j), lambda a: t[a + 1] <= t[j + 1] - 20)) END AS e2 FROM (
   SELECT w0.id, w0.nxt, b.n, b.t, list_min(list_filter(range(w0.nxt + 1, b.n), lambda i: NOT contains(b.l[i + 1], '|') AND starts_with(trim(b.l[i + 1], ' ' || chr(9) || chr(13)), '#'))) AS u,
    list_min(list_filter(range(w0.nxt + 1, b.n + 1), lambda j: b.c[j + 1] >= b.c[w0.nxt + 1] + 4 * 150 + 2 AND b.t[j + 1] >= b.t[w0.nxt + 2] + 20 AND NOT contains(b.l[j], '|'))) AS j
   FROM w0 JOIN b ON b.id = w0.id WHERE w0.nxt < b.n))),
w AS (SELECT w0.id, w0.p, coalesce(w0.e, b.n) AS e, b.l FROM w0 JOIN b ON b.id = w0.id WHERE NOT (w0.e IS NULL AND w0.nxt = 0))
{_CHUNK_SQL}""")
def chunk_markdown(v: Views) -> DataFrame:
    """Every document as Markdown (C-02): 150 tokens at most, 20 carried over.  A line with a bar is a table's; the documents hold no fences, which tests cover."""
    return linechunks.chunks(v.files.select("id", "content"), "markdown", chunking.Limits(most=150, least=5, overlap=20))


@query()
def chunk_plain(v: Views) -> DataFrame:
    return chunking.chunk_files(v.files).drop("content")


@query("SELECT id, 'File: ' || path || chr(10) || 'Package: ' || language || chr(10) || chr(10) || content AS context FROM files")
def embedding_context(v: Views) -> DataFrame:
    return v.files.select("id", ask.embedding_context(F.col("content"), F.col("path"), F.col("language"), parent=F.lit(None).cast("string")).alias("context"))


@query()
def embed_chunks(v: Views) -> DataFrame:
    return ask.embed(v.chunks.select("id", "content"), ask.HashingEmbedder()).select("id", "vector")


# Ranking and quality


def _bm25_sql(words: list[str]) -> str:
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / al))" for i in range(len(words)))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    return rf"""WITH a AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT id, len(t)::DOUBLE AS l, {tf} FROM a), s AS (SELECT count(*) AS n, avg(l) AS al, {df} FROM b)
SELECT id, round({score}, 6) AS keyword FROM b, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(words)))}"""


@query(_bm25_sql(["from", "que", "thing"]))
def keyword_bm25(v: Views) -> DataFrame:
    return _keywords(v).scores(["thing", "que", "from"])


@query("SELECT * FROM (" + _bm25_sql(["from", "que", "thing"]) + ") ORDER BY keyword DESC, id LIMIT 20")
def keyword_top(v: Views) -> DataFrame:
    return _keywords(v).best(["thing", "que", "from"], ranking.FINE)


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences, sum(doc_id)::BIGINT AS ids FROM t GROUP BY term""")
def keyword_index_contents(v: Views) -> DataFrame:
    """The inverted index, built anew in two segments: every term with its documents and occurrences."""
    root, docs = lineage.shared_folder(v.spark), v.files.select("id", F.col("content").alias("text"))
    for rest, segment in enumerate(("even", "odd")):
        inverted.add(docs.filter(F.abs(F.col("id") % 2) == rest), root, segment)
    rows = inverted.Index(v.spark, root).postings().select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
    return rows.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.col("p.tfs").cast("bigint")).alias("occurrences"), F.sum(F.col("p.ids") * F.col("p.tfs")).alias("ids"))


def _keywords(v: Views) -> inverted.Index:
    build = lambda root: inverted.add(v.files.select("id", F.col("content").alias("text")), root, "all")
    return kept(v.table("documents"), "keywords", build, lambda root: inverted.Index(v.spark, root))


@query("""WITH a AS (SELECT chunk_id AS id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM scored),
k AS (SELECT doc_id AS id, (n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER ())::DOUBLE AS k FROM documents)
SELECT coalesce(a.id, k.id) AS id, round(0.7 * coalesce(s, 0) + 0.3 * coalesce(k, 0), 6) AS hybrid FROM a FULL JOIN k ON a.id = k.id""")
def fusion_minmax(v: Views) -> DataFrame:
    hits = search.scored(v.embeddings, v.query_vector()).select(F.col("chunk_id").alias("id"), "score")
    return ranking.fuse(hits, v.files.select("id", F.col("size").cast("double").alias("keyword")))


@query("""SELECT s.chunk_id AS id, round((0.5 * s.score + 0.2 * (d.n_chars % 100) / 100.0 + 0.15 * (d.doc_id % 10) / 10.0 + 0.1 * (d.doc_id % 7) / 7.0) * CASE WHEN d.doc_id % 4 = 0 THEN 0.7 ELSE 1 END
 * CASE WHEN l.quality = 1 THEN 1.2 WHEN l.quality = 0 THEN 0.7 ELSE 1 END * pow(0.9, coalesce(l.toxic, 0)), 4) AS final FROM scored s JOIN documents d ON d.doc_id = s.chunk_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def rerank_final_score(v: Views) -> DataFrame:
    rows = search.scored(v.embeddings, v.query_vector()).withColumnRenamed("chunk_id", "doc_id").join(v.table("documents").select("doc_id", "n_chars"), "doc_id").join(v.table("labels"), "doc_id", "left")
    parts = {"hybrid": F.col("score"), "keyword": F.col("n_chars") % 100 / 100, "importance": F.col("doc_id") % 10 / 10, "freshness": F.col("doc_id") % 7 / 7, "path": F.lit(None).cast("double")}
    final = ranking.adjusted(ranking.final_score(parts), F.col("doc_id") % 4 == 0, F.col("quality"), F.col("toxic"))
    return rows.select(F.col("doc_id").alias("id"), F.round(final, 4).alias("final"))


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) <> 0 AND coalesce(l.toxic, 0) <> 1")
def quality_penalty(v: Views) -> DataFrame:
    rows = v.table("documents").join(v.table("labels"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "needs_fix").alias("ingest_status"), F.when(F.col("toxic") == 1, "detected").alias("secret_scan"))
    return ranking.exclude(rows).select("id")


_QUESTIONS = ["How do I deploy the service?", "Which endpoint takes the request", "Why this architecture", "where is the function parse", "hello"]
_INTENTS = ["operations", "api_spec", "design", "code_reading", "default"]


@query(_case_sql(["query", "intent"], list(zip(_QUESTIONS, _INTENTS))))
def intent_classify(v: Views) -> DataFrame:
    return _case(v, _QUESTIONS).select("id", F.col("value").alias("query"), text.classify_intent(F.col("value")).alias("intent"))


@query("""WITH r AS (SELECT a.chunk_id AS query_id, b.chunk_id AS id, a.model = b.model AS hit, row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 9) DESC, b.chunk_id) AS rank FROM vectors a, vectors b WHERE a.chunk_id % 100 = 0 AND b.chunk_id <> a.chunk_id),
w AS (SELECT a.chunk_id AS query_id, count(*) AS wanted FROM vectors a JOIN vectors b ON a.model = b.model AND a.chunk_id <> b.chunk_id WHERE a.chunk_id % 100 = 0 GROUP BY 1)
SELECT r.query_id, round(count(*) FILTER (hit AND rank <= 5) / 5.0, 6)::DOUBLE AS precision_5, round(count(*) FILTER (hit AND rank <= 20) / any_value(wanted)::DOUBLE, 6) AS recall_20,
 round(coalesce(sum(1 / log2(rank + 1.0)) FILTER (hit AND rank <= 10), 0) / any_value(list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1 / log2(i + 1.0)))), 6) AS ndcg_10, round(avg(rank) FILTER (hit), 6) AS acr
FROM r JOIN w ON w.query_id = r.query_id WHERE rank <= 50 GROUP BY r.query_id""")
def retrieval_metrics(v: Views) -> DataFrame:
    q = v.embeddings.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("model").alias("wanted"))
    ranked = search.batch_top_k(v.embeddings, q.drop("wanted"), 50, digits=9, itself=False).select("query_id", "rank", F.col("chunk_id").alias("id"))
    # The relevant rows of a query are those of its label but itself: counted by label, and looked up for the ranked rows alone.
    model = v.embeddings.select(F.col("chunk_id").alias("id"), "model")
    counts = model.groupBy(F.col("model").alias("wanted")).agg((F.count("*") - 1).alias("n"))
    labelled = q.drop("query_vector").join(counts, "wanted").filter("n > 0")
    rows = ranked.join(model, "id").join(labelled, "query_id").withColumn("hit", (F.col("model") == F.col("wanted")).cast("int"))
    return ranking.graded(rows, labelled.select("query_id", F.col("n").alias("wanted")))


@query("""WITH o AS (SELECT event_type AS metric, avg(value) AS old FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), n AS (SELECT event_type AS metric, avg(value) * CASE WHEN event_type = 'click' THEN 0.5 ELSE 1 END AS new FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT metric, round(old, 6) AS old, round(new, 6) AS new, round((old - new) / old, 6) AS "drop" FROM o JOIN n USING (metric) WHERE (old - new) / old > 0.05""")
def regression_gate(v: Views) -> DataFrame:
    e, half = v.table("events").withColumnRenamed("event_type", "metric"), F.lit("2024-01-15").cast("timestamp_ntz")
    old = e.filter(F.col("ts") < half).groupBy("metric").agg(F.avg("value").alias("value"))
    new = e.filter(F.col("ts") >= half).groupBy("metric").agg(F.avg("value").alias("value")).withColumn("value", F.col("value") * F.when(F.col("metric") == "click", 0.5).otherwise(1.0))
    return ranking.regressions(old, new).select("metric", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "drop")


_NOTES = "SELECT event_id AS note_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity, ts, value > 50 AS resolved FROM events"


@query(f"""WITH n AS ({_NOTES}), r AS (SELECT *, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, note_id) AS k FROM n)
SELECT note_id, week, CASE severity WHEN 'critical' THEN 'P1' WHEN 'high' THEN 'P2' ELSE 'P3' END AS priority, CASE WHEN k <= 5 THEN 'open' ELSE 'noop' END AS status FROM r""")
def quality_backlog_top5(v: Views) -> DataFrame:
    return ranking.backlog(_notes(v))


@query(f"WITH n AS ({_NOTES}) SELECT severity, count(*) AS notes, count(*) FILTER (resolved) AS resolved, (DATE '{AS_OF}' - max(ts)::DATE)::INT AS days_since_last FROM n GROUP BY 1")
def quality_metrics(v: Views) -> DataFrame:
    return ranking.quality_metrics(_notes(v), AS_OF)


def _notes(v: Views) -> DataFrame:
    e = F.col("event_type")
    severity = F.when(e == "error", "critical").when(e == "purchase", "high").when(e == "signup", "medium").otherwise("low")
    return v.table("events").select(F.col("event_id").alias("note_id"), severity.alias("severity"), "ts", (F.col("value") > 50).alias("resolved"))


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high,
 round(quantile_cont(round(value, 3), 0.1), 4) AS p10, round(quantile_cont(round(value, 3), 0.5), 4) AS p50, round(quantile_cont(round(value, 3), 0.9), 4) AS p90 FROM events GROUP BY 1""")
def similarity_drift_weekly(v: Views) -> DataFrame:
    return kpis.distribution(v.table("events").select("ts", F.col("value").alias("score")))


def _searches(v: Views) -> DataFrame:
    """The events as a log of searches."""
    kind = F.col("event_type")
    liked = F.when(kind == "purchase", True).when(kind == "error", False)
    return v.table("events").select("ts", F.when(kind == "error", 0).otherwise(3).alias("hits"), (kind == "view").alias("cached"), liked.alias("liked"), (kind == "click").alias("requery"), (F.col("value") * 20).alias("latency_ms"))


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS searches, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS cache_rate,
 round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 6) AS like_rate, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS requery_rate, true AS p95_within FROM events GROUP BY 1""")
def search_kpis_weekly(v: Views) -> DataFrame:
    log = _searches(v)
    weeks = kpis.merged(kpis.daily(log)).withColumn("week", F.date_format("period", "yyyy-MM-dd")).drop("period")
    ms = log.select(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "latency_ms").join(F.broadcast(weeks), "week")  # a row a week
    return ms.groupBy(*(c for c in weeks.columns if c != "p95_ms")).agg(kpis.within_rank(F.col("latency_ms"), F.col("p95_ms"), 0.95).alias("p95_within"))


@query("""WITH w AS (SELECT date_trunc('week', ts) AS period, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate, count(*) FILTER (event_type = 'view') / count(*) AS cache_rate,
 count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0) AS like_rate, count(*) FILTER (event_type = 'click') / count(*) AS requery_rate FROM events GROUP BY 1),
r AS (SELECT period, 'success_rate' AS kpi, success_rate AS value, 0.9 AS target, round(success_rate, 6) < 0.9 AS bad FROM w UNION ALL SELECT period, 'cache_rate', cache_rate, 0.4, round(cache_rate, 6) < 0.4 FROM w
 UNION ALL SELECT period, 'like_rate', like_rate, 0.8, round(like_rate, 6) < 0.8 FROM w UNION ALL SELECT period, 'requery_rate', requery_rate, 0.2, round(requery_rate, 6) > 0.2 FROM w),
g AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY kpi ORDER BY period), false) AS grave FROM r)
SELECT strftime(period, '%Y-%m-%d') AS week, kpi, round(value, 6) AS value, target::DOUBLE AS target, grave FROM g WHERE bad""")
def search_kpi_alerts(v: Views) -> DataFrame:
    rows = kpis.missed(kpis.merged(kpis.daily(_searches(v))), "P2").filter("kpi <> 'p95_ms'")
    return rows.select(F.date_format("period", "yyyy-MM-dd").alias("week"), "kpi", "value", "target", "grave")


@query("SELECT c.id, CASE WHEN x.kind = 'p' THEN 'parent' ELSE 'child' END AS kind, x.other FROM (SELECT 'n3' AS id) c JOIN (SELECT child AS id, 'p' AS kind, parent AS other FROM hierarchy UNION ALL SELECT parent, 'c', child FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ordinal, child) AS k FROM hierarchy) WHERE k <= 10) x ON x.id = c.id")
def family_expansion(v: Views) -> DataFrame:
    return ranking.expand_family(v.spark.createDataFrame([("n3",)], "id string"), v.hierarchy)


@query("SELECT doc_id AS id, max(s)::DOUBLE AS score FROM (SELECT doc_id, doc_id % 7 AS s FROM documents UNION ALL SELECT doc_id, doc_id % 5 FROM documents) GROUP BY 1")
def query_rewrite_merge(v: Views) -> DataFrame:
    d = v.table("documents").select(F.col("doc_id").alias("id"))
    return ranking.merge_rewrites(d.withColumn("score", (F.col("id") % 7).cast("double")), d.withColumn("score", (F.col("id") % 5).cast("double")))


@query("""WITH a AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 200), b AS (SELECT a.*, d.n_chars FROM a JOIN documents d ON d.doc_id = a.chunk_id ORDER BY score + n_chars / 1e6 DESC, chunk_id LIMIT 20)
SELECT chunk_id AS id FROM b ORDER BY score + n_chars / 1e6 + (chunk_id % 10) / 100.0 DESC, chunk_id LIMIT 10""")
def cascade_stages(v: Views) -> DataFrame:
    first = search.similar_chunks(v.embeddings, v.query_vector(), ranking.COARSE)
    rows = first.select(F.col("chunk_id").alias("id"), "score").join(v.files.select("id", "size"), "id")
    fine = F.col("score") + F.col("size") / 1e6
    return ranking.cascade(rows, F.col("score"), fine, fine + F.col("id") % 10 / 100).select("id")


@query("SELECT string_agg(part, chr(10) || chr(10) ORDER BY score DESC, chunk_id) AS context FROM (SELECT s.chunk_id, s.score, '### ' || row_number() OVER (ORDER BY s.score DESC, s.chunk_id) || '. ' || f.path || ' (score ' || printf('%.3f', s.score) || ')' || chr(10) || f.content AS part FROM (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 5) s JOIN files f ON f.id = s.chunk_id)")
def prompt_context(v: Views) -> DataFrame:
    hits = search.similar_chunks(v.embeddings, v.query_vector(), 5).select("chunk_id", "score").join(v.files.select(F.col("id").alias("chunk_id"), "path", "content"), "chunk_id")
    return ask.context(hits)


# Windows over time (extension)


@query("""SELECT w AS window_start, 'u' || user_id || '.go' AS path, count(*) AS edits FROM (SELECT user_id, unnest([date_trunc('day', ts) - INTERVAL (i) DAY FOR i IN [0, 1, 2, 3, 4, 5, 6]]) AS w FROM events) GROUP BY ALL""")
def edit_windows(v: Views) -> DataFrame:
    return edits.edit_windows(v.commits)


@query("""SELECT w AS window_start, 'u' || user_id || '.go' AS path, count(*) AS edits FROM (SELECT user_id, unnest([date_trunc('day', ts) - INTERVAL (i) DAY FOR i IN [0, 1, 2, 3, 4, 5, 6]]) AS w FROM events) GROUP BY ALL""")
def edit_windows_stream(v: Views) -> DataFrame:
    return edits.written_windows(v.commit_stream, lineage.shared_folder(v.spark))


@query("SELECT source_id, version, ts FROM (SELECT path AS source_id, hash AS version, ts, row_number() OVER (PARTITION BY path ORDER BY ts DESC, hash DESC) AS k FROM commits) WHERE k = 1")
def latest_versions_stream(v: Views) -> DataFrame:
    versions = v.commit_stream.select(F.col("path").alias("source_id"), F.col("hash").alias("version"), "ts")
    return latest.written_latest(versions, lineage.shared_folder(v.spark))


# Lookups, changes and gates by key


@query("SELECT id, file_id, ordinal, token_count FROM chunks WHERE id = 4001")
def chunk_by_id(v: Views) -> DataFrame:
    return search.by_key(v.chunks, "id", 4001).select("id", "file_id", "ordinal", "token_count")


@query("SELECT chunk_id, model, list_sum(list_transform(vector, lambda x: round(x, 4)))::DOUBLE AS total FROM vectors WHERE chunk_id = 7")
def embedding_by_chunk(v: Views) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.round(x.cast("double"), 4))
    return search.by_key(v.embeddings, "chunk_id", 7).select("chunk_id", "model", total.alias("total"))


@query("SELECT s.id, s.summary_type, e.model FROM summaries s JOIN vectors e ON e.chunk_id = s.id WHERE s.id = 12")
def summary_embedding(v: Views) -> DataFrame:
    return search.by_key(v.embeddings, "chunk_id", 12).join(v.summaries.select(F.col("id").alias("chunk_id"), "summary_type"), "chunk_id").select(F.col("chunk_id").alias("id"), "summary_type", "model")


@query("SELECT hash, path, author FROM commits WHERE hash = sha1('17')")
def commit_by_hash(v: Views) -> DataFrame:
    return search.by_key(v.commits, "hash", hashlib.sha1(b"17").hexdigest()).select("hash", "path", "author")


@query("SELECT id, name FROM products UNION ALL SELECT 99, 'ATLANTIS'")
def get_or_create_product(v: Views) -> DataFrame:
    wanted = v.spark.createDataFrame([(98, "ASIA"), (99, "ATLANTIS")], "id int, name string")
    return catalog.insert_or_ignore(v.products.select("id", "name"), wanted, ["name"])


@query("SELECT parent, child, ordinal FROM hierarchy UNION ALL SELECT 'r0', 'r1', 7 UNION ALL SELECT 'n1', 'n2', 0")
def link_edges(v: Views) -> DataFrame:
    return graph.link(v.hierarchy, v.spark.createDataFrame([("r0", "r1", 7), ("n1", "n2", 0)], "parent string, child string, ordinal bigint"))


@query("SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 10")
def search_default_limit(v: Views) -> DataFrame:
    return search.similar_chunks(v.embeddings, v.query_vector(), 0).select("chunk_id", "score")


@query("""SELECT c.id, p.model, round(c.token_count / 1000.0 * p.i + c.ordinal / 1000.0 * p.o, 9)::DOUBLE AS cost FROM chunks c LEFT JOIN (VALUES ('user', 0.5, 1.5), ('assistant', 2.0, 8.0)) p(model, i, o) ON p.model = c.chunk_type""")
def llm_cost(v: Views) -> DataFrame:
    usage = v.chunks.select("id", F.col("chunk_type").alias("model"), F.col("token_count").alias("input_tokens"), F.col("ordinal").alias("output_tokens"))
    prices = v.spark.createDataFrame([("user", 0.5, 1.5), ("assistant", 2.0, 8.0)], "model string, input_price double, output_price double")
    return repository.cost(usage, prices).select("id", F.when(F.col("input_price").isNotNull(), F.col("model")).alias("model"), F.round("cost", 9).alias("cost"))


@query("SELECT chunk_type, count(DISTINCT file_id) AS files, 0::BIGINT AS failed, count(*) AS chunks, round(avg(cyclomatic_complexity), 4) AS mean_complexity, max(cyclomatic_complexity) AS max_complexity FROM chunks GROUP BY 1")
def chunk_stats(v: Views) -> DataFrame:
    return indexing.stats(v.chunks.withColumn("error", F.lit(None).cast("string")))


@query(r"""WITH l AS (SELECT doc_id AS id, regexp_extract(text, '([^\n]*\S)\s*$', 1) AS last FROM documents)
SELECT id, regexp_matches(last, '(:|、|,|以下の|次の|以下に|次に|following|next|below)$') OR regexp_matches(last, '(以下の|次の|以下に|次に|following|next|below)(:|、)') AS incomplete FROM l""")
def incomplete_endings(v: Views) -> DataFrame:
    return v.files.select("id", text.incomplete_ending(F.col("content")).alias("incomplete"))


@query("SELECT id, substr(content, 1, 400) AS content FROM files")
def trimmed_files(v: Views) -> DataFrame:
    return v.files.select("id", text.trimmed(F.col("content"), 100).alias("content"))


# Go source: a file for every part, written from its columns


def _go(v: Views) -> DataFrame:
    t, n = lineage.spread(v.table("part").select("p_partkey", "p_size"), "p_partkey"), F.col("p_partkey").cast("string")
    lines = (
        F.lit("// Package parts holds prices.\npackage parts\n\nimport (\n\t\"fmt\"\n\tnet \"net/http\"\n"), F.concat(F.lit('\t"example.org/brand'), n, F.lit('/lib"\n)\n\n')),
        F.concat(F.lit("// Price"), n, F.lit(" is { a price.\nfunc (p *Part) Price"), n, F.lit("(a, n int, by map[string]*lib.Rate) (int, error) {\n\ts := \"}\"\n\tif n > ")),
        F.concat(F.col("p_size").cast("string"), F.lit(" && a < 100 {\n\t\treturn fmt.Sum(n), nil\n\t}\n\n\t// all of them\n\tfor i := 0; i < n; i++ {\n\t\tnet.Get(i)\n\t}\n\treturn n, nil\n}\n\n")),
        F.concat(F.lit("type Part"), n, F.lit(" struct {\n\tName string\n\tSize int\n}\n")),
    )
    return t.select(F.col("p_partkey").alias("id"), F.lit("Go").alias("language"), F.lit("text/x-go").alias("content_type"), F.concat(*lines).alias("content"))


@query("""SELECT p_partkey AS id, kind, CASE WHEN kind = 'package' THEN 'parts' WHEN kind = 'method' THEN 'Price' || p_partkey ELSE 'Part' || p_partkey END AS name, parent,
 CASE WHEN kind = 'method' THEN 'Price' || p_partkey || ' (a int, n int, by map[string]*lib.Rate) int, error' END AS signature, start_line, end_line, calls, complexity, lines_of_code
FROM part, (VALUES ('package', NULL, 2, 2, '', 1, 1), ('method', 'Part', 11, 22, 'fmt.Sum,net.Get', 4, 10), ('struct', NULL, 24, 27, '', 1, 4)) t(kind, parent, start_line, end_line, calls, complexity, lines_of_code)""")
def go_declarations(v: Views) -> DataFrame:
    return gocode.describe(_go(v)).drop("types", "error")


@query("SELECT p_partkey AS id, path, is_standard FROM part, (VALUES ('fmt', true), ('net/http', true)) t(path, is_standard) UNION ALL SELECT p_partkey, 'example.org/brand' || p_partkey || '/lib', false FROM part")
def go_imports(v: Views) -> DataFrame:
    return gocode.imported(_go(v)).drop("error")


@query("SELECT p_partkey AS id, 'Price' || p_partkey AS name, kind, start_line, end_line FROM part, (VALUES ('initialization', 12, 12), ('conditional', 13, 15), ('loop', 18, 20), ('return', 21, 21)) t(kind, start_line, end_line)")
def go_logic(v: Views) -> DataFrame:
    return gocode.logic(_go(v)).drop("error")


@query("""SELECT p_partkey AS id, 'Language: Go' || chr(10) || chr(10) || 'Components:' || chr(10) || '- Method: Price' || p_partkey || chr(10) || '- Struct: Part' || p_partkey || chr(10) || chr(10) || 'Dependencies:' || chr(10)
 || '- example.org/brand' || p_partkey || '/lib' || chr(10) || '- fmt' || chr(10) || '- net/http' || chr(10) || chr(10) || 'Description: Package parts holds prices.' AS summary FROM part""")
def go_file_summary(v: Views) -> DataFrame:
    return gocode.summarised(_go(v), chunking.estimate)


@query("""SELECT p_partkey AS file_id, chunk_type, CASE WHEN chunk_type = 'package' THEN 'parts' WHEN chunk_type = 'method' THEN 'Price' || p_partkey ELSE 'Part' || p_partkey END AS chunk_name, start_line, end_line
FROM part, (VALUES ('method', 11, 22), ('struct', 24, 27)) t(chunk_type, start_line, end_line)""")
def go_chunks(v: Views) -> DataFrame:
    return chunking.chunk_files(_go(v)).select("file_id", "chunk_type", "chunk_name", "start_line", "end_line")


@query(r"""SELECT p_partkey AS id, '4,11,24' AS lines FROM part""")
def unit_lines(v: Views) -> DataFrame:
    return _go(v).select("id", F.array_join(F.transform(text.unit_lines(F.col("content"), chunking.BOUNDARIES), lambda x: x.cast("string")), ",").alias("lines"))


# Summaries from files to architecture, and the wiki


def _stub(body: Column) -> Column:
    """A model for the queries below: what it writes tells its whole prompt."""
    return F.concat(F.lit("S:"), F.substring(F.sha2(body, 256), 1, 12))


_LEVEL = """{name}_lines AS (SELECT snapshot_id, regexp_replace(target_path, '/?[^/]*$', '') AS dir, target_path, source_hash, target_path || ': ' || content AS line FROM {of}),
{name}_held AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY snapshot_id, dir ORDER BY target_path) AS so_far FROM {name}_lines),
{name} AS (SELECT snapshot_id, dir AS target_path, sha256(string_agg(source_hash, ':' ORDER BY source_hash)) AS source_hash, 'S:' || substr(sha256(string_agg(line, chr(10) ORDER BY target_path) FILTER (so_far <= 8001)), 1, 12) AS content FROM {name}_held GROUP BY snapshot_id, dir)"""


@query(f"""WITH f AS (SELECT snapshot_id, path AS target_path, content_hash AS source_hash, CASE WHEN id % 4 = 1 AND id % 8 <> 1 THEN 'OLD' ELSE 'S:' || substr(sha256(array_slice(encode(content), 1, 8000)), 1, 12) END AS content FROM files),
{_LEVEL.format(name="d2", of="f")},
{_LEVEL.format(name="d1", of="d2")},
{_LEVEL.format(name="d0", of="d1")},
d AS (SELECT *, 2 AS depth FROM d2 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 0 FROM d0),
a AS (SELECT snapshot_id, sha256(string_agg(source_hash, ':' ORDER BY source_hash)) AS source_hash, string_agg(target_path || ': ' || content, chr(10) ORDER BY target_path) AS body FROM d GROUP BY snapshot_id)
SELECT snapshot_id, 'file' AS summary_type, target_path, NULL::VARCHAR AS arch_type, NULL::INT AS depth, source_hash, content FROM f
UNION ALL SELECT snapshot_id, 'directory', target_path, NULL, depth, source_hash, content FROM d
UNION ALL SELECT snapshot_id, 'architecture', '', t, NULL, source_hash, 'S:' || substr(sha256(t || chr(10) || body), 1, 12) FROM a, (VALUES ('overview'), ('tech_stack'), ('data_flow'), ('components')) k(t)""")
def summary_pipeline(v: Views) -> DataFrame:
    source = F.when(F.col("id") % 8 == 1, "stale").otherwise(F.col("content_hash"))
    old = v.files.filter("id % 4 = 1").select(F.lit("file").alias("summary_type"), F.col("path").alias("target_path"), F.lit(None).cast("string").alias("arch_type"), source.alias("source_hash"), F.lit("OLD").alias("content"))
    return summaries.summarise_all(v.files, old, _stub).drop("content_hash")


def _wiki_sql() -> str:
    part = "'### ' || row_number() OVER (ORDER BY score DESC, id) || '. ' || path || ' (score ' || printf('%.3f', score) || ')' || chr(10) || content"
    rows = []
    for section, _ in ask.SECTIONS:
        vector_ = f"{ask.HashingEmbedder().embed([ask.QUESTIONS[section]])[0]}::DOUBLE[]"
        score = f"round(list_cosine_similarity(e.vector, {vector_}), 6)"
        inside = "JOIN latest l ON l.id = {0}.snapshot_id JOIN sources o ON o.id = l.source_id WHERE o.product_id = 1 AND {1} IS NOT NULL"
        code = f"SELECT f.id, f.path, f.content, {score} AS score FROM vectors e JOIN files f ON f.id = e.chunk_id {inside.format('f', score)} ORDER BY score DESC, f.id LIMIT 10"
        structure = f"SELECT s.id, s.target_path AS path, s.content, {score} AS score FROM vectors e JOIN summaries s ON s.id = e.chunk_id {inside.format('s', score)} ORDER BY score DESC, s.id LIMIT 5"
        text_ = lambda hits: f"(SELECT string_agg(part, chr(10) || chr(10) ORDER BY score DESC, id) FROM (SELECT id, score, {part} AS part FROM ({hits})))"
        rows.append(f"SELECT '{section}' AS section, {text_(structure)} AS structure, {text_(code)} AS code")
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ")"


@query(_wiki_sql())
def wiki_sections(v: Views) -> DataFrame:
    """The four sections' questions in one pass over the vectors of chunks and one over those of summaries; contents are fetched for the hits alone."""
    latest, embedder = _latest_of(v, 1), ask.HashingEmbedder()
    asked = {section: embedder.embed([ask.QUESTIONS[section]])[0] for section, _ in ask.SECTIONS}

    def hits(rows: DataFrame, path: str, k: int) -> DataFrame:
        inside = rows.select(F.col("id").alias("chunk_id"), "snapshot_id").join(latest, "snapshot_id", "left_semi")
        best = search.top_of_each(v.embeddings.join(inside.select("chunk_id"), "chunk_id", "left_semi"), asked, k)
        texts = rows.select(F.col("id").alias("chunk_id"), F.col(path).alias("path"), "content")
        return texts.join(F.broadcast(best), "chunk_id").select(F.col("query").alias("section"), "chunk_id", "path", "content", "score")  # k rows a section

    return ask.section_pages(hits(v.files, "path", search.DEFAULT_LIMIT), hits(v.summaries, "target_path", search.DEFAULT_SUMMARIES))


# A whole index run


@query("""WITH f AS (SELECT 'src/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '/a.md' ELSE '/b/c.txt' END AS path FROM documents WHERE doc_id % 17 <> 0),
d AS (SELECT DISTINCT unnest(['', 'src', regexp_replace(path, '/[^/]*$', ''), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir FROM f)
SELECT 'files' AS t, count(*) AS n FROM f UNION ALL SELECT 'markdown files', count(*) FILTER (path LIKE '%.md') FROM f UNION ALL SELECT 'snapshots', 1 UNION ALL SELECT 'file summaries', count(*) FROM f
UNION ALL SELECT 'directory summaries', count(*) FROM d UNION ALL SELECT 'architecture summaries', 4 UNION ALL SELECT 'summary vectors', (SELECT count(*) FROM f) + (SELECT count(*) FROM d) + 4 UNION ALL SELECT 'skipped', 1
UNION ALL SELECT 'bytes of files', (SELECT sum(strlen(text))::BIGINT FROM documents WHERE doc_id % 17 <> 0) UNION ALL SELECT 'beginnings of hashes', (SELECT sum(('0x' || substr(sha256(text), 1, 8))::UBIGINT)::BIGINT FROM documents WHERE doc_id % 17 <> 0)
UNION ALL SELECT 'embeddings without chunk', 0 UNION ALL SELECT 'chunks without embedding, cell or keywords', 0""")
def index_version(v: Views) -> DataFrame:
    i, folder = F.col("doc_id"), lineage.shared_folder(v.spark)
    ending = F.when(i % 17 == 0, "/node_modules/x.js").when(i % 3 == 0, "/a.md").otherwise("/b/c.txt")
    docs = v.table("documents").select(F.concat(F.lit("src/"), i.cast("string"), ending).alias("path"), F.col("text").cast("binary").alias("content"))
    indexing.index(docs, folder, "p", "s", "v1", write=_stub)
    again = indexing.index(docs, folder, "p", "s", "v1", write=_stub)
    read = lambda name: v.spark.read.parquet(f"{folder}/{name}")
    kinds = {f"{k} summaries": read("summaries").filter(F.col("summary_type") == k) for k in ("file", "directory", "architecture")}
    tables = {"files": read("files"), "markdown files": read("files").filter("content_type = 'text/markdown'"), "snapshots": read("snapshots"), **kinds, "summary vectors": read("summary_embeddings")}
    counts = [t.agg(F.lit(name).alias("t"), F.count("*").alias("n")).select("t", "n") for name, t in tables.items()]
    files, chunks = read("files"), read("chunks").filter("error is null").select(F.col("id").alias("chunk_id"))
    embedded, placed = read("embeddings").select("chunk_id"), read("cells/vectors").select("chunk_id")
    told = inverted.Index(v.spark, f"{folder}/keywords").postings().select(F.explode("ids").alias("chunk_id")).distinct()
    number = lambda name, rows: rows.agg(F.lit(name).alias("t"), F.count("*").alias("n")).select("t", "n")
    lost = chunks.join(embedded.intersect(placed).intersect(told), "chunk_id", "left_anti")
    counts += [
        files.agg(F.lit("bytes of files").alias("t"), F.sum("size").alias("n")).select("t", "n"),
        files.agg(F.lit("beginnings of hashes").alias("t"), F.sum(F.conv(F.substring("content_hash", 1, 8), 16, 10).cast("bigint")).alias("n")).select("t", "n"),
        number("embeddings without chunk", embedded.join(chunks, "chunk_id", "left_anti")), number("chunks without embedding, cell or keywords", lost),
    ]
    return reduce(DataFrame.unionAll, [*counts, v.spark.createDataFrame([("skipped", int(again.skipped))], "t string, n bigint")])
