"""Vector, hybrid and context search (A-06, A-07, B-02 to B-11, J-02 to J-04, J-12, J-15, K-01, K-04)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector

DEFAULT_LIMIT, DEFAULT_SUMMARIES = 10, 5
#: A side that grows with the corpus is broadcast only when it has at most so many rows.
BROADCAST_ROWS = 200_000
#: Numbers of a block of rows that a task holds, queries that meet it at a time, and scores that are held at a time.
BLOCK_VALUES, QUERY_BLOCK, SCORES = 1 << 24, 1_000, 1 << 22


def limit_or(limit: int | None, default: int = DEFAULT_LIMIT) -> int:
    """K-04: nothing, zero and negative limits mean the default."""
    return limit if limit and limit > 0 else default


def small(df: DataFrame) -> DataFrame:
    """The table, computed once and broadcast, if it has ``BROADCAST_ROWS`` rows at most; a larger one is left to the shuffle joins."""
    held = df.limit(BROADCAST_ROWS + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(held, df.schema)) if held.num_rows <= BROADCAST_ROWS else df


def by_key(table: DataFrame, key: str, value: object) -> DataFrame:
    """F-10, F-12, F-17, S-07: the row of a key; the condition reaches the scan."""
    return table.filter(F.col(key) == F.lit(value))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """A-06: the indexed snapshot of each source that was indexed last (NULLS LAST), then created last, then the smaller id."""
    order = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("indexed_at"), F.desc_nulls_last("created_at"), F.asc("id"))
    return snapshots.filter("indexed").withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def latest_snapshot(snapshots: DataFrame, source_id: str) -> DataFrame:
    """A-07: the same for one source."""
    mine = snapshots.filter(F.col("indexed") & (F.col("source_id") == source_id))
    return mine.orderBy(F.desc_nulls_last("indexed_at"), F.desc_nulls_last("created_at"), F.asc("id")).limit(1)


def filtered(files: DataFrame, path_prefix: str | None = None, content_type: str | None = None, like: bool = False) -> DataFrame:
    """Only conditions that are asked for enter the plan; ``like`` lets % and _ in the prefix act as wildcards."""
    if path_prefix:
        files = files.filter(F.col("path").like(path_prefix + "%") if like else F.col("path").startswith(path_prefix))
    if content_type:
        files = files.filter(F.col("content_type") == content_type)
    return files


def top(df: DataFrame, key: str, limit: int) -> DataFrame:
    """K-01: best scores, ties by key; rows without a score don't take part."""
    return df.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), F.asc(key)).limit(limit)


def scored(rows: DataFrame, query: Sequence[float]) -> DataFrame:
    return rows.withColumn("score", vector.score(F.col("vector"), vector.literal(query)))


def similar_chunks(embeddings: DataFrame, query: Sequence[float], k: int | None = None) -> DataFrame:
    """B-02: over all chunks."""
    return top(scored(embeddings, query), "chunk_id", limit_or(k))


def chunks_of(embeddings: DataFrame, files: DataFrame) -> DataFrame:
    """Embedded chunks with their files (a file's first chunk has the file's id)."""
    return embeddings.join(files, embeddings["chunk_id"] == files["id"]).drop(files["id"])


def latest_of_product(snapshots: DataFrame, sources: DataFrame, product_id: int) -> DataFrame:
    """snapshot_id: the latest indexed snapshots of a product's sources."""
    mine = sources.filter(F.col("product_id") == product_id).select(F.col("id").alias("source_id"))
    return small(latest_snapshots(snapshots.join(mine, "source_id", "left_semi")).select(F.col("id").alias("snapshot_id")))


def search_within(embeddings: DataFrame, files: DataFrame, latest: DataFrame, query: Sequence[float], k: int | None = None, path_prefix: str | None = None, content_type: str | None = None) -> DataFrame:
    """B-03: chunks in the snapshots of ``latest``."""
    rows = chunks_of(embeddings, filtered(files, path_prefix, content_type).join(latest, "snapshot_id"))
    return top(scored(rows, query), "chunk_id", limit_or(k)).select("chunk_id", "path", "score")


def search_by_product(embeddings: DataFrame, files: DataFrame, snapshots: DataFrame, sources: DataFrame, product_id: int, query: Sequence[float], k: int | None = None, path_prefix: str | None = None, content_type: str | None = None) -> DataFrame:
    """B-03: chunks in the latest indexed snapshots of a product's sources."""
    return search_within(embeddings, files, latest_of_product(snapshots, sources, product_id), query, k, path_prefix, content_type)


def search_by_source(embeddings: DataFrame, files: DataFrame, snapshots: DataFrame, source_id: str, query: Sequence[float], k: int | None = None, path_prefix: str | None = None, content_type: str | None = None) -> DataFrame:
    """B-04: chunks in a source's latest indexed snapshot (one row, so it is broadcast)."""
    latest = latest_snapshot(snapshots, source_id).select(F.col("id").alias("snapshot_id"))
    rows = chunks_of(embeddings, filtered(files, path_prefix, content_type).join(F.broadcast(latest), "snapshot_id"))
    return top(scored(rows, query), "chunk_id", limit_or(k)).select("chunk_id", "path", "score")


def search_by_snapshot(embeddings: DataFrame, files: DataFrame, snapshot_id: str, query: Sequence[float], k: int | None = None, path_prefix: str | None = None, content_type: str | None = None) -> DataFrame:
    """B-04: chunks in one snapshot."""
    rows = chunks_of(embeddings, filtered(files, path_prefix, content_type).filter(F.col("snapshot_id") == snapshot_id))
    return top(scored(rows, query), "chunk_id", limit_or(k)).select("chunk_id", "path", "score")


def search_summaries(summaries: DataFrame, embeddings: DataFrame, query: Sequence[float], k: int | None = None, types: Sequence[str] = (), path_prefix: str | None = None, snapshot_id: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """B-08 to B-10: summaries of a snapshot, or of the snapshots ``within``; no types means all of them."""
    if snapshot_id is not None:
        summaries = summaries.filter(F.col("snapshot_id") == snapshot_id)
    if types:
        summaries = summaries.filter(F.col("summary_type").isin(list(types)))
    if path_prefix:
        summaries = summaries.filter(F.col("target_path").startswith(path_prefix))
    if within is not None:
        summaries = summaries.join(within, "snapshot_id", "left_semi")
    rows = summaries.join(embeddings, summaries["id"] == embeddings["chunk_id"])
    return top(scored(rows, query), "id", limit_or(k, DEFAULT_SUMMARIES)).select("id", "snapshot_id", "summary_type", "target_path", "arch_type", "score")


def top_of_each(rows: DataFrame, queries: Mapping[str, Sequence[float]], k: int, key: str = "chunk_id") -> DataFrame:
    """query, key, score: the ``k`` best rows of a few named queries, in one pass over the vectors; a task hands on k rows a query."""
    scores = [F.struct(F.lit(name).alias("query"), vector.score(F.col("vector"), vector.literal(q)).alias("score")) for name, q in queries.items()]
    each = rows.select(key, F.explode(F.array(*scores)).alias("_s")).select(key, "_s.*").filter("score is not null")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    return each.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).select("query", key, "score")


def hybrid(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """B-05, J-15: the two result lists in one frame, so that one action computes both."""
    a = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "score")
    return a.unionAll(summaries.select(F.lit("summary"), "id", "score"))


class SearchError(ValueError):
    """A search whose parameters don't go together."""


def check_search(query: str, product_id: object = None, source_id: object = None) -> str:
    """B-11: which scope a plain search has; a product wins over a source."""
    if not query.strip():
        raise SearchError("a query is required")
    if product_id is None and source_id is None:
        raise SearchError("a product or a source is required")
    return "product" if product_id is not None else "source"


def check_hybrid(query: str, product_id: object = None, snapshot_id: object = None) -> str:
    """B-05: a product or a snapshot, not both."""
    if not query.strip():
        raise SearchError("a query is required")
    if (product_id is None) == (snapshot_id is None):
        raise SearchError("either a product or a snapshot is required")
    return "product" if product_id is not None else "snapshot"


def context_window(chunks: DataFrame, file_id: int, ordinal: int, before: int = 1, after: int = 1) -> DataFrame:
    """B-06, F-11: a chunk with its neighbours in the file."""
    return chunks.filter((F.col("file_id") == file_id) & F.col("ordinal").between(max(0, ordinal - before), ordinal + after)).orderBy("ordinal")


def context_of_hits(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """B-07: the window of every hit (file_id, ordinal) as one range join; the file bounds the fan-out."""
    h = hits.select("file_id", F.col("ordinal").alias("hit_ordinal"))
    near = F.col("ordinal").between(F.col("hit_ordinal") - before, F.col("hit_ordinal") + after)
    return h.join(chunks, "file_id").filter(near).select("file_id", "hit_ordinal", "ordinal", "id")


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """J-12: each hit with the previous and the next chunk, which need not be hits."""
    near = chunks.select("file_id", F.col("ordinal").alias("_o"), F.col("id").alias("_id"))
    out = hits.select("id", "file_id", "ordinal")
    for name, step in (("prev_id", -1), ("next_id", 1)):
        side = near.select("file_id", (F.col("_o") - step).alias("ordinal"), F.col("_id").alias(name))
        out = out.join(side, ["file_id", "ordinal"], "left")
    return out.select("id", "file_id", "ordinal", "prev_id", "next_id")


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of length one; those that are null, zero, or of another width or with nulls, become NaN."""
    out = np.full((len(column), width), np.nan)
    lists = column.cast(pa.list_(pa.float64()))
    own = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == width)
    flat = lists.take(pa.array(own)).flatten()
    if width and len(own):
        out[own] = flat.to_numpy(zero_copy_only=False).reshape(len(own), width)
        with np.errstate(invalid="ignore", divide="ignore"):
            out /= np.sqrt((out * out).sum(1))[:, None]
    return out


def _meeting(rows: DataFrame, queries: DataFrame, begin: Callable, meet: Callable, end: Callable, schema: str) -> DataFrame:
    """Every query meets every row, both being tables: rows are placed once, in blocks, and all queries are brought to each block.

    rows and queries end with ``vector``.  A block's rows come before its queries in the stream of its task: ``begin`` makes the
    block's state of its batches, ``meet`` gets the state and a batch of queries, ``end`` the state; they give batches of ``schema``.
    A task holds one block of ``BLOCK_VALUES`` numbers and one batch of queries, whatever the number of either.
    """
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n = -(-size["n"] * max(size["width"] or 1, 1) // BLOCK_VALUES)
    n = max(n, min(rows.sparkSession.sparkContext.defaultParallelism, size["n"] // 1_000), 1)
    left = rows.select((F.abs(F.xxhash64(*rows.columns[:-1])) % n).cast("int").alias("block"), F.lit(0).alias("side"), F.struct(*rows.columns[:-1]).alias("row"), F.lit(None).cast(queries.select(F.struct(*queries.columns[:-1])).schema[0].dataType).alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("side"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.struct(*queries.columns[:-1]).alias("query"), F.col("vector").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, state = None, [], None
        for batch in batches:
            blocks, sides = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if blocks[low] != block:
                    if block is not None:
                        yield from end(begin(held) if state is None else state)
                    block, held, state = blocks[low], [], None
                if not sides[low]:
                    held.append((part.column(2), part.column(4)))
                    continue
                state = begin(held) if state is None else state
                held = []
                for at in range(0, part.num_rows, QUERY_BLOCK):
                    some = part.slice(at, QUERY_BLOCK)
                    yield from meet(state, some.column(3), some.column(4))
        if block is not None:
            yield from end(begin(held) if state is None else state)

    dealt = left.unionAll(right).repartition("block").sortWithinPartitions("block", "side")
    return dealt.mapInArrow(run, schema)


def _field(column: pa.StructArray, i: int) -> pa.Array:
    """A field of a struct column, of its slice alone."""
    return column.flatten()[i]


def batch_top_k(embeddings: DataFrame, queries: DataFrame, k: int, digits: int = 6, itself: bool = True) -> DataFrame:
    """query_id, rank, chunk_id, score: exact top-k for a table of queries (query_id, query_vector).

    A task multiplies a block of rows with a batch of queries and keeps k rows a query, so what is shuffled after it is k rows a
    query and block.  ``itself``: whether a query's own row counts.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def begin(held: list[tuple]) -> list[tuple]:
        if not held:
            return []
        ids, vectors = (pa.concat_arrays(list(x)) for x in zip(*((_field(row, 0), vector) for row, vector in held)))
        widths = np.asarray(vectors.value_lengths().fill_null(0))
        out = []
        for w in np.unique(widths[widths > 0]).tolist():
            own = np.flatnonzero(widths == w)
            out.append((w, np.asarray(ids)[own], _unit(vectors.take(pa.array(own)), w)))
        return out

    def meet(state: list[tuple], query: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
        asked = _field(query, 0)
        for w, chunk, rows in state:
            step = max(1, SCORES // len(chunk))
            for low in range(0, len(asked), step):
                scores = np.round(_unit(vectors.slice(low, step), w) @ rows.T, digits)
                ids = asked.slice(low, step)
                if not itself:
                    scores[np.asarray(ids)[:, None] == chunk] = np.nan
                scores[~np.isfinite(scores)] = -np.inf
                best = []
                for i, own in enumerate(scores):
                    least = np.partition(own, -k)[-k] if len(own) > k else -np.inf
                    some = np.flatnonzero((own >= least) & (own > -np.inf))
                    some = some[np.lexsort((chunk[some], -own[some]))[:k]]
                    best.append((np.full(len(some), i), chunk[some], own[some]))
                at, found, score = (np.concatenate(x) for x in zip(*best))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(found), pa.array(score)], names=["query_id", "chunk_id", "score"])

    rows = embeddings.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "vector").filter("chunk_id is not null")
    found = _meeting(rows, queries.select("query_id", F.col("query_vector").alias("vector")), begin, meet, lambda _: (), f"query_id {kind}, chunk_id bigint, score double")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def max_sim(query: DataFrame, documents: DataFrame) -> DataFrame:
    """R-16: for each document (doc, token, vector) the sum, over its tokens, of the best dot product with one of the query's vectors (query_vector).

    A task multiplies a block of vectors with a batch of the query's; what is shuffled after it is a number a row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def begin(held: list[tuple]) -> tuple:
        if not held:
            return pa.array([]), pa.array([]), np.zeros(0), []
        docs, tokens, vectors = (pa.concat_arrays(list(x)) for x in zip(*((_field(row, 0), _field(row, 1), vector) for row, vector in held)))
        return docs, tokens, np.full(len(docs), np.nan), _matrices(vectors)

    def meet(state: tuple, _: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
        best, own = state[2], state[3]
        for _, q in _matrices(vectors):
            for some, x in own:
                if q.shape[1] == x.shape[1]:
                    step = max(1, SCORES // len(q))
                    for low in range(0, len(x), step):
                        at = some[low : low + step]
                        best[at] = np.fmax(best[at], (x[low : low + step] @ q.T).max(1))
        return iter(())

    def end(state: tuple) -> Iterator[pa.RecordBatch]:
        if len(state[2]):
            yield pa.RecordBatch.from_arrays([state[0], state[1], pa.array(state[2], from_pandas=True)], names=["doc", "token", "best"])

    found = _meeting(documents.select("doc", "token", "vector"), query.select(F.lit(0).alias("query_id"), F.col("query_vector").alias("vector")), begin, meet, end, f"doc {kinds['doc']}, token {kinds['token']}, best double")
    return found.groupBy("doc", "token").agg(F.max("best").alias("best")).groupBy("doc").agg(F.round(F.sum("best"), 6).alias("max_sim"))


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the vectors of one width, the vectors as rows); null and empty ones are left out."""
    lists = column.cast(pa.list_(pa.float64()))
    width = np.asarray(lists.value_lengths().fill_null(0))
    groups = [(np.flatnonzero(width == w), w) for w in np.unique(width[width > 0]).tolist()]
    return [(own, lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), w)) for own, w in groups]


def provenance(hits: DataFrame, files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """D-12: hits with the file, the source and the version they come from."""
    f = files.select(F.col("id").alias("chunk_id"), "path", "snapshot_id", "content_hash")
    s = snapshots.select(F.col("id").alias("snapshot_id"), "source_id", "version_identifier")
    return hits.select("chunk_id").join(f, "chunk_id").join(s, "snapshot_id").select("chunk_id", "path", "source_id", "version_identifier", "content_hash")
