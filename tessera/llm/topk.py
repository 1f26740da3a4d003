"""Exact top-k search by inner product, with pivot-table elimination.

Components become floor(256 * x).  Distances of every vector to PIVOTS pivots (picked far apart from a sample
of fixed size) are computed once; by the triangle inequality the largest |d(q, p) - d(x, p)| bounds d(q, x)
from below, and so the inner product (|q|^2 + |x|^2 - d^2) / 2 from above.  Every step's largest rounding error
goes off the distances and on to the bound, so that no bound is below its score.  Candidates whose bound is below the
query's k-th score so far are left out; the others are evaluated in the order of their bounds until the next
bound is below the k-th score.  A query starts with its k-th score among the sample.

Candidates are dealt by nearest pivot, and hot cells are split, into blocks of some BLOCK_ROWS rows or
BLOCK_BYTES bytes; queries into chunks of QUERY_ROWS.  Every chunk meets every block in a task of bounded size,
which keeps k rows a query.

Defined results: vectors that are null, hold null or non-finite components, or have a null id take no part; a
shorter vector counts as padded with zeros (no padding is stored: a task works on one width after the other); a
query's candidates are the rows with other ids; repeated rows of an id are candidates each, and equal rows of a
query's id one query; an empty table gives no rows; other columns are left out.  Components beyond 2**62 / 256 and scores
beyond 64 bits raise an error, since they have no integer to stand for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import discard, materialise

PIVOTS, SAMPLE_ROWS = 24, 2_048
#: Wider vectors are no pivots; they are candidates and queries like all others.
SAMPLE_WIDTH = 8_192
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS, BATCH, AT_ONCE = 8_192, 8 << 20, 4_096, 64, 32
_NONE = np.iinfo(np.int64).min


def integers(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that take part, their integer vectors)."""
    lists = column.cast(pa.list_(pa.float64()))
    length = np.asarray(lists.value_lengths().fill_null(-1))
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    good = np.isfinite(values) & np.asarray(flat.is_valid())
    at = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])
    whole = np.concatenate([[0], np.cumsum(good)])
    rows = np.flatnonzero((length >= 0) & (whole[at[1:]] - whole[at[:-1]] == np.maximum(length, 0)))
    values = np.floor(np.where(good, values, 0) * 256.0)
    if len(values) and np.abs(values).max() > 2.0**62:
        raise ArithmeticError("a component times 256 is beyond 64-bit integers")
    values = values.astype(np.int64)
    return rows, [values[at[i] : at[i + 1]] for i in rows.tolist()]


def by_width(vectors: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the vectors of one width, the vectors as rows), width after width."""
    width = np.array([len(v) for v in vectors], np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        yield own, np.concatenate([vectors[i] for i in own.tolist()]).reshape(len(own), w) if w else np.zeros((len(own), 0), np.int64)


def far_apart(sample: Sequence[np.ndarray], count: int) -> list[np.ndarray]:
    """Up to ``count`` vectors, each the farthest from those before."""
    picked, nearest = [], np.full(len(sample), np.inf)
    while len(picked) < min(count, len(sample)) and nearest.max() > 0:
        picked.append(sample[int(nearest.argmax())])
        for own, x in by_width(sample):
            nearest[own] = np.minimum(nearest[own], distances(x, picked[-1:])[:, 0])
    return picked


def distances(x: np.ndarray, pivots: Sequence[np.ndarray]) -> np.ndarray:
    """Distance of each row to each pivot, from differences: exact but for ``rounding`` times the distance."""
    x, out = x.astype(np.float64), np.zeros((len(x), len(pivots)))
    for i, p in enumerate(pivots):
        w, p = min(x.shape[1], len(p)), p.astype(np.float64)
        out[:, i] = ((x[:, :w] - p[:w]) ** 2).sum(1) + (x[:, w:] ** 2).sum(1) + (p[w:] ** 2).sum()
    return np.sqrt(out)


def rounding(width: int) -> float:
    """What a sum of so many squares, its terms and its root can be off, as a part of it."""
    return (width + 16) * 2.0**-52


def _most(x: np.ndarray, q: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(x.shape[1], 1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can round, else in 64-bit integers, else in Python's."""
    w = min(x.shape[1], q.shape[1])
    x, q = x[:, :w], q[:, :w]
    most = _most(x, q)
    if most < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return x @ q.T
    out = x.astype(object) @ q.astype(object).T
    if len(out) and max(abs(int(v)) for v in out.ravel()) >= 1 << 63:
        raise ArithmeticError("an inner product is beyond 64-bit integers")
    return out.astype(np.int64)


def scorer(x: np.ndarray, q: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """``products`` of some rows with one query; what all rows need is done once."""
    w = min(x.shape[1], q.shape[1])
    if _most(x[:, :w], q[:, :w]) < 1 << 53:
        whole, asked = x[:, :w].astype(np.float64), q[:, :w].astype(np.float64)
        return lambda rows, i: (whole[rows] @ asked[i]).astype(np.int64)
    return lambda rows, i: products(x[rows], q[i : i + 1])[:, 0]


def search_block(ids: np.ndarray, x: np.ndarray, dx: np.ndarray, qid: np.ndarray, q: np.ndarray, dq: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's number, vec_ids, scores) of the best k rows of the block that can still be among the query's best k."""
    xn, qn = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    off, pivots = rounding(max(x.shape[1], q.shape[1])), dx.T.copy()
    scored = scorer(x, q)
    for a in range(0, len(q), AT_ONCE):
        some = slice(a, a + AT_ONCE)
        low, gap = np.zeros((len(q[some]), len(x))), np.empty((len(q[some]), len(x)))
        for p, d in enumerate(pivots):
            np.subtract(dq[some, p, None], d, out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        low -= off * (dq[some].max(1, initial=0) + dx.max(initial=0))[:, None]  # more than any two distances can be off
        np.maximum(low, 0, out=low)
        total = qn[some, None] + xn
        bounds = (total - low * low) / 2 + 8 * off * total + 1
        bounds[qid[some, None] == ids] = -np.inf
        for i, bound in enumerate(bounds, a):
            floor = least[i]
            rest = np.flatnonzero((bound >= floor) & (bound > -np.inf))
            rest = rest[np.argsort(-bound[rest], kind="stable")]
            best_ids, best, c, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, BATCH
            while c < len(rest) and bound[rest[c]] >= floor:
                near = rest[c : c + size]
                got = scored(near, i)
                some_ = np.flatnonzero(got >= floor)
                if len(some_):
                    best_ids, best = np.concatenate([best_ids, ids[near[some_]]]), np.concatenate([best, got[some_]])
                    order = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[order], best[order]
                    if len(best) == k:
                        floor = max(floor, best[-1])
                c, size = c + size, 2 * size
            if len(best):
                yield i, best_ids, best


def first_floor(qid: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: Sequence[np.ndarray], k: int) -> np.ndarray:
    """Each query's k-th score among the sample's other rows: the least that its k-th best can have."""
    out = np.full(len(q), _NONE)
    if len(sample) < k:
        return out
    groups = list(by_width(sample))
    for a in range(0, len(q), 256):
        some = slice(a, a + 256)
        known = np.full((len(q[some]), len(sample)), _NONE)
        for own, x in groups:
            known[:, own] = products(q[some], x)
        known[qid[some, None] == sample_ids] = _NONE
        out[some] = np.partition(known, -k, axis=1)[:, -k]
    return out


def _vectors(column) -> list[np.ndarray]:
    return [np.frombuffer(v, np.int64) for v in column]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows by inner product, ties to the smaller id."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("vec_id is not null")
    sample = rows.filter(F.size("embedding") <= SAMPLE_WIDTH).orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "embedding").toArrow()
    keep, sample_x = integers(sample.column("embedding").combine_chunks())
    sample_ids = np.asarray(sample.column("vec_id"))[keep].astype(np.int64)
    pivots = far_apart(sample_x, PIVOTS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(batch.column(1))
            cell, at = np.zeros(len(x), np.int32), pa.array(keep)
            for own, rows_ in by_width(x):
                cell[own] = distances(rows_, pivots).argmin(1) if pivots else 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2).take(at), pa.array(cell)], names=["vec_id", "v", "is_query", "cell"])

    placed = materialise(rows.mapInArrow(place, "vec_id bigint, v binary, is_query boolean, cell int"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.octet_length("v").cast("bigint")).alias("bytes"), F.count_if("is_query").alias("q")).collect()  # a row a pivot
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = {r["cell"]: max(-(-r["n"] // BLOCK_ROWS), -(-r["bytes"] // BLOCK_BYTES)) for r in sizes}
    first, blocks = {}, 0
    for cell in sorted(parts):
        first[cell], blocks = blocks, blocks + parts[cell]
    chunks = max(1, -(-sum(r["q"] for r in sizes) // QUERY_ROWS))
    look = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("cell")]
    spread = F.xxhash64("vec_id", "v", F.monotonically_increasing_id())
    block = (look(first) + F.pmod(spread, look(parts))).cast("int")
    candidates = placed.select("vec_id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qid, q, least = np.asarray(batch.column(0)), _vectors(batch.column(1).to_pylist()), np.zeros(batch.num_rows, np.int64)
            for own, y in by_width(q):
                least[own] = first_floor(qid[own], y, sample_ids, sample_x, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=["vec_id", "v", "least"])

    queries = placed.filter("is_query").select("vec_id", "v").distinct().mapInArrow(floors, "vec_id bigint, v binary, least bigint")
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        ids, qid, least, out = c["vec_id"].to_numpy(np.int64), q["vec_id"].to_numpy(np.int64), q["least"].to_numpy(np.int64), []
        asked = [(own, y, distances(y, pivots)) for own, y in by_width(_vectors(q["v"]))]
        for some, x in by_width(_vectors(c["v"])):
            dx = distances(x, pivots)
            for own, y, dy in asked:
                for i, best, scores in search_block(ids[some], x, dx, qid[own], y, dy, least[own], k):
                    out += [(q["v"].iloc[own[i]], qid[own[i]], a, s) for a, s in zip(best, scores)]
        return pd.DataFrame(out, columns=["v", "query_id", "vec_id", "score"]) if out else pd.DataFrame({"v": pd.Series([], dtype=object), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})

    found = candidates.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInPandas(meet, "v binary, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    out = materialise(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), compact=True)
    discard(placed)
    return out
